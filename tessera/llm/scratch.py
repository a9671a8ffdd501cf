"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing Parquet tables below
``spark.checkpoint.dir``; an executor that is lost afterwards costs a reread,
not a recomputation. Only where that setting is absent (tests, notebooks) a
temporary folder of the driver's machine is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting that removes the shuffles of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("tessera.scratch.dir", "") or "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.scratch.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables of one operator call, each in a folder of its own.

    A table that nothing reads any more is removed by ``drop``; the others stay
    until the folder is cleared, as the returned DataFrames read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def path(self, name: str) -> str:
        """A new folder below this call's."""
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str, rows: int | None = None, per_task: int = 100_000) -> DataFrame:
        """Write ``df`` and return the DataFrame that reads it back.

        rows: a bound of its rows, if known; it then has no more tasks and files
        than ``per_task`` rows each need.
        """
        path = self.path(name)
        if rows is not None:
            df = df.coalesce(1 + rows // per_task)
        # Nothing else reads the shuffles of this write, so they needn't stay on the executors' disks until the driver collects garbage.
        conf, before = self.spark.conf, self.spark.conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(_CLEANUP, before)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(saved)] = (saved, path)
        return saved

    def drop(self, *saved: DataFrame) -> None:
        """Remove tables that :meth:`save` returned."""
        for df in saved:
            _, path = self.paths.pop(id(df))
            self._remove(path)

    def clear(self) -> None:
        """Remove all tables of this call."""
        self.paths.clear()
        self._remove(self.root)

    def _remove(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of two long columns up to which a table may be broadcast (about 16 MB of keys).
BROADCAST_KEYS = 1_000_000


def bounded(df: DataFrame, bound: int = BROADCAST_KEYS) -> DataFrame:
    """``df`` (saved before, narrow) for the smaller side of a join.

    Its rows are counted first: within the bound it is broadcast, so that the
    larger side isn't shuffled; beyond it both sides are.
    """
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df.hint("merge")


def only_keys(df: DataFrame, keys: DataFrame, on: list[str], bound: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``df`` whose ``on`` is among ``keys`` (distinct, saved before, narrow)."""
    return df.join(bounded(keys, bound), on, "left_semi")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't in ``gone`` (doc_id, distinct, saved before), whatever other columns are named; null equals null."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(bounded(gone), F.col("row.doc_id").eqNullSafe(F.col("doc_id")), "left_anti").select("row.*")
