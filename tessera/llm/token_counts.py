"""Token counts as rollups that are maintained by deltas.

A ledger is a folder of tables. A batch brings documents to insert, revise or
delete; what each adds to or takes from the totals follows from what the ledger
holds of it. A batch writes its documents and the sums of its signed deltas by
source, language and tokenizer version to a folder of its own attempt, and
counts from the moment that its commit marker exists. The marker is created
once: applying a batch again changes nothing, and an attempt that failed before
its marker is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tokens import default_vocabulary, encoder

GROUP = ("source", "lang", "tokenizer")
#: Facts are kept in parts by document, so that a batch reads only those that hold its documents; and rows in a file of a part.
PARTS, FILE_ROWS = 64, 1_000_000
FACTS = "doc_id long, tokenizer string, source string, lang string, n_tokens long, n_chars long, live boolean, batch long, part int"
DELTAS = "source string, lang string, tokenizer string, documents long, tokens long, chars long, inserted long, deleted long, revised long, batch long"


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens, n_chars) for each row of ``docs``; a null text has no tokens.

    tokenizer names the version in the rollup; ids are by the vocabulary file.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in batches:
            text = [t if isinstance(t, str) else None for t in batch.pop("text")]
            yield batch.assign(tokenizer=tokenizer, n_tokens=[len(encode(t)) // 4 for t in text], n_chars=[len(t or "") for t in text])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")))
    return rows.mapInPandas(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long")


class TokenLedger:
    """Totals of tokens by source, language and tokenizer version, below a folder that all executors share.

    One writer at a time applies batches; their numbers order them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _file(self, name: str):
        path = self._fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def commits(self) -> dict[int, dict]:
        """The committed batches: number -> their marker's content."""
        fs, folder = self._file("commits")
        if not fs.exists(folder):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = sorted(int(n) for n in names if n.isdigit())
        if not done:
            return {}
        # One line for each batch; a marker whose writer was lost before it was written has none and doesn't count.
        rows = self.spark.read.text([f"{self.path}/commits/{n:020d}" for n in done]).collect()
        return {r["batch"]: r for r in (json.loads(x["value"]) for x in rows)}

    def _commit(self, batch: int, content: dict) -> bool:
        """Create a batch's marker; False if another attempt has done so.

        The file is created only if there is none, which the file system decides;
        one that was left empty is removed first.
        """
        fs, path = self._file(f"commits/{batch:020d}")
        if fs.exists(path) and fs.getFileStatus(path).getLen() == 0:
            fs.delete(path, False)
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return True

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/attempt={c['attempt']}" for _, c in sorted(self.commits().items())]
        return self.spark.read.option("basePath", f"{self.path}/{kind}").schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def facts(self, parts: list[int] | None = None) -> DataFrame:
        """The latest state of each (doc_id, tokenizer) that any batch brought, deleted ones included; of some parts, or of all."""
        state = F.struct("batch", "source", "lang", "n_tokens", "n_chars", "live")
        rows = self._read("facts", FACTS)
        rows = rows if parts is None else rows.where(F.col("part").isin(parts))
        return rows.groupBy("doc_id", "tokenizer").agg(F.max_by(state, "batch").alias("s")).select("doc_id", "tokenizer", "s.*")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens, chars, inserted, deleted, revised): sums of all deltas, groups without documents included."""
        sums = [F.sum(c).alias(c) for c in ("documents", "tokens", "chars", "inserted", "deleted", "revised")]
        return self._read("deltas", DELTAS).groupBy(*GROUP).agg(*sums)

    def apply(self, batch: int, changes: DataFrame, deleted: bool = False) -> bool:
        """Apply a batch of documents with their counts, or of deletions; False if the batch was applied before.

        Of the ledger's facts only the parts of the batch's documents are read.

        changes: (doc_id, tokenizer, source, lang, n_tokens, n_chars); deletions
        need doc_id and tokenizer only. A document that the ledger holds is
        revised: what it added is taken away and its new counts are added, also
        under another source or language. Deleting what isn't there, and bringing
        what is there unchanged, changes nothing. Rows with a null doc_id are
        left out; of repeated rows that with the most tokens counts, in a tie the
        last by language and source. Null sources, languages and versions are
        groups of their own.
        """
        done = self.commits()
        if batch in done:
            return False
        if done and batch < max(done):
            raise ValueError(f"batch {batch} comes before {max(done)}, which is committed")
        attempt = f"{batch:020d}-{uuid.uuid4().hex}"
        keys = ["doc_id", F.coalesce(F.col("tokenizer").cast("string"), F.lit("")).alias("tokenizer")]
        if deleted:
            rows = changes.select(*keys).where("doc_id is not null").distinct()
            new = rows.selectExpr("doc_id", "tokenizer", "struct(cast(null as long) n_tokens, cast(null as string) lang, cast(null as string) source, cast(null as long) n_chars, false live) as new")
        else:
            number = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("n_tokens", "n_chars")]
            rows = changes.select(*keys, *number, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null")
            row = F.struct("n_tokens", "lang", "source", "n_chars", F.lit(True).alias("live"))
            new = rows.groupBy("doc_id", "tokenizer").agg(F.max(row).alias("new"))
        # Saved, so that counting and placing don't tokenize the batch again.
        new.write.parquet(f"{self.path}/staged/{attempt}")
        new = self.spark.read.schema(new.schema).parquet(f"{self.path}/staged/{attempt}")
        part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
        touched = [r["part"] for r in new.select(part.alias("part")).distinct().collect()]  # at most PARTS
        known = self.facts(touched).where("live").select("doc_id", "tokenizer", F.struct("n_tokens", "lang", "source", "n_chars", "live").alias("old"))
        change = new.join(known, ["doc_id", "tokenizer"], "left").where("(old is not null or new.live) and not old <=> new")
        kept = change.select("doc_id", "tokenizer", "new.source", "new.lang", "new.n_tokens", "new.n_chars", "new.live", F.lit(batch).cast("long").alias("batch"), F.col("old"), part.alias("part"))
        files = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 + new.count() // (PARTS * FILE_ROWS)))
        kept.repartition("part", files).write.partitionBy("part").parquet(f"{self.path}/facts/attempt={attempt}")
        kept = self.spark.read.schema(kept.schema).parquet(f"{self.path}/facts/attempt={attempt}")
        # A row for what each document adds and one for what it takes away.
        plus = F.struct(F.col("source"), F.col("lang"), F.lit(1).alias("sign"), F.col("n_tokens"), F.col("n_chars"))
        minus = F.struct(F.col("old.source").alias("source"), F.col("old.lang").alias("lang"), F.lit(-1).alias("sign"), F.col("old.n_tokens").alias("n_tokens"), F.col("old.n_chars").alias("n_chars"))
        signed = kept.select("tokenizer", "live", F.col("old").isNotNull().alias("was"), F.explode(F.array_compact(F.array(F.when(F.col("live"), plus), F.when(F.col("old").isNotNull(), minus)))).alias("d"))
        signed = signed.select("d.*", "tokenizer", "live", "was")
        sums = signed.groupBy(*GROUP).agg(
            F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("n_tokens")).alias("tokens"), F.sum(F.col("sign") * F.col("n_chars")).alias("chars"),
            F.count_if(~F.col("was")).alias("inserted"), F.count_if(~F.col("live")).alias("deleted"), F.count_if(F.col("was") & F.col("live") & (F.col("sign") > 0)).alias("revised"),
        )
        sums.withColumn("batch", F.lit(batch).cast("long")).write.parquet(f"{self.path}/deltas/attempt={attempt}")
        fs, staged = self._file(f"staged/{attempt}")
        fs.delete(staged, True)
        return self._commit(batch, {"batch": batch, "attempt": attempt})
