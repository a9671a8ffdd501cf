"""WARC archives with resolved revisits.

Headers alone are shuffled by payload digest: of the records with one payload
the one with the largest id is the response, and all others become revisit
records that name it and carry no payload. Archives are written with fresh
headers and can be read back record by record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch, bounded

#: What ends a record; the archives' line separator.
END = "\r\n\r\n"
#: Records in an archive at most, and payload bytes in one on average.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 20_000, 16_000_000
#: Payload bytes in an archive at most, if it has more than one record: it is read back whole.
MOST_BYTES = 500_000_000
#: Revisits (some 100 bytes each) up to which they are broadcast.
ARCHIVE_KEYS = 200_000
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(page_id, payload_bytes, payload_digest) of a batch."""
    for batch in batches:
        payloads = [h.encode("utf-8", "surrogatepass") if isinstance(h, str) else b"" for h in batch["html"]]
        yield pd.DataFrame({
            "page_id": batch["page_id"], "payload_bytes": [len(p) for p in payloads],
            "payload_digest": [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads],
        })


def resolve_revisits(headers: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """headers (page_id, payload_bytes, payload_digest) with record_type and refers_to.

    Payloads are equal if digest and length are. A null page_id is never referred
    to unless all ids of its payload are null, and then refers to nothing.
    """
    key = ["payload_digest", "payload_bytes"]
    latest = headers.where(F.col("payload_bytes") >= least_bytes).groupBy(*key).agg(F.max("page_id").alias("latest"), F.count("*").alias("n"))
    # Only payloads that occur again are joined; both sides are saved, so that a very common payload's rows can be split.
    latest = scratch.save(latest.where("n > 1").select(*key, "latest"), "latest")
    out = headers.join(latest, key, "left")
    revisit = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return out.select(
        "page_id", *reversed(key), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("latest")).alias("refers_to")
    )


def _line(name: str, value) -> F.Column:
    """A header's line, or nothing if its value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record_id(page: str) -> F.Column:
    """The id of a page's response: a UUID by name, so that a revisit can name it."""
    name = F.md5(F.concat_ws(" ", F.col(page).cast("string"), "payload_digest"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-8$4-$5"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, scratch: Scratch | None = None) -> None:
    """Write pages (page_id, url, html, ...) as WARC 1.1 archives below ``path``.

    One record per row: a response with the html in UTF-8 (null: empty) as its
    payload, or a revisit of the response with the same payload. Line breaks in
    a url are percent-encoded; a null url or id leaves its header out.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    headers = scratch.save(pages.mapInPandas(_digests, "page_id long, payload_bytes long, payload_digest string"), "headers")
    total, rows, largest = headers.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)), F.count("*"), F.coalesce(F.max("payload_bytes"), F.lit(0))).first()
    # Rows that repeat an id have one payload each; it is part of the key.
    revisits = resolve_revisits(headers, scratch, least_bytes).where("record_type = 'revisit' and page_id is not null")
    revisits = scratch.save(revisits.select("page_id", "payload_digest", "refers_to").distinct(), "revisits")
    digest = pages.mapInPandas(_with_digest, "page_id long, url string, html string, payload_bytes long, payload_digest string")
    records = digest.join(bounded(revisits, ARCHIVE_KEYS), ["page_id", "payload_digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.when(revisit, "").otherwise(F.coalesce("html", F.lit("")))
    one = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.when(revisit | F.col("page_id").isNull(), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).otherwise(_record_id("page_id"))),
        _line("WARC-Date", now),
        _line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        _line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        _line("WARC-Profile", F.when(revisit, F.lit(_REVISIT))),
        _line("WARC-Refers-To", F.when(revisit, _record_id("refers_to"))),
        _line("WARC-Refers-To-Date", F.when(revisit, now)),
        _line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        _line("Content-Length", F.octet_length(payload).cast("string")),
        F.lit("\r\n"),
        payload,
    )
    at_most = max(1, min(ARCHIVE_RECORDS, rows * ARCHIVE_BYTES // max(1, total), MOST_BYTES // max(1, largest)))
    records.select(one.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", at_most).text(path)


def _with_digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        (found,) = _digests(iter([batch]))
        yield batch.assign(payload_bytes=found["payload_bytes"], payload_digest=found["payload_digest"])


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and block of each record of an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        begin = end + 4
        at = begin + int(headers["Content-Length"])
        yield headers, content[begin:at]
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of record at byte {at}")
        at += 4


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for head, block in _records(content):
                kind = head["WARC-Type"]
                size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(block), base64.b32encode(hashlib.sha1(block).digest()).decode()) != (size, digest):
                    raise ValueError(f"payload of {head.get('X-Page-ID')} differs from its digest")
                refers = head["X-Refers-To-Page-ID"] if kind == "revisit" else None
                rows.append((head.get("X-Page-ID"), head.get("WARC-Target-URI"), size, digest, kind, refers, block.decode("utf-8", "surrogatepass") if kind == "response" else None))
                if len(rows) == 2000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each record of archives below ``path``.

    Payloads are checked against their digests; a revisit's is null.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInPandas(_parse, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload string")
    return rows.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def round_trip(pages: DataFrame, least_bytes: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read their records back.

    An empty table makes no archive and gives no records.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    path = scratch.path("archives")
    write_archives(pages, path, least_bytes, scratch)
    return read_archives(spark, path)
