"""A content-addressed web archive.

Payload bytes are stored once, under their SHA-256, which is computed again whenever
they are read.  Record headers are stored apart, exactly as they were written.  A
record is made again by joining its headers with its payload.  Of pages with equal
payloads of at least `least_bytes`, the one with the smallest id is a response and the
others are revisits that refer to it; smaller payloads are all responses.

All steps are column expressions.  Payloads are shuffled once when they are stored and
once when records are made again; a digest that many pages share is no hot key, as
pages look up what belongs to it by groups.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import batches as B

LEAST_BYTES = 100
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: Column) -> Column:
    """The same urn for the same page, so that a task that runs again writes the same bytes."""
    h = F.sha2(F.concat(F.lit("page:"), page.cast("string")), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A line of the header, or nothing where the value is null; line ends within a value would end the header."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit(END)), F.lit(""))


def headers(df: DataFrame, date: str) -> Column:
    revisit = F.col("refers_to").isNotNull()
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    return F.concat(
        F.lit("WARC/1.1" + END), _header("WARC-Type", kind), _header("WARC-Record-ID", record_id(F.col("page_id"))), _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")), _header("X-Page-ID", F.col("page_id")), _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("payload_digest")))),
        _header("X-Payload-Length", F.col("payload_bytes")), _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to")))), _header("X-Refers-To-Page-ID", F.col("refers_to")),
        _header("Content-Type", F.lit("text/html; charset=utf-8")), _header("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))), F.lit(END),
    )


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes `folder`/records (page_id, header, which names the digest) and `folder`/payloads (payload_digest, payload).

    A null html is an empty payload.  A null url gives a record without a target.
    Rows with a null id are records of their own and never referred to, unless no row
    with that payload has an id: then all are responses.  Repeated ids with equal
    payloads are responses alike; the payload is stored once.  Other columns are left
    out, whatever their names.  An empty table gives an empty archive.
    """
    page = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8").alias("payload"))
    digest = F.unhex(F.sha2("payload", 256)).alias("payload_digest")  # half as long in shuffles
    keyed = page.select("page_id", "url", digest, F.octet_length("payload").cast("long").alias("payload_bytes"))
    first = keyed.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"))
    refers = F.when((F.col("payload_bytes") >= least_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    records = B.spread_join(keyed, first, ["payload_digest"], F.struct("page_id", "url")).withColumn("refers_to", refers)
    records.select("page_id", headers(records, date).alias("header")).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/records")
    stored = page.select(digest, "payload").dropDuplicates(["payload_digest"])
    stored.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/payloads")


def _value(name: str) -> Column:
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """payload_digest and the payload; bytes that don't have their digest raise an error wherever the payload is used."""
    stored = spark.read.parquet(f"{folder}/payloads")
    right = F.unhex(F.sha2("payload", 256)) == F.col("payload_digest")
    return stored.select("payload_digest", F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("a payload doesn't have its digest")).cast("binary")).alias("payload"))


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """What the records' own headers say, and the headers."""
    records = spark.read.parquet(f"{folder}/records").select("header")
    return records.select(
        _value("X-Page-ID").cast("long").alias("page_id"), _value("WARC-Target-URI").alias("url"), _value("WARC-Type").alias("record_type"),
        F.unhex(F.regexp_replace(_value("WARC-Payload-Digest"), "^sha256:", "")).alias("payload_digest"), _value("X-Payload-Length").cast("long").alias("payload_bytes"), _value("X-Refers-To-Page-ID").cast("long").alias("refers_to"), "header",
    )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: headers joined with the verified facts of their payloads, without the bytes."""
    facts = read_payloads(spark, folder).select("payload_digest", F.octet_length("payload").cast("long").alias("stored_bytes"))
    joined = B.spread_join(read_headers(spark, folder), facts, ["payload_digest"], F.col("header"))
    return joined.select("page_id", F.col("stored_bytes").alias("payload_bytes"), F.lower(F.hex("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def rebuild_records(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, the verified payload each record stands for (revisits too), and the record's exact WARC bytes with where its block begins.

    A payload that hasn't its digest, or not the length that the header says, raises an
    error.  Equal urls and ids are records like any other; a long payload is one value.
    Headers and payloads are plain tables, so that Spark splits the pages of a digest
    that many of them share.
    """
    whole = read_headers(spark, folder).join(read_payloads(spark, folder), "payload_digest")
    fits = F.octet_length("payload").cast("long") == F.col("payload_bytes")
    whole = whole.withColumn("payload", F.when(fits, F.col("payload")).otherwise(F.raise_error(F.lit("a payload hasn't the length of its header")).cast("binary")))
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.encode("header", "UTF-8"), block, F.encode(F.lit(END * 2), "UTF-8"))
    return whole.select("page_id", "url", "record_type", "refers_to", "payload_digest", "payload", F.octet_length("header").cast("long").alias("block_start"), record.alias("record"))


def export_warc(records: DataFrame, folder: str) -> DataFrame:
    """Writes the records of `rebuild_records` as .warc.gz files, one member for each record, and gives (path, records, bytes) of each file.

    Tasks write under names of their own; only reported files count, so a task that is
    lost or runs twice leaves an unused file and no wrong data.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, path, n, size = None, "", 0, 0
        for batch in batches:
            for record in batch["record"]:
                if stream is None:
                    system, root = fs.FileSystem.from_uri(folder)
                    system.create_dir(root, recursive=True)
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    stream = system.open_output_stream(path.replace(folder, root), compression=None)
                member = gzip.compress(record.as_py(), 6, mtime=0)
                stream.write(member)
                n, size = n + 1, size + len(member)
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return B.checkpoint(records.select("record").mapInArrow(write, "path string, records bigint, bytes bigint"))
