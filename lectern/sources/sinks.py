"""Sinks: chapter and book texts, manifests, anchors."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def chapter_lines(fragments: DataFrame) -> DataFrame:
    """One row for each chapter: its fragments, one a line, and its file name."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("frag_idx", "text"))), lambda s: s["text"])
    out = fragments.groupBy("book_id", "chapter_no").agg(F.array_join(texts, "\n").alias("text"))
    return out.withColumn("name", F.format_string("chapter_%03d", F.col("chapter_no")))


def book_lines(fragments: DataFrame) -> DataFrame:
    chapters = F.array_sort(F.collect_list(F.struct("chapter_no", "text")))
    return chapter_lines(fragments).groupBy("book_id").agg(F.array_join(F.transform(chapters, lambda s: s["text"]), "\n").alias("text"))


def _write_by_book(texts: DataFrame, path: str, buckets: int) -> None:
    """JSON rows, the books dealt over `buckets` folders: the number of files doesn't grow with that of books."""
    dealt = texts.withColumn("bucket", F.pmod(F.xxhash64("book_id"), F.lit(buckets)))
    dealt.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def write_chapter_text(fragments: DataFrame, path: str, buckets: int = 64) -> None:
    _write_by_book(chapter_lines(fragments).select("book_id", "name", "text"), path, buckets)


def write_book_text(fragments: DataFrame, path: str, buckets: int = 64) -> None:
    """As `readers.read_book_text(..., lines=True)` reads them."""
    _write_by_book(book_lines(fragments).select("book_id", F.col("book_id").cast("string").alias("source"), "text"), path, buckets)


def write_chapter_files(fragments: DataFrame, path: str) -> None:
    """A folder of plain text for each chapter, for a few books that other programs read."""
    chapter_lines(fragments).select("book_id", "name", "text").write.mode("overwrite").partitionBy("book_id", "name").text(path)


def write_units(df: DataFrame, path: str, by: tuple[str, ...], force: bool = False) -> None:
    """Appends units that were not there; with `force` their partitions take the place of the old ones, and others stay."""
    writer = df.write.partitionBy(*by)
    (writer.mode("overwrite").option("partitionOverwriteMode", "dynamic") if force else writer.mode("append")).parquet(path)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """One rename in the file system that holds `source`; the target's parent is made first."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(target).getParent())
    if not files.rename(path(source), path(target)):
        raise OSError(f"{source} could not be renamed to {target}")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def committed_units(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame | None:
    """(by, run, rows, digest) of each unit's last committed run; None before the first."""
    if not _exists(spark, f"{path}/commits"):
        return None
    last = F.max_by(F.struct("run", "rows", "digest"), "run").alias("c")
    return spark.read.parquet(f"{path}/commits").groupBy(*by).agg(last).select(*by, "c.*")


def commit_units(df: DataFrame, path: str, by: Sequence[str], force: bool = False) -> None:
    """Writes the units that have no commit record, or with `force` all, so that a job that dies anywhere can run again.

    Rows are staged and moved by one rename to the folder of this run; then a record of
    each unit (its rows, and a digest of their content) is staged, and moved by one
    rename as well: only that makes the run count.  What a dead job leaves is never read,
    and its units are written by the next run.  A unit written again counts by its last run.
    """
    spark, done = df.sparkSession, committed_units(df.sparkSession, path, by)
    todo = df if force or done is None else df.join(done.select(*by), list(by), "left_anti")
    number = 0 if done is None else int(done.agg(F.max("run")).first()[0].split("-")[0]) + 1
    run = f"{number:09d}-{uuid.uuid4().hex}"
    staged, record = f"{path}/_staging/{run}", f"{path}/_staging/{run}-record"
    todo.write.parquet(staged)
    _rename(spark, staged, f"{path}/data/run={run}")
    digest = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest")
    written = spark.read.schema(df.schema).parquet(f"{path}/data/run={run}").groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), digest)
    written.write.parquet(record)
    _rename(spark, record, f"{path}/commits/run={run}")


def read_units(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """The committed rows of all units, and of a unit written more than once those of its last run."""
    done = committed_units(spark, path, by)
    if done is None:
        raise FileNotFoundError(f"{path} holds no committed unit")
    return spark.read.parquet(f"{path}/data").join(done.select(*by, "run"), [*by, "run"], "left_semi").drop("run")


def damaged_units(spark: SparkSession, path: str, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Units whose rows aren't those of their commit record: by, rows and digest as recorded, and as found. `columns`: of the table that was written, in its order."""
    digest = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("found_digest")
    found = spark.read.parquet(f"{path}/data").groupBy(*by, "run").agg(F.count(F.lit(1)).alias("found_rows"), digest)
    joined = committed_units(spark, path, by).join(found, [*by, "run"], "left")
    return joined.where("not (rows <=> found_rows and digest <=> found_digest)")


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def anchors_payload(anchors: DataFrame, keys: tuple[str, ...] = ("book_id", "chapter_no")) -> DataFrame:
    """Matched and skipped clips of each chapter."""
    row, matched = F.struct("clip_start", "frag_idx", "time", "score", "text"), F.col("frag_idx").isNotNull()
    return anchors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(matched, row))).alias("anchors"), F.array_sort(F.collect_list(F.when(~matched, F.col("clip_start")))).alias("skipped"))


def write_anchors(anchors: DataFrame, path: str) -> None:
    anchors_payload(anchors).write.mode("overwrite").json(path)
