"""Chapters, audio parts, spans and metadata: equi joins and small windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators.tasks import dealt


def chapter_audio(specs: DataFrame, parts: DataFrame, key: str = "book_id") -> DataFrame:
    """Each chapter's parts in the order of its list `audio_parts`, their summed duration, and a `problem` if one is missing."""
    wanted = specs.select(key, "chapter_no", F.posexplode("audio_parts").alias("pos", "part_no"))
    joined = wanted.join(parts.select(key, "part_no", "duration"), [key, "part_no"], "left")
    whole = joined.groupBy(key, "chapter_no").agg(F.sum("duration").alias("duration"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "part_no"))), lambda s: s["part_no"]).alias("parts"), F.count(F.when(F.col("duration").isNull(), 1)).alias("missing"))
    return whole.withColumn("problem", F.when(F.col("missing") > 0, "missing audio part")).drop("missing")


def chapters_with_audio(chapters: DataFrame, parts: DataFrame, key: str = "book_id") -> DataFrame:
    """The n-th chapter goes with the n-th part; where one side is longer there is a `problem`."""
    c = chapters.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("chapter_no")))
    p = parts.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("part_no"))).select(key, "n", "part_no", "duration")
    joined = c.join(p, [key, "n"], "full")
    return joined.withColumn("problem", F.when(F.col("chapter_no").isNull(), "no chapter").when(F.col("part_no").isNull(), "no audio part"))


def spans_from_metadata(entries: DataFrame, spine: DataFrame, key: str = "book_id") -> DataFrame:
    """A numbered chapter ends at the next larger offset on its spine, numbered or not, else with the spine. entries: key, title, spine_index, offset."""
    offsets = entries.select(key, "spine_index", "offset").distinct()
    ends = offsets.withColumn("next", F.lead("offset").over(Window.partitionBy(key, "spine_index").orderBy("offset")))
    joined = entries.join(ends, [key, "spine_index", "offset"]).join(spine, [key, "spine_index"], "left")
    out = joined.select(key, X.metadata_number(F.col("title")).alias("number"), X.metadata_title(F.col("title")).alias("title"), "spine_index", F.col("offset").alias("start"), F.coalesce("next", "duration").alias("end"))
    return out.where("number is not null")


def span_problems(spans: DataFrame, spine: DataFrame, key: str = "book_id") -> DataFrame:
    known = spine.select(key, "spine_index", F.lit(True).alias("known"))
    problem = F.when(F.col("known").isNull(), "spine out of range").when(F.col("end").isNull() | (F.col("end") <= F.col("start")), "no duration")
    return spans.join(known, [key, "spine_index"], "left").withColumn("problem", problem).where("problem is not null").drop("known")


def book_config(entries: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, number, title, chapter_count): the last title of each number by position, and the largest number."""
    named = entries.select(key, "pos", X.metadata_number(F.col("title")).alias("number"), X.metadata_title(F.col("title")).alias("title")).where("number is not null")
    titles = named.groupBy(key, "number").agg(F.max_by("title", "pos").alias("title"))
    return titles.withColumn("chapter_count", F.max("number").over(Window.partitionBy(key)))


def rank_parts(files: DataFrame, path: str = "path") -> DataFrame:
    """Audio files of each folder: 'Part n' files if there are any, else numbered ones, else all; by number, then name."""
    folder, name = F.regexp_extract(path, r"^(.*?)[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    f = files.withColumn("dir", folder).withColumn("name", name).where(F.lower("name").endswith(".mp3"))
    f = dealt(f, "dir").withColumn("tier", F.when(F.col("name").rlike(r"^Part .*\.mp3$"), 0).when(F.col("name").rlike(r"^\d{3}\b.*\.mp3$"), 1).otherwise(2))
    f = f.withColumn("best", F.min("tier").over(Window.partitionBy("dir"))).where("tier = best")
    number = F.coalesce(F.regexp_extract("name", r"(?i)^(?:Part\s+)?(\d+)", 1).try_cast("int"), F.lit(10000))
    f = f.withColumn("number", number)
    return f.withColumn("part_no", F.row_number().over(Window.partitionBy("dir").orderBy("number", "name"))).drop("tier", "best")


def incremental(df: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """What is not done yet; with `force` everything."""
    return df if force else df.join(done.select(keys).distinct(), keys, "left_anti")
