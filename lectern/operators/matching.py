"""Matching text to speech: similarity joins and greedy alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators import kernels as K
from lectern.operators import timeline as T
from lectern.operators.tasks import stored


def _ratio(least: float):
    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        """The ratio where it can reach `least`, else 0; a's letters are placed once for all its neighbours."""
        out, last, masks = [], None, {}
        for x, y in zip(a, b, strict=True):
            if not x or not y:
                out.append(0.0)
                continue
            if x != last:
                last, masks = x, K.letter_masks(x)
            out.append(K.similarity(x, y) if K.ratio_bound(masks, len(x), y) >= least else 0.0)
        return pd.Series(out, dtype="float64")

    return ratio


def similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """Containment is settled by Spark; only what is left is sent to Python. Below `least` the score is 0."""
    empty = F.coalesce(a == "", F.lit(True)) | F.coalesce(b == "", F.lit(True))
    held = a.contains(b) | b.contains(a)
    return F.when(empty, 0.0).when(held, 1.0).otherwise(_ratio(least)(F.when(~empty & ~held, a), F.when(~empty & ~held, b)))


#: Fragments that alignment hands back to Spark at once.
ALIGNED_ROWS = 4096
#: Words of a window by which a text and one that holds it meet.
WINDOW_WORDS = 4


def _windows(words: Column, first: Column, last: Column, width: Column) -> Column:
    """Hashes of the windows of `width` words that begin at the words first..last."""
    return F.when(last >= first, F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(F.array().cast("array<bigint>"))


def _held(short: DataFrame, long: DataFrame, keys: Sequence[str], short_id: str, long_id: str) -> DataFrame:
    """(keys, short_id, long_id) of the texts `norm` of `short` that stand in one of `long`, wherever, also within words.

    A text of three words or more stands where its inner words are whole words: its
    longest inner window of up to WINDOW_WORDS words is its key, and a long text has all
    its windows as keys.  A text of one or two words stands within a word, or at the end
    of one and the start of the next: long texts have the pieces of these lengths as
    keys.  Only texts with a key in common are compared.
    """
    words, n = F.split("norm", " "), F.size("w")
    a = short.where("norm <> ''").select(*keys, F.col(short_id).alias("__s"), words.alias("w"))
    width = F.least(F.lit(WINDOW_WORDS), n - 2)
    inner = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), n - width)), lambda i: F.struct(F.length(F.array_join(F.slice("w", i, F.greatest(F.lit(1), width)), "")).alias("length"), F.xxhash64(F.slice("w", i, F.greatest(F.lit(1), width))).alias("hash")))
    key = F.when(n > 2, F.coalesce(F.array_max(inner)["hash"], F.lit(0))).otherwise(F.xxhash64(F.lit("piece"), F.array_join("w", " ")))  # never null: else a filter on it would split each text for each of its words
    a = a.select(*keys, "__s", key.alias("__key"), F.when(n > 2, width).alias("__width"), F.when(n == 1, F.length(F.get("w", F.lit(0)))).alias("__one"), F.when(n == 2, F.struct(F.length(F.get("w", F.lit(0))).alias("a"), F.length(F.get("w", F.lit(1))).alias("b"))).alias("__two"))
    shapes = a.groupBy(*keys).agg(F.collect_set("__width").alias("widths"), F.collect_set("__one").alias("ones"), F.collect_set("__two").alias("twos"))  # lengths, few however many texts; one row if there are no keys
    b = long.where("norm <> ''").select(*keys, F.col(long_id).alias("__l"), words.alias("w"))
    b = b.join(shapes, list(keys)) if keys else b.join(F.broadcast(shapes))
    inside = F.flatten(F.transform("widths", lambda q: _windows(F.col("w"), F.lit(1), n - q + 1, q)))

    def piece(text: Column) -> Column:
        return F.xxhash64(F.lit("piece"), text)

    within = F.flatten(F.transform("ones", lambda k: F.flatten(F.transform("w", lambda x: F.when(F.length(x) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x) - k + 1)), lambda i: piece(F.substring(x, i, k)))).otherwise(F.array().cast("array<bigint>"))))))
    across = F.flatten(F.transform("twos", lambda t: F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: piece(F.concat(F.right(F.get("w", i - 1), t["a"]), F.lit(" "), F.left(F.get("w", i), t["b"]))))).otherwise(F.array().cast("array<bigint>"))))
    b = b.select(*keys, "__l", F.explode_outer(F.array_distinct(F.concat(inside, within, across))).alias("__key")).where("__key is not null")
    met = a.select(*keys, "__s", "__key").join(b, [*keys, "__key"]).select(*keys, "__s", "__l").distinct()
    texts = met.join(short.select(*keys, F.col(short_id).alias("__s"), F.col("norm").alias("__a")), [*keys, "__s"]).join(long.select(*keys, F.col(long_id).alias("__l"), F.col("norm").alias("__b")), [*keys, "__l"])
    return texts.where(F.col("__b").contains(F.col("__a"))).select(*keys, F.col("__s").alias(short_id), F.col("__l").alias(long_id))


def contained_pairs(clips: DataFrame, fragments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, clip_id, frag_idx) where one's normalised text, not empty, holds the other's. Texts meet by windows of words, not by `keys` alone, of which there may be none."""
    longest = clips.agg(F.max(F.length("norm")).alias("__most"))
    small = fragments.join(F.broadcast(longest)).where(F.length("norm") <= F.col("__most")).drop("__most")  # one row
    names = [*keys, "clip_id", "frag_idx"]
    return _held(clips, fragments, keys, "clip_id", "frag_idx").select(names).unionByName(_held(small, clips, keys, "frag_idx", "clip_id").select(names)).distinct()


def contained_anchors(clips: DataFrame, fragments: DataFrame, keys: Sequence[str] = ("book_id", "chapter_no")) -> DataFrame:
    """Clips whose normalised text holds a fragment or is held by one: the lowest such index. Nothing can score more."""
    return contained_pairs(clips, fragments, keys).groupBy("clip_id").agg(F.min("frag_idx").alias("frag_idx"))


def _near_in_length(q: DataFrame, f: DataFrame, keys: Sequence[str], a: str, b: str, ratio: float) -> DataFrame:
    """Pairs within the keys whose lengths let them reach `ratio`: they meet by bands of length, in which each is at most one away from the other's."""
    wide = (2 - ratio) / ratio * (1 + 1e-9)

    def band(c: str) -> Column:
        return F.floor(F.log(F.greatest(F.lit(1), F.length(c))) / F.lit(math.log(wide))).cast("int")

    bands = F.explode(F.array(*[band(a) + k for k in (-1, 0, 1)])).alias("__band")
    pairs = q.where(F.length(a) > 0).select("*", bands).join(f.where(F.length(b) > 0).withColumn("__band", band(b)), [*keys, "__band"]).drop("__band")
    return pairs.where(2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b)) >= ratio)


def match_anchor(clips: DataFrame, fragments: DataFrame, least: float = 0.58, keys: Sequence[str] = ("book_id", "chapter_no"), min_chars: int = 0) -> DataFrame:
    """For each clip (clip_id, keys, text, clip_start, first_start) the best fragment: frag_idx, score and time; unmatched clips have nulls.

    Score: the similarity to a fragment, or 0.92 of that to it and the next three; ties
    go to the lowest index.  Texts that hold each other meet by their words, others by
    the bands of their lengths; what their longest common subsequence keeps below
    `least` is never compared.
    """
    w = Window.partitionBy(*keys).orderBy("frag_idx")
    norm = X.normalize_match(F.col("text"))
    f = fragments.select(*keys, "frag_idx", norm.alias("norm"))
    f = f.withColumn("more", F.trim(F.regexp_replace(F.concat_ws(" ", "norm", *[F.lead("norm", k).over(w) for k in (1, 2, 3)]), " +", " ")))
    f = f.where(F.length("norm") >= min_chars)
    texts = F.explode(F.array(F.struct((F.col("frag_idx") * 2).cast("long").alias("place"), "norm"), F.struct((F.col("frag_idx") * 2 + 1).cast("long").alias("place"), F.col("more").alias("norm"))))
    f = f.select(*keys, texts.alias("t")).select(*keys, F.col("t.place").alias("frag_idx"), "t.norm")  # both texts of a fragment: even places, and odd ones with the next three
    f = stored(f, "anchored")  # both tables are read for each way to meet, and their regular expressions cost more than all joins
    c = stored(clips.select("clip_id", *keys, norm.alias("norm")), "clips")
    factor = F.when(F.col("frag_idx") % 2 == 0, 1.0).otherwise(0.92)
    best = F.max(F.struct("score", (-F.floor(F.col("frag_idx") / 2)).alias("n"))).alias("b")
    held = contained_pairs(c, f, keys).withColumn("score", factor).groupBy("clip_id").agg(best)
    rest = c.join(held.where("b.score = 1").select("clip_id"), "clip_id", "left_anti").withColumnRenamed("norm", "q")
    near = _near_in_length(rest, f, keys, "q", "norm", least).where(2.0 * F.least(F.length("q"), F.length("norm")) / (F.length("q") + F.length("norm")) * factor >= least - 1e-9)
    near = near.select("clip_id", "frag_idx", (factor * similarity(F.col("q"), F.col("norm"), least)).alias("score")).where(F.col("score") >= least).groupBy("clip_id").agg(best)
    found = held.unionByName(near).groupBy("clip_id").agg(F.max("b").alias("b")).where(F.col("b.score") >= least).select("clip_id", (-F.col("b.n")).alias("frag_idx"), "b.score")
    time = X.round3(F.col("clip_start") + F.coalesce("first_start", F.lit(0.0)))
    return clips.join(found, "clip_id", "left").withColumn("score", X.round3(F.col("score"))).withColumn("time", F.when(F.col("frag_idx").isNotNull(), time))


def align_to_segments(fragments: DataFrame, segments: DataFrame, keys: Sequence[str] = ("book_id", "chapter_no"), accept: float = 0.58, stop: float = 0.92, lookahead: int | None = None) -> DataFrame:
    """Greedy monotone alignment of a chapter's fragments to its transcript segments: adds seg_idx (null where unmatched) and score (0 there).

    Chapters are dealt and sorted by Spark, a chapter's segments before its fragments, and
    stream through Python one after another: a call for each would cost more than its alignment.
    """
    f = fragments.select(*keys, F.lit(1).alias("__kind"), F.col("frag_idx").cast("long").alias("frag_idx"), "text", X.normalize_match(F.col("text")).alias("__norm"))
    s = segments.select(*keys, F.lit(0).alias("__kind"), F.col("seg_idx").cast("long").alias("frag_idx"), F.lit(None).cast("string").alias("text"), X.normalize_match(F.col("text")).alias("__norm"))
    rows = f.unionByName(s).repartition(*keys).sortWithinPartitions(*keys, "__kind", F.asc_nulls_last("frag_idx"))
    schema = T_.StructType([*(rows.schema[k] for k in keys), *(T_.StructField(n, k) for n, k in (("frag_idx", T_.LongType()), ("text", T_.StringType()), ("seg_idx", T_.LongType()), ("score", T_.DoubleType())))])
    columns, arrow = [*keys, "__kind", "frag_idx", "text", "__norm"], to_arrow_schema(schema)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heard, spoken, out = None, [], [], []

        def aligned() -> list[tuple]:
            found = K.align([r[-1] or "" for r in spoken], [n for _, n in heard], accept, stop, lookahead)
            return [(*key, place, text, None if i is None else heard[i][0], score) for (place, text, _), (i, score) in zip(spoken, found, strict=True)]

        def packed() -> Iterator[pa.RecordBatch]:
            for x in range(0, len(out), ALIGNED_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out[x : x + ALIGNED_ROWS], strict=True), arrow.types, strict=True)], schema=arrow)
            out.clear()

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                *own, kind, place, text, norm = row
                if own != key:
                    if spoken:
                        out += aligned()
                    if len(out) >= ALIGNED_ROWS:
                        yield from packed()
                    key, heard, spoken = own, [], []
                if kind:
                    spoken.append((place, text, norm))
                else:
                    heard.append((place, norm or ""))
        if spoken:
            out += aligned()
        yield from packed()

    return rows.mapInArrow(match, schema)


def assign_times(fragments: DataFrame, segments: DataFrame, keys: Sequence[str] = ("book_id", "chapter_no"), low: float = 0.7, **options) -> DataFrame:
    """Times for every fragment: by its segment's share, or between its neighbours; status matched, low or unmatched. segments: keys, seg_idx, start, end, text."""
    matched = align_to_segments(fragments, segments, keys, **options)
    timed = matched.join(segments.select(*keys, F.col("seg_idx").cast("long").alias("seg_idx"), F.col("start").alias("seg_start"), F.col("end").alias("seg_end")), [*keys, "seg_idx"], "left")
    timed = T.proportional_times(timed, [*keys, "seg_idx"])  # null where unmatched, as their segment's times are; apart, they would be aligned a second time
    edges = segments.groupBy(*keys).agg(F.min_by("start", "seg_idx").alias("__first"), F.max_by("end", "seg_idx").alias("__last"))
    out = T.interpolate_gaps(timed.join(edges, list(keys), "left"), F.col("__first"), F.col("__last"), keys)
    status = F.when(F.col("seg_idx").isNull(), "unmatched").when(F.col("score") < low, "low").otherwise("matched")
    return out.withColumn("status", status).select(*keys, "frag_idx", "text", "seg_idx", "score", "begin", "end", "status")


def match_audit(timed: DataFrame, keys: Sequence[str] = ("book_id", "chapter_no")) -> DataFrame:
    """Unmatched and low-confidence fragments of each chapter."""
    row = F.struct("frag_idx", "score", "text")
    return timed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("status") == "unmatched", row))).alias("unmatched"), F.array_sort(F.collect_list(F.when(F.col("status") == "low", row))).alias("low_confidence"))


def manifest(chapters: DataFrame, paragraphs: DataFrame, key: str = "book_id") -> DataFrame:
    """One row for each book: its duration and its nested chapters with their time-coded paragraphs. chapters: key, kind, number, title, part_no, duration."""
    nested = paragraphs.groupBy(key, "part_no").agg(listed_paragraphs())
    return nested_manifest(chapters.join(nested, [key, "part_no"], "left"), key)


def listed_paragraphs() -> Column:
    """A group's paragraphs in order, as `nested_manifest` takes them."""
    return F.array_sort(F.collect_list(F.struct("frag_idx", "id", "text", "begin", "end"))).alias("paragraphs")


def nested_manifest(chapters: DataFrame, key: str = "book_id") -> DataFrame:
    """`manifest` of chapters that have their `paragraphs` with them, in the chapter's time; null for none."""
    timed = T.timeline(chapters, (key,), "part_no")
    local = lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text"), X.round3(F.col("start") + s["begin"]).alias("begin"), X.round3(F.col("start") + s["end"]).alias("end"), X.round3(s["begin"]).alias("localBegin"), X.round3(s["end"]).alias("localEnd"))
    full = timed.withColumn("paragraphs", F.transform("paragraphs", local))
    chapter = F.struct("part_no", "kind", "number", "title", X.round3(F.col("start")).alias("start"), X.round3(F.col("end")).alias("end"), "duration", "paragraphs")
    return full.groupBy(key).agg(X.round3(F.max("end")).alias("duration"), F.array_sort(F.collect_list(chapter), lambda a, b: F.coalesce((a["part_no"] - b["part_no"]).cast("int"), F.lit(0))).alias("chapters"))
