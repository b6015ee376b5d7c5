"""Time algebra on tables of parts, chapters and fragments: windows and range joins, always within a book.

Rows that break a rule come back as data-quality rows (`problem`), never as an exception.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators.tasks import dealt


def _book(keys: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def timeline(chapters: DataFrame, keys: Sequence[str] = ("book_id",), order: str = "chapter_no") -> DataFrame:
    """Adds start and end: the running sum of earlier durations, and that plus the own."""
    before = F.coalesce(F.sum("duration").over(_book(keys, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return chapters.withColumn("start", before).withColumn("end", F.col("start") + F.col("duration"))


def allocation_bounds(counts: DataFrame, parts: DataFrame, key: str = "book_id", order: str = "part_no") -> DataFrame:
    """Contiguous ranges [start_idx, end_idx) of `n` fragments in proportion to durations, at least one for each part, the last takes the rest.

    `counts`: (key, n); `parts`: (key, part_no, duration >= 0).  Books with no time in
    total or fewer fragments than parts have a `problem` and no ranges.
    """
    w, whole = _book([key], order), Window.partitionBy(key)
    p = parts.join(counts, key).withColumn("i", F.row_number().over(w)).withColumn("k", F.count(F.lit(1)).over(whole))
    p = p.withColumn("total", F.sum("duration").over(whole)).withColumn("cum", F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    problem = F.when(F.col("n") <= 0, "no fragments").when(F.col("total") <= 0, "no duration").when(F.col("n") < F.col("k"), "fewer fragments than parts")
    target = F.least(F.bround(F.col("n") * F.col("cum") / F.nullif(F.col("total"), F.lit(0.0))), (F.col("n") - (F.col("k") - F.col("i"))).cast("double")) - F.col("i")
    p = p.withColumn("problem", problem).withColumn("t", target)
    over = F.greatest(F.lit(0.0), F.max("t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.when(F.col("problem").isNull(), F.when(F.col("i") == F.col("k"), F.col("n")).otherwise((F.col("i") + over).cast("long")))
    p = p.withColumn("end_idx", end).withColumn("start_idx", F.when(F.col("problem").isNull(), F.coalesce(F.lag("end_idx").over(w), F.lit(0).cast("long"))))
    return p.select(key, order, "duration", "start_idx", "end_idx", "problem")


def allocated_texts(fragments: DataFrame, parts: DataFrame, key: str = "book_id", order: str = "part_no") -> DataFrame:
    """The fragments (key, `n` of the book, frag_idx, ...) with the part that `allocation_bounds` gives them: adds part_no and duration.

    One sweep: the parts' bounds are found by windows over the parts of a book and its
    fragments together, and each fragment takes the last part that begins at or before
    it.  So fragments are made once and shuffled once, by book, and nothing is copied
    for each part.  Books with a problem are left out.
    """
    rest = [c for c in fragments.columns if c not in (key, "n", "frag_idx")]
    kinds = dict(fragments.dtypes)
    f = fragments.select(key, F.col("n").cast("long").alias("n"), F.col("frag_idx").cast("long").alias("frag_idx"), *rest, F.lit(None).cast(dict(parts.dtypes)[order]).alias(order), F.lit(None).cast("double").alias("duration"))
    p = parts.select(key, F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("frag_idx"), *[F.lit(None).cast(kinds[c]).alias(c) for c in rest], order, F.col("duration").cast("double").alias("duration"))
    both, whole = dealt(f.unionByName(p), key), Window.partitionBy(key)
    of_part, upto = F.col("frag_idx").isNull(), _book([key], order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__n", F.max("n").over(whole)).withColumn("__k", F.count(F.when(of_part, 1)).over(whole)).withColumn("__total", F.sum("duration").over(whole))
    both = both.where("__n > 0 and __total > 0 and __n >= __k")
    both = both.withColumn("__i", F.count(F.when(of_part, 1)).over(upto)).withColumn("__cum", F.sum("duration").over(upto))
    target = F.least(F.bround(F.col("__n") * F.col("__cum") / F.col("__total")), (F.col("__n") - (F.col("__k") - F.col("__i"))).cast("double")) - F.col("__i")
    both = both.withColumn("__t", F.when(of_part, target))
    end = (F.col("__i") + F.greatest(F.lit(0.0), F.max("__t").over(upto))).cast("long")
    both = both.withColumn("__end", F.when(of_part, end))
    start = F.when(F.col("__i") == 1, F.lit(0).cast("long")).otherwise(F.lag("__end").over(_book([key], order)))
    at = both.withColumn("__at", F.when(of_part, start).otherwise(F.col("frag_idx"))).withColumn("__part", of_part)
    sweep = Window.partitionBy(key).orderBy("__at", F.desc("__part")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(of_part, F.struct(order, "duration")), ignorenulls=True).over(sweep)
    return at.withColumn("__last", last).where("not __part").select(key, F.col(f"__last.{order}").alias(order), "__last.duration", F.col("frag_idx").cast("int").alias("frag_idx"), *rest)


def anchor_segments(fragments: DataFrame, parts: DataFrame, prefix: str, key: str = "book_id") -> DataFrame:
    """Three parts: the last begins at the first fragment with that prefix, the first two share what is before by their durations; else by allocation."""
    at = fragments.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("text").startswith(prefix), F.col("frag_idx"))).alias("anchor"))
    d = parts.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.max(F.when(F.col("part_no") == 1, F.col("duration"))).alias("d1"), F.max(F.when(F.col("part_no") == 2, F.col("duration"))).alias("d2"))
    good = at.join(d, key).where("k = 3 and n >= 3 and anchor >= 2")
    split = F.least(F.greatest(F.bround(F.col("anchor") * F.col("d1") / F.nullif(F.col("d1") + F.col("d2"), F.lit(0.0))), F.lit(1.0)), (F.col("anchor") - 1).cast("double")).cast("long")
    cuts = good.select(key, F.posexplode(F.array(F.struct(F.lit(0).cast("long").alias("start_idx"), split.alias("end_idx")), F.struct(split.alias("start_idx"), F.col("anchor").cast("long").alias("end_idx")), F.struct(F.col("anchor").cast("long").alias("start_idx"), F.col("n").alias("end_idx")))))
    cuts = cuts.select(key, (F.col("pos") + 1).alias("part_no"), "col.start_idx", "col.end_idx")
    rest = parts.join(good.select(key), key, "left_anti")
    other = allocation_bounds(at.select(key, "n"), rest, key).select(key, "part_no", "start_idx", "end_idx")
    return cuts.unionByName(other)


def slice_by_boundaries(fragments: DataFrame, bounds: DataFrame, keys: Sequence[str] = ("book_id",)) -> DataFrame:
    """Fragments with start_idx <= frag_idx < end_idx of each range; the equal keys keep the range join within a book."""
    return fragments.join(bounds, list(keys)).where("frag_idx >= start_idx and frag_idx < end_idx")


def slice_by_counts(alignment: DataFrame, chapters: DataFrame, key: str = "book_id") -> DataFrame:
    """One alignment of a whole book cut by each chapter's number of fragments `n`; what is over is left out."""
    end = F.sum("n").over(_book([key], "chapter_no").rowsBetween(Window.unboundedPreceding, 0))
    bounds = chapters.withColumn("end_idx", end).withColumn("start_idx", F.col("end_idx") - F.col("n")).drop("n")
    return slice_by_boundaries(alignment, bounds, [key])


def short_alignments(alignment: DataFrame, chapters: DataFrame, key: str = "book_id") -> DataFrame:
    """Books whose alignment has fewer fragments than their chapters need."""
    have = alignment.groupBy(key).agg(F.count(F.lit(1)).alias("have"))
    need = chapters.groupBy(key).agg(F.sum("n").alias("need"))
    return need.join(have, key, "left").where("coalesce(have, 0) < need").withColumn("problem", F.lit("too few aligned fragments"))


def merge_shifted(fragments: DataFrame, offsets: DataFrame, keys: Sequence[str] = ("book_id",), part: str = "segment_no") -> DataFrame:
    """Shifts each part's times by its offset and numbers fragments through: frag_no from 1, id, begin, end."""
    joined = dealt(dealt(fragments, *keys, part).join(offsets.select(*keys, part, "offset"), [*keys, part]), *keys)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(part, "frag_idx"))
    shifted = joined.withColumn("frag_no", number).withColumn("begin", X.round3(F.col("begin") + F.col("offset"))).withColumn("end", X.round3(F.col("end") + F.col("offset")))
    return shifted.withColumn("id", X.fragment_id(F.col("frag_no"))).drop("offset")


def merge_segments(fragments: DataFrame, durations: DataFrame, keys: Sequence[str] = ("book_id",)) -> DataFrame:
    """Segments follow one another: the offset is the sum of earlier durations."""
    return merge_shifted(fragments, timeline(durations, keys, "segment_no").withColumnRenamed("start", "offset"), keys)


def merge_intervals(fragments: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("book_id",)) -> DataFrame:
    """Intervals begin where they say: the offset is time_start."""
    return merge_shifted(fragments, intervals.withColumnRenamed("time_start", "offset"), keys)


def alignment_problems(alignment: DataFrame, durations: DataFrame, keys: Sequence[str], overlap: float = 0.001, overrun: float = 5.0) -> DataFrame:
    """Fragments that begin before the last one's end, end before they begin, or whose last end is not above 0 or too far beyond the duration."""
    w = _book(keys, "frag_idx")
    a = alignment.join(durations, list(keys), "left").withColumn("before", F.lag("end").over(w)).withColumn("last", F.lead("end").over(w).isNull())
    problem = F.when(F.col("begin") < F.col("before") - overlap, "overlap").when(F.col("end") < F.col("begin"), "negative length").when(F.col("last") & (F.col("end") <= 0), "empty").when(F.col("last") & (F.col("end") > F.col("duration") + overrun), "overrun")
    return a.withColumn("problem", problem).where("problem is not null").select(*keys, "frag_idx", "begin", "end", "problem")


def apply_overrides(fragments: DataFrame, overrides: DataFrame, keys: Sequence[str] = ("book_id", "chapter_no")) -> DataFrame:
    """From the first fragment with the prefix on, times move so that it begins at local_begin; a chapter where none matches has a `problem`."""
    w = Window.partitionBy(*keys)
    joined = fragments.join(overrides.select(*keys, "text_prefix", "local_begin"), list(keys), "left")
    joined = joined.withColumn("first_idx", F.min(F.when(F.col("text").startswith(F.col("text_prefix")), F.col("frag_idx"))).over(w))
    joined = joined.withColumn("delta", F.col("local_begin") - F.max(F.when(F.col("frag_idx") == F.col("first_idx"), F.col("begin"))).over(w))
    moved = F.when(F.col("frag_idx") >= F.col("first_idx"), F.col("delta")).otherwise(0.0)
    out = joined.withColumn("begin", X.round3(F.col("begin") + moved)).withColumn("end", X.round3(F.col("end") + moved))
    return out.withColumn("problem", F.when(F.col("text_prefix").isNotNull() & F.col("first_idx").isNull(), "no fragment matches the override")).drop("text_prefix", "local_begin", "first_idx", "delta")


def interpolate_gaps(times: DataFrame, first_start: Column, last_end: Column, keys: Sequence[str] = ("book_id",), order: str = "frag_idx") -> DataFrame:
    """Runs of rows without begin and end share the time between their neighbours equally."""
    w = _book(keys, order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    t = times.withColumn("open", F.col("begin").isNull())
    t = t.withColumn("left", F.coalesce(F.last("end", ignorenulls=True).over(back), first_start)).withColumn("right", F.coalesce(F.first("begin", ignorenulls=True).over(ahead), last_end))
    t = t.withColumn("island", F.count(F.when(~F.col("open"), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*keys, "island", "open")
    t = t.withColumn("k", F.row_number().over(own.orderBy(order))).withColumn("m", F.count(F.lit(1)).over(own))
    share = F.greatest(F.lit(0.001), F.col("right") - F.col("left")) / F.col("m")
    begin = F.when(F.col("open"), F.col("left") + (F.col("k") - 1) * share).otherwise(F.col("begin"))
    end = F.when(F.col("open"), F.col("left") + F.col("k") * share).otherwise(F.col("end"))
    return t.withColumn("new_begin", X.round3(begin)).withColumn("new_end", X.round3(end)).drop("begin", "end", "open", "left", "right", "island", "k", "m").withColumnsRenamed({"new_begin": "begin", "new_end": "end"})


def weight(text: Column) -> Column:
    """A fragment's share in the time of its segment: the length of its normalised text."""
    return F.greatest(F.lit(1), F.length(X.normalize_match(text)))


def proportional_times(assigned: DataFrame, keys: Sequence[str], order: str = "frag_idx") -> DataFrame:
    """Fragments that share a segment (seg_start, seg_end) split it by their weights `w`, or if there are none those of `text`; the last ends with it."""
    w, whole = _book(keys, order), Window.partitionBy(*keys)
    a = assigned if "w" in assigned.columns else assigned.withColumn("w", weight(F.col("text")))
    span = F.greatest(F.lit(0.001), F.col("seg_end") - F.col("seg_start"))
    total, upto = F.sum("w").over(whole), F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.row_number().over(w) == F.count(F.lit(1)).over(whole)
    begin, end = F.col("seg_start") + span * (upto - F.col("w")) / total, F.when(last, F.greatest(F.col("seg_end"), F.col("seg_start") + 0.001)).otherwise(F.col("seg_start") + span * upto / total)
    return a.withColumns({"begin": X.round3(begin), "end": X.round3(end)}).drop("w")  # at once, else Spark makes each window twice


def single_alignment_bounds(fragments: DataFrame, durations: DataFrame, key: str = "book_id") -> DataFrame:
    """Chapters of one long recording: from the first fragment's begin to the next chapter's start, else the recording's end."""
    starts = fragments.groupBy(key, "chapter_no").agg(F.min_by("begin", "frag_idx").alias("start"))
    return starts.join(durations, key).withColumn("end", F.coalesce(F.lead("start").over(_book([key], "chapter_no")), F.col("duration"))).drop("duration")


def anchor_windows(durations: DataFrame, step: float = 600.0, length: float = 30.0) -> DataFrame:
    """A clip of `length` seconds at every `step` seconds of each recording."""
    if step <= 0 or length <= 0:
        raise ValueError("step and length must be positive")
    n = F.ceil(F.col("duration") / step).cast("int")
    w = durations.where("duration > 0").withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    return w.withColumn("clip_start", F.col("k") * F.lit(step)).withColumn("clip_length", F.least(F.lit(length), F.col("duration") - F.col("clip_start"))).drop("k")


#: Points of a key that one task walks through.
BLOCK_POINTS = 50_000


def _point_blocks(points: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Adds `block`: long keys are cut between times, into blocks of about `size` points, by counts over a few equal spans of time for each block. Equal times stay together."""
    w = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    spans = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("time").alias("__low"), F.max("time").alias("__high")).where(F.col("__n") > size)
    bins = F.ceil(F.lit(16) * F.col("__n") / size)
    share = (F.col("time") - F.col("__low")) / F.greatest(F.col("__high") - F.col("__low"), F.lit(1e-300))
    binned = points.join(spans, list(keys), "left").withColumn("__bin", F.coalesce(F.least(F.floor(share * bins), bins - 1), F.lit(0)).cast("long")).drop("__n", "__low", "__high")
    filled = binned.where("__bin >= 0").join(spans.select(*keys), list(keys), "left_semi").groupBy(*keys, "__bin").count()
    blocks = filled.select(*keys, "__bin", F.floor(F.coalesce(F.sum("count").over(w), F.lit(0)) / size).cast("int").alias("block"))
    return binned.join(blocks, [*keys, "__bin"], "left").withColumn("block", F.coalesce("block", F.lit(0))).drop("__bin")


def _pointers(time: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the points, in order of time and idx: the idx of the last point kept if it is kept, how many are kept from it on, and the least idx of what comes no earlier (to find where a chain enters)."""
    n = len(time)
    last, many = idx.copy(), np.ones(n, np.int64)
    stack: list[int] = []  # points of later times, of which none has a greater idx behind a smaller one
    i = n
    while i > 0:
        j = i
        while j > 0 and time[j - 1] == time[i - 1]:
            j -= 1
        for k in range(i - 1, j - 1, -1):
            at = bisect.bisect_left(stack, -int(idx[k]), key=lambda p: -int(idx[p]))  # idx falls along the stack's end
            if at > 0:
                to = stack[at - 1]
                last[k], many[k] = last[to], many[to] + 1
        for k in range(i - 1, j - 1, -1):
            while stack and idx[stack[-1]] <= idx[k]:
                stack.pop()
            stack.append(k)
        i = j
    return last, many


def _entries(time: np.ndarray, idx: np.ndarray) -> list[int]:
    """The points at which chains enter, whatever idx they come with: those above all points of earlier times and, of one time, all above these."""
    out, bar, i = [], -(1 << 63), 0
    while i < len(time):
        j = i
        while j < len(time) and time[j] == time[i]:
            j += 1
        own = [k for k in range(i, j) if idx[k] > bar]
        out += own
        bar = max(bar, int(idx[j - 1]))
        i = j
    return out


def monotone_points(points: DataFrame, keys: Sequence[str], block_points: int = BLOCK_POINTS) -> DataFrame:
    """By time and index, the points that lie beyond the last kept one in both: keys, pos, time, idx, source; `points`: keys, time, idx, source.

    Each point points to the next one that would be kept after it, so what is kept is a
    chain.  The points of a long key lie in blocks of time.  A block tells, for each idx
    that a chain may come in with, the idx it goes out with and how many it keeps; a
    key's blocks are put together from these few rows, and then each block walks its
    own part of the chain.  So no key is one task's work.
    """
    typed = points.select(*keys, F.col("time").cast("double").alias("time"), F.col("idx").cast("long").alias("idx"), F.col("source").cast("string").alias("source")).where("time is not null and idx is not null")
    first = typed.groupBy(*keys, "time", "idx").agg(F.min("source").alias("source"))  # of equal points the first source is kept
    long_keys = (first.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > block_points
    blocks = _point_blocks(first, keys, block_points) if long_keys else first.withColumn("block", F.lit(0))
    names, kinds = [*keys, "block"], dict(typed.dtypes)
    keyed = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def summary(table: pa.Table) -> pa.Table:
        table = table.sort_by([("time", "ascending"), ("idx", "ascending")])
        time, idx = table["time"].to_numpy(), table["idx"].to_numpy()
        last, many = _pointers(time, idx)
        # a chain that comes in with less than the idx of an entry, and with no less than that of the entry before, goes on there
        enter = _entries(time, idx)
        head = table.slice(0, 1).select(names).take(pa.array([0] * len(enter), pa.int64()))
        return head.append_column("below", pa.array(idx[enter], pa.int64())).append_column("out", pa.array(last[enter], pa.int64())).append_column("kept", pa.array(many[enter], pa.int64()))

    def compose(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("block", "ascending"), ("below", "ascending")])
        bar, pos, out = -(1 << 63), 0, []
        block, below, leave, kept = (rows[c].to_pylist() for c in ("block", "below", "out", "kept"))
        for b in sorted(set(block)):
            x, y = bisect.bisect_left(block, b), bisect.bisect_right(block, b)
            out.append((b, bar, pos))
            at = bisect.bisect_right(below, bar, x, y)
            if at < y:
                bar, pos = leave[at], pos + kept[at]
        head = rows.slice(0, 1).select(list(keys)).take(pa.array([0] * len(out), pa.int64()))
        for i, (name, kind) in enumerate((("block", pa.int32()), ("bar", pa.int64()), ("offset", pa.int64()))):
            head = head.append_column(name, pa.array([o[i] for o in out], kind))
        return head

    long = blocks.where("block > 0").select(*keys).distinct()
    summaries = blocks.join(long, list(keys), "left_semi").groupBy(*names).applyInArrow(summary, f"{keyed}, block int, below bigint, out bigint, kept bigint")
    come = summaries.groupBy(*keys).applyInArrow(compose, f"{keyed}, block int, bar bigint, offset bigint")
    walked = blocks.join(come, names, "left") if long_keys else blocks.withColumns({"bar": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    walked = walked.select(*names, "time", "idx", "source", F.coalesce("bar", F.lit(-(1 << 63))).alias("bar"), F.coalesce("offset", F.lit(0).cast("long")).alias("offset"))
    result = [*keys, "pos", "time", "idx", "source"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pos, last = None, 0, (0.0, 0)
        for batch in batches:
            rows, places = [], []
            owner = list(zip(*(batch[k].to_pylist() for k in names), strict=True))
            for i, (own, time, idx, bar, offset) in enumerate(zip(owner, *(batch[c].to_pylist() for c in ("time", "idx", "bar", "offset")), strict=True)):
                if own != key:
                    key, pos, last = own, offset, (-math.inf, bar)
                if time > last[0] and idx > last[1]:
                    rows.append(i)
                    places.append(pos)
                    pos, last = pos + 1, (time, idx)
            kept = batch.take(pa.array(rows, pa.int64()))
            columns = {**{n: kept[n] for n in kept.schema.names}, "pos": pa.array(places, pa.int32())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in result], names=result)

    ordered = walked.repartition(*names).sortWithinPartitions(*names, "time", "idx")
    return ordered.mapInArrow(keep, f"{keyed}, pos int, time double, idx bigint, source string")


def boundaries(anchors: DataFrame, ends: DataFrame, manual: DataFrame | None = None, keys: Sequence[str] = ("book_id", "chapter_no")) -> DataFrame:
    """Intervals between neighbouring kept points: start, anchors, manual points, and the end (`ends`: keys, n, duration)."""
    points = anchors.select(*keys, "time", "idx", F.lit("anchor").alias("source"))
    points = points.unionByName(ends.select(*keys, F.lit(0.0).alias("time"), F.lit(0).cast("long").alias("idx"), F.lit("start").alias("source")))
    points = points.unionByName(ends.select(*keys, F.col("duration").alias("time"), F.col("n").cast("long").alias("idx"), F.lit("end").alias("source")))
    if manual is not None:
        points = points.unionByName(manual.select(*keys, "time", "idx", F.lit("manual").alias("source")))
    w = _book(keys, "pos")
    out = monotone_points(points, keys)
    for name, c in (("fragment_end", "idx"), ("time_end", "time"), ("source_end", "source")):
        out = out.withColumn(name, F.lead(c).over(w))
    return out.where("fragment_end is not null").withColumnsRenamed({"idx": "fragment_start", "time": "time_start", "source": "source_start"}).drop("pos")


def append_outro(chapters: DataFrame, parts: DataFrame, key: str = "book_id") -> DataFrame:
    """Chapters of kind 'chapter' and, as 'outro' without a number, the first part beyond their count."""
    counts = chapters.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    outro = parts.join(counts, key).where("part_no = n + 1").select(key, F.lit("outro").alias("kind"), F.lit(None).cast("int").alias("number"), "part_no", "duration")
    return chapters.select(key, F.lit("chapter").alias("kind"), F.col("chapter_no").cast("int").alias("number"), F.col("chapter_no").alias("part_no"), "duration").unionByName(outro)


def active_paragraph(positions: DataFrame, paragraphs: DataFrame, keys: Sequence[str] = ("book_id", "chapter_no"), bucket: float = 60.0) -> DataFrame:
    """The last paragraph with begin <= t < end for each position, or null; both sides are dealt by key and minute, so that a hot book spreads."""
    spread = paragraphs.withColumn("__minute", F.explode(F.sequence(F.floor(F.col("begin") / bucket), F.floor(F.greatest("begin", F.col("end")) / bucket))))
    at = positions.withColumn("__minute", F.floor(F.col("t") / bucket))
    spread = dealt(spread.select(*keys, "__minute", F.col("frag_idx").alias("__idx"), F.col("begin").alias("__b"), F.col("end").alias("__e")), *keys, "__minute")
    hit = at.join(spread, [*keys, "__minute"]).where("t >= __b and t < __e").select("position_id", "__idx")
    best = dealt(hit, "position_id").groupBy("position_id").agg(F.max("__idx").alias("frag_idx"))
    return positions.join(best, "position_id", "left")
