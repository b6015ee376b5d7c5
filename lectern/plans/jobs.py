"""Whole jobs: a chapter aligned through anchors, and a book of chapters with their audio, from texts and parts to manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import matching as M
from lectern.operators import structure as S
from lectern.operators import timeline as T
from lectern.operators.tasks import dealt, stored
from lectern.plans.queries import _made_books, _turn_fragments, _turns, parts, query


def anchored_times(fragments: DataFrame, clips: DataFrame, durations: DataFrame, manual: DataFrame | None = None, keys: Sequence[str] = ("book_id", "chapter_no")) -> DataFrame:
    """Times of a chapter's fragments between its anchors: keys, frag_no, id, frag_idx, text, begin, end.

    Clips with their transcripts are matched to fragments; what is monotone among these
    anchors, manual points and the chapter's ends cuts it into intervals, in each of
    which the fragments share the time; the intervals are merged to one alignment.
    """
    fragments = stored(fragments, "fragments")  # read by the matching, the ends and the slices
    anchors = M.match_anchor(clips, fragments, keys=keys).where("frag_idx is not null").select(*keys, "time", F.col("frag_idx").cast("long").alias("idx"))
    anchors = stored(anchors, "anchors")  # the boundaries read them several times, and would match as often
    ends = fragments.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(durations, list(keys))
    bounds = T.boundaries(anchors, ends, manual, keys).withColumnsRenamed({"fragment_start": "start_idx", "fragment_end": "end_idx"})
    bounds = bounds.withColumn("segment_no", F.col("start_idx")).select(*keys, "segment_no", "start_idx", "end_idx", "time_start", "time_end")
    bounds = stored(bounds, "bounds")  # for the slices and for the merging
    sliced = T.slice_by_boundaries(fragments, bounds, keys).withColumn("seg_start", F.lit(0.0)).withColumn("seg_end", F.col("time_end") - F.col("time_start"))
    timed = T.proportional_times(sliced, [*keys, "segment_no"]).select(*keys, "segment_no", "frag_idx", "text", "begin", "end")
    return T.merge_intervals(timed, bounds.select(*keys, "segment_no", "time_start"), keys).drop("segment_no")


def chaptered_manifest(books: DataFrame, audio_parts: DataFrame, titles: dict[int, str], count: int, headers: Sequence[str] = ()) -> DataFrame:
    """Books to manifests: chapters under their headings, the n-th with the n-th part, paragraphs sharing its time, and the first part beyond them as outro. Chapters without a part are left out; `S.chapter_problems` and `A.chapters_with_audio` tell them.

    Books are cut once, and their paragraphs are shuffled once, by book, to the list of its
    parts; all that follows stays in a book's task.  So they are merged with the parts,
    however few these are: behind a broadcast join every window would shuffle the texts.
    """
    listed = audio_parts.join(books.select("book_id"), "book_id", "left_semi").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("part_no", "duration"))).alias("__parts"))
    cut = books.select("book_id", S.chapter_paragraphs(F.col("text"), titles, count, headers).alias("__chapters"))
    whole = dealt(cut, "book_id").join(listed.hint("merge"), "book_id")
    n = F.least(F.size("__chapters"), F.size("__parts"))
    heading = lambda c: F.concat(F.array(S.chapter_heading(c["chapter_no"], c["title"])), c["paragraphs"])
    on = F.zip_with(F.slice("__chapters", 1, n), F.slice("__parts", 1, n), lambda c, p: F.struct(F.lit("chapter").alias("kind"), c["chapter_no"].alias("number"), c["title"].alias("title"), p["part_no"].alias("part_no"), p["duration"].alias("duration"), heading(c).alias("texts")))
    beyond = F.filter(F.slice("__parts", n + 1, F.size("__parts")), lambda p: p["part_no"] == n + 1)
    outro = F.transform(beyond, lambda p: F.struct(F.lit("outro").alias("kind"), F.lit(None).cast("int").alias("number"), F.lit("Outro").alias("title"), p["part_no"].alias("part_no"), p["duration"].alias("duration"), F.lit(None).cast("array<string>").alias("texts")))
    units = whole.select("book_id", F.explode_outer(F.when(n > 0, F.concat(on, outro))).alias("u")).where("u is not null").select("book_id", "u.*")  # outer: else Spark tests the arrays' sizes before the join, and cuts the books anew for it
    unit = ["book_id", "kind", "number", "title", "part_no", "duration"]
    rows = units.select(*unit, F.posexplode_outer("texts").alias("frag_idx", "text"))
    timed = T.proportional_times(rows.withColumn("seg_start", F.lit(0.0)).withColumn("seg_end", F.col("duration")), ["book_id", "part_no"])
    timed = timed.withColumn("id", X.paragraph_id(F.col("number"), X.fragment_id(F.col("frag_idx") + 1), F.col("frag_idx")))
    chapters = timed.groupBy(*unit).agg(M.listed_paragraphs())
    return M.nested_manifest(chapters.withColumn("paragraphs", F.when(F.col("kind") == "chapter", F.col("paragraphs"))))


@query()
def anchored_alignment(s, d):
    """Conversations as chapters: every fourth turn is a clip with its transcript."""
    turns = _turns(s, d)
    clips = turns.where("seg_idx % 4 = 1").select("book_id", "chapter_no", F.concat_ws("-", "book_id", "seg_idx").alias("clip_id"), "text", F.col("start").alias("clip_start"), F.lit(0.0).alias("first_start"))
    return anchored_times(_turn_fragments(s, d), clips, turns.groupBy("book_id", "chapter_no").agg(F.max("end").alias("duration")))


@query()
def chaptered_books(s, d):
    return chaptered_manifest(_made_books(s, d), parts(s, d), {1: "The First Part", 2: "The Second Part"}, 2, ["The First Part"])
