"""Books to chapters, paragraphs and fragments; repair and audit of fragments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators import kernels as K

CHAPTER = "array<struct<chapter_no:int,title:string,body:string>>"


def _each(function, kind: str):
    """By single rows, which Spark sends in batches of 100: Arrow's batches of 10,000 whole books would all stand in memory."""
    return F.udf(lambda x: None if x is None else function(x), kind, useArrow=False)


def html_to_text(c: Column) -> Column:
    return _each(K.html_to_text, "string")(c)


def title_case_heading(c: Column) -> Column:
    return _each(K.title_case, "string")(c)


def normalize_pdf_lines(c: Column) -> Column:
    return _each(K.reflow, "string")(c)


def extract_chapters(books: DataFrame, titles: dict[int, str] | None = None, count: int = 38) -> DataFrame:
    """(book_id, chapter_no, title, body) of the chapters under CHAPTER headings."""
    found = _each(lambda t: K.chapters(t, titles or {}, count), CHAPTER)(F.col("text"))
    return books.select("book_id", F.explode(found).alias("c")).select("book_id", "c.*")


def extract_marked_chapters(books: DataFrame, specs: list[dict]) -> DataFrame:
    """As above by number and marker title; `specs`: chapter_no, marker_title, display_title. A missing one has a `problem`."""
    kind = CHAPTER.replace("body:string", "body:string,problem:string")
    found = _each(lambda t: K.marked_chapters(t, specs), kind)(F.col("text"))
    return books.select("book_id", F.explode(found).alias("c")).select("book_id", "c.*")


def normalize_paragraphs(c: Column, headers: Sequence[str] = (), header: str | None = None) -> Column:
    names = frozenset(h.strip().upper() for h in headers)
    return _each(lambda t: K.paragraphs(t, names, header), "array<string>")(c)


def drop_running_headers(lines: DataFrame, headers: DataFrame, line: str = "line") -> DataFrame:
    """Lines that are no header and no header with a page number, whatever their case. `headers`: one column `header`."""
    known = headers.select(X.upper_letters(F.trim("header")).alias("__h")).distinct()
    whole = X.upper_letters(X.strip(F.col(line)))
    out = lines.withColumn("__raw", whole).withColumn("__cut", F.regexp_replace(whole, r"\s+\d{1,4}$", ""))
    out = out.join(known, out["__raw"] == known["__h"], "left_anti").join(known, F.col("__cut") == F.col("__h"), "left_anti")
    return out.drop("__raw", "__cut")


def chapter_heading(number: Column, title: Column) -> Column:
    return F.concat(F.lit("Chapter "), F.coalesce(X.chapter_word(number), number.cast("string")), F.lit(". "), title, F.lit("."))


def paragraph_fragments(chapters: DataFrame, headers: Sequence[str] = ()) -> DataFrame:
    heading = chapter_heading(F.col("chapter_no"), F.col("title"))
    return chapters.select("book_id", "chapter_no", F.posexplode(F.concat(F.array(heading), normalize_paragraphs(F.col("body"), headers))).alias("frag_idx", "text"))


def chapter_paragraphs(text: Column, titles: dict[int, str] | None = None, count: int = 38, headers: Sequence[str] = ()) -> Column:
    """A book's chapters with their paragraphs in one step, so that no body goes to Python and back in between."""
    names = frozenset(h.strip().upper() for h in headers)
    found = _each(lambda t: [{"chapter_no": c["chapter_no"], "title": c["title"], "paragraphs": K.paragraphs(c["body"], names)} for c in K.chapters(t, titles or {}, count)], "array<struct<chapter_no:int,title:string,paragraphs:array<string>>>")
    return found(text)


def sentence_fragments(chapters: DataFrame) -> DataFrame:
    heading = F.concat(F.lit("Chapter "), F.col("chapter_no").cast("string"), F.lit(". "), F.col("title"), F.lit("."))
    return chapters.select("book_id", "chapter_no", F.posexplode_outer(F.concat(F.array(heading), X.split_sentences(F.col("body")))).alias("frag_idx", "text")).where("frag_idx is not null")


def book_fragments(books: DataFrame, split=X.split_sentences, keys: Sequence[str] = ("book_id",)) -> DataFrame:
    """(keys, n, frag_idx, text): each text's fragments by `split`, and how many it has.

    Outer, and filtered afterwards: before an inner explode Spark would test the array's
    size, which splits every text twice.
    """
    listed = books.select(*keys, split(F.col("text")).alias("__all"))
    rows = listed.select(*keys, F.size("__all").alias("n"), F.posexplode_outer("__all").alias("frag_idx", "text"))
    return rows.where("frag_idx is not null")


def drop_figure_blocks(fragments: DataFrame, prefixes: Sequence[str], keys: Sequence[str] = ("book_id", "chapter_no")) -> DataFrame:
    """Drops a fragment that is nothing but 'Fig.' and the captions directly behind it."""
    w = Window.partitionBy(*keys).orderBy("frag_idx")
    f = fragments.withColumn("__block", F.count(F.when(~X.is_caption(F.col("text"), prefixes) | (X.strip(F.col("text")) == X.BARE_FIGURE), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lead = F.first("text").over(Window.partitionBy(*keys, "__block").orderBy("frag_idx"))
    return f.withColumn("__lead", lead).where((X.strip(F.col("__lead")) != X.BARE_FIGURE) | (F.col("__block") == 0)).drop("__block", "__lead")


def repair_figure_refs(fragments: DataFrame, keys: Sequence[str] = ("book_id", "chapter_no")) -> DataFrame:
    """A fragment that ends in a cut-off figure reference loses it and takes in the prose behind the next one's figure number.

    Whether a reference waits at a fragment depends on what stands before: a fragment
    with a cut-off reference leaves one, one that is both that and a figure number
    turns the state around, all others leave none.  So it is the last fragment that
    isn't both, and how many are since then.
    """
    w = Window.partitionBy(*keys).orderBy("frag_idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    f = fragments.select(*keys, "frag_idx", "text").withColumn("__cut", X.strip_dangling_figure(F.col("text"))).withColumn("__prose", X.prose_after_figure_number(F.col("text")))
    leaves, number = F.col("__cut").isNotNull(), F.col("__prose").isNotNull()
    both = leaves & number
    f = f.withColumn("__seen", F.count(F.when(both, 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    f = f.withColumn("__sure", F.last(F.when(~both, F.struct(leaves.alias("leaves"), "__seen")), ignorenulls=True).over(before))
    turned = F.col("__seen") - F.when(both, 1).otherwise(0) - F.coalesce("__sure.__seen", F.lit(0))
    waits = F.coalesce("__sure.leaves", F.lit(False)) != (turned % 2 == 1)
    f = f.withColumn("__taken", number & waits)
    joined = F.when(F.lead("__taken").over(w), X.ensure_terminal(X.strip(F.concat("__cut", F.lit(" "), F.lead("__prose").over(w))))).otherwise(X.ensure_terminal(F.col("__cut")))
    out = f.withColumn("__out", F.when(leaves, joined).otherwise(F.col("text"))).where("not __taken and __out <> ''")
    return out.select(*keys, (F.row_number().over(w) - 1).alias("frag_idx"), F.col("__out").alias("text"))


#: What a chapter's citations wait for, as digits: nothing behind an ended fragment, nothing behind an open one, a run of one
#: fragment behind either (by what is left if it stays alone), a run of more.
_ENDED, _OPEN, _ALONE_ENDED, _ALONE_OPEN, _RUN = "01234"


def merge_citations(fragments: DataFrame, keys: Sequence[str] = ("book_id", "chapter_no"), rounds: int = 16) -> DataFrame:
    """Puts citations together that were cut in two: a citation goes to the open fragment before it, a fragment that ends with a citation takes in its continuations up to the first that ends a sentence. A fragment that follows an unfinished run stays by itself.

    A fragment maps what was waited for before it to what is waited for after it, a
    word of five digits; such maps are composed over 1, 2, 4 ... fragments by windows.
    An ordinary fragment's map doesn't depend on what was before, so `rounds` is enough
    for runs of 2 ** rounds citations and figures without one.  Then it is known of
    every fragment whether it belongs to the one before, and groups are joined.
    """
    w = Window.partitionBy(*keys).orderBy("frag_idx")
    text = F.col("text")
    f = fragments.select(*keys, "frag_idx", X.strip(text).alias("text"))
    f = f.withColumn("__more", X.is_citation_continuation(text)).withColumn("__orphan", X.is_orphan_citation(text)).withColumn("__head", X.ends_with_citation(text))
    f = f.withColumn("__ended", text.rlike(r"[.?!]\z")).withColumn("__alone", F.when(F.col("__head"), X.strip_dangling_citation(text)))
    after = F.when(F.col("__ended"), _ENDED).otherwise(_OPEN)
    gone = F.col("__alone") == ""
    from_ended = F.when(F.col("__head"), _ALONE_ENDED).otherwise(after)  # a lone run that leaves nothing is behind what was there before
    from_open = F.when(F.col("__orphan"), after).when(F.col("__head"), F.when(gone, _ALONE_OPEN).otherwise(_ALONE_ENDED)).otherwise(after)
    taken = F.when(F.col("__ended"), _ENDED).otherwise(_RUN)
    f = f.withColumn("__map", F.concat(from_ended, from_open, *[F.when(F.col("__more"), taken).otherwise(x) for x in (from_ended, from_open, from_open)]))
    for k in range(rounds):
        f = f.withColumn("__earlier", F.coalesce(F.lag("__map", 1 << k).over(w), F.lit("01234"))).withColumn("__map", F.expr("translate(__earlier, '01234', __map)"))
    f = f.withColumn("__before", F.substring(F.coalesce(F.lag("__map").over(w), F.lit("01234")), 1, 1))
    in_run = F.col("__before").isin(_ALONE_ENDED, _ALONE_OPEN, _RUN) & F.col("__more")
    open_before = F.col("__before").isin(_OPEN, _ALONE_OPEN, _RUN)
    f = f.withColumn("__joins", in_run | (open_before & F.col("__orphan")))
    f = f.withColumn("__taken", F.coalesce(F.lead(in_run).over(w), F.lit(False)))
    single = F.col("__head") & ~F.col("__joins") & ~F.col("__taken")
    f = f.withColumn("text", F.when(single, F.col("__alone")).otherwise(text)).where(~(single & gone))
    f = f.withColumn("__group", F.count(F.when(~F.col("__joins"), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("frag_idx", "text"))), lambda s: s["text"])
    return f.groupBy(*keys, "__group").agg(F.array_join(parts, " ").alias("text")).select(*keys, (F.col("__group") - 1).cast("int").alias("frag_idx"), "text")


def chapter_problems(chapters: DataFrame, count: int, least: int = 5, headers: Sequence[str] = ()) -> DataFrame:
    """Books whose chapters aren't 1..count, and chapters whose body has fewer than `least` paragraphs."""
    numbers = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.col("chapter_no").cast("int"))).alias("have"))
    wrong = numbers.where(F.col("have") != F.sequence(F.lit(1), F.lit(count))).select("book_id", F.lit(None).cast("int").alias("chapter_no"), F.lit("chapters not 1..n").alias("problem"))
    short = chapters.where(F.size(normalize_paragraphs(F.coalesce("body", F.lit("")), headers)) < least)
    return wrong.unionByName(short.select("book_id", F.col("chapter_no").cast("int").alias("chapter_no"), F.lit("few paragraphs").alias("problem")))


def audit_reason(text: Column, prefixes: Sequence[str] = ()) -> Column:
    """Why a fragment looks broken; the first rule that holds."""
    opened = F.length(F.regexp_replace(text, r"[^(]", "")) > F.length(F.regexp_replace(text, r"[^)]", ""))
    closed = F.length(F.regexp_replace(text, r"[^(]", "")) < F.length(F.regexp_replace(text, r"[^)]", ""))
    return (
        F.when(X.strip_dangling_figure(text).isNotNull(), "dangling figure").when((X.strip(text) == X.BARE_FIGURE) | X.is_caption(text, prefixes), "caption").when(X.is_orphan_citation(text), "orphan citation")
        .when(X.strip(text).rlike(r"\bet al\.$"), "et al.").when(opened, "unmatched (").when(closed & (F.size(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), 1)) <= 8), "short unmatched )")
    )


def audit_fragments(fragments: DataFrame, prefixes: Sequence[str] = ()) -> DataFrame:
    return fragments.withColumn("reason", audit_reason(F.col("text"), prefixes)).where("reason is not null")


def segment_rates(fragments: DataFrame, durations: DataFrame, keys: Sequence[str] = ("book_id",), part: str = "part_no") -> DataFrame:
    """Fragments, words and words per minute (one decimal; null without time) of each segment."""
    words = F.size(F.filter(F.split(F.col("text"), r"\s+"), lambda x: x != ""))
    totals = fragments.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("fragments"), F.sum(words).alias("words"))
    minutes = F.col("duration") / 60
    return totals.join(durations, [*keys, part]).withColumn("words_per_minute", F.when(minutes > 0, F.bround(F.col("words") / minutes, 1)))
