"""Long books as tables of lines: reflow, chapters and paragraphs without a row that holds a book.

A table of lines has the key columns, line_no (from 0 without gaps) and line.  What a
line needs of those before it is found in two levels: within blocks of `block` lines,
and across blocks by one row of each.  So a book's lines are dealt over many tasks.
Results equal those of the column functions on whole texts (`structure`), but that lines
end wherever `str.splitlines` ends them, also at headings.

Null lines count as blank ones; a book without lines gives no rows; rows with a null key
make up one book.  Lines with the same number are taken in any order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators import kernels as K

BLOCK = 8192


def text_lines(books: DataFrame, keys: Sequence[str] = ("book_id",), text: str = "text") -> DataFrame:
    """The lines of cleaned texts. Null texts have none."""
    return books.where(F.col(text).isNotNull()).select(*keys, F.posexplode_outer(F.split(X.clean_text(F.col(text)), X.LINE_END)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def scan(rows: DataFrame, keys: Sequence[str], order: str = "line_no", last: dict[str, Column] | None = None, count: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """Adds for each name of `last` the latest non-null value in the rows before, and for each of `count` how many rows up to here fulfil it."""
    last, count = last or {}, count or {}
    here = ["__block", *keys]
    w = Window.partitionBy(*here).orderBy(order)
    before, up_to = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    own = {f"__own_{n}": c for n, c in last.items()} | {f"__is_{n}": F.coalesce(c, F.lit(False)).cast("long") for n, c in count.items()}
    r = rows.withColumn("__block", F.floor(F.col(order) / block)).withColumns(own)
    local = r.withColumns({n: F.last(f"__own_{n}", ignorenulls=True).over(before) for n in last} | {n: F.sum(f"__is_{n}").over(up_to) for n in count})
    ends = r.groupBy(*here).agg(*[F.max(F.when(F.col(f"__own_{n}").isNotNull(), F.struct(order, f"__own_{n}")))[f"__own_{n}"].alias(f"__own_{n}") for n in last], *[F.sum(f"__is_{n}").alias(f"__is_{n}") for n in count], F.count(F.lit(1)).alias("__n"))
    blocks = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*here, *[F.last(f"__own_{n}", ignorenulls=True).over(blocks).alias(f"__carried_{n}") for n in last], *[F.coalesce(F.sum(f"__is_{n}").over(blocks), F.lit(0)).alias(f"__carried_{n}") for n in count])
    joined = local.alias("a").join(carried.alias("b"), _same(here, "a", "b"))
    new = [F.coalesce(f"a.{n}", f"b.__carried_{n}").alias(n) for n in last] + [(F.col(f"a.{n}") + F.col(f"b.__carried_{n}")).alias(n) for n in count]
    return joined.select(*[F.col(f"a.`{c}`") for c in rows.columns], *new)


def _in_order(*columns: str) -> Column:
    """The lines of a group, an array in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct("line_no", *columns))), lambda s: s[columns[0]])


def _of_lists(function, kind: str):
    """By single rows, which Spark sends in batches of 100, not in Arrow's of 10,000 chapters."""
    return F.udf(function, kind, useArrow=False)


def reflow_lines(lines: DataFrame, keys: Sequence[str] = ("book_id",), block: int = BLOCK) -> DataFrame:
    """(keys, line_no, line): lines of one sentence joined, with the number of the first; one blank line of several, none at the edges.

    Between a line that surely begins anew (after a blank line or an end mark) and the
    next such line lies an island; whether a short heading stands alone depends only on
    the lines of its island, which is folded by itself.
    """
    line = X.collapse_ws(F.coalesce("line", F.lit("")))
    known = lines.select(*keys, "line_no", line.alias("line"))
    known = scan(known, keys, last={"__prior": F.col("line")}, block=block)
    prior, low = F.col("__prior"), F.col("line").rlike(r"^\p{IsLowercase}")
    ended = prior.rlike(r"[.?!;:]\z") & ~prior.rlike(r"(^|[^\p{L}\p{N}_])[A-Z]\.\z") & ~low
    begins = (F.col("line") == "") | prior.isNull() | (prior == "") | ended
    # blank lines: the last of a row of them stays, and none before the first or behind the last filled line
    flagged = known.withColumn("__begins", begins)
    islands = scan(flagged.where("line <> ''"), keys, count={"__island": F.col("__begins")}, last={"__filled": F.col("line_no")}, block=block)
    grouped = islands.groupBy(*keys, "__island").agg(F.min("line_no").alias("__first"), _in_order("line").alias("__lines"), F.min(F.when(F.col("__begins"), F.struct("line_no", "__filled", F.col("__prior").alias("prior")))).alias("__head"))
    folded = _of_lists(K.join_lines, "array<string>")(F.col("__lines"))
    joined = grouped.select(*keys, "__first", "__head", F.posexplode(folded).alias("__i", "line"))
    gap = (F.col("__i") == 0) & F.col("__head.__filled").isNotNull() & (F.col("__head.prior") == "")
    rows = F.when(gap, F.array(F.lit(""), F.col("line"))).otherwise(F.array("line"))
    # numbers that keep the order: an island has no more lines than it had before, and a blank line before it has its own
    at = F.col("__first") + F.col("__i") - F.when(F.col("line") == "", 1).otherwise(0)
    return joined.select(*keys, "__first", "__i", F.explode(rows).alias("line")).select(*keys, at.alias("line_no"), "line")


def chapters_of_lines(lines: DataFrame, titles: dict[int, str] | None = None, count: int = 38, block: int = BLOCK) -> DataFrame:
    """(book_id, chapter_no, title, body) under CHAPTER headings, each number following the last.

    Of a book only its headings meet in one row; a chapter is put together from its lines.
    """
    titles, heading = titles or {}, rf"(?iU)^{X.HEADING}\z"
    found = lines.where(F.col("line").rlike(heading)).select("book_id", "line_no", X.chapter_number(F.regexp_extract("line", heading, 1)).alias("n")).where("n is not null")
    listed = found.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "n"))).alias("found"))

    def chain(rows) -> list[dict]:
        kept = K.following([(int(r["n"]), int(r["line_no"])) for r in rows], count)
        ends = [at for _, at in kept[1:]] + [None]
        return [{"chapter_no": n, "first": at, "until": end} for (n, at), end in zip(kept, ends, strict=True)]

    spans = listed.select("book_id", F.explode(_of_lists(chain, "array<struct<chapter_no:int,first:bigint,until:bigint>>")(F.col("found"))).alias("c")).select("book_id", "c.*")
    sizes = lines.groupBy("book_id").agg(F.max("line_no").alias("__last"))
    spans = spans.alias("a").join(sizes.alias("b"), _same(["book_id"], "a", "b")).select("a.book_id", "chapter_no", "first", F.coalesce("until", F.col("__last") + 1).alias("until"))
    dealt = spans.withColumn("__block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("until") - 1) / block))))
    inside = (F.col("a.line_no") >= F.col("b.first")) & (F.col("a.line_no") < F.col("b.until"))
    own = lines.withColumn("__block", F.floor(F.col("line_no") / block)).alias("a").join(dealt.alias("b"), _same(["__block", "book_id"], "a", "b") & inside)
    chapters = own.groupBy("a.book_id", "chapter_no", "first").agg(F.transform(F.array_sort(F.collect_list(F.struct("a.line_no", F.coalesce("a.line", F.lit("")).alias("line")))), lambda s: s["line"]).alias("__lines"))

    parts = _of_lists(lambda n, rows: K.chapter_parts(rows[1:], titles.get(int(n))), "title string, body string")
    return chapters.select("book_id", "chapter_no", parts("chapter_no", "__lines").alias("p")).select("book_id", F.col("chapter_no").cast("int").alias("chapter_no"), "p.*")


def _packed(lines: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """(__key, __block, __lines, __long): one row for each block with its lines in order; __long: the book has lines in other blocks.

    Lines travel as arrays of their blocks, each behind its number in the block: keys
    aren't repeated for each line, and nothing but texts is shuffled.  Each line of a later
    block also tells the first block that the book is long.
    """
    own, digits = F.floor(F.col("line_no") / block), len(str(block - 1))
    place = F.lpad((F.col("line_no") - own * block).cast("string"), digits, "0")
    k = lines.select(F.struct(*keys).alias("__key"), F.concat(place, F.coalesce("line", F.lit(""))).alias("line"), own.alias("__own"))
    k = k.select("*", F.explode(F.when(F.col("__own") != 0, F.array("__own", F.lit(0).cast("long"))).otherwise(F.array("__own"))).alias("__block"))
    listed = F.collect_list(F.when(F.col("__own") == F.col("__block"), F.col("line")))
    return k.groupBy("__key", "__block").agg(F.transform(F.array_sort(listed), lambda s: F.substr(s, F.lit(digits + 1))).alias("__lines"), F.max(F.col("__own") != 0).alias("__long"))


#: States are followed over 2 ** ROUNDS blocks without a blank or indented line, as maps are composed over 1, 2, 4 ... blocks.
ROUNDS = 16


def _carried(packed: DataFrame, headers: frozenset[str], header: str | None, rounds: int) -> DataFrame:
    """(__key, __block, __state, __base, __more) of long books' blocks: the state before a block, the paragraphs begun before it, and the lines in later blocks of the last paragraph that begins in it."""
    maps = _of_lists(lambda rows: K.paragraph_maps(rows, headers, header), "map string, begun array<int>, held array<int>, before array<string>")
    b = packed.where("__long").select("__key", "__block", maps("__lines").alias("m")).select("__key", "__block", "m.*")
    w = Window.partitionBy("__key").orderBy("__block")
    before, nothing = w.rowsBetween(Window.unboundedPreceding, -1), F.lit("0123")
    for k in range(rounds):
        b = b.withColumn("__earlier", F.coalesce(F.lag("map", 1 << k).over(w), nothing)).withColumn("map", F.expr("translate(__earlier, '0123', map)"))
    b = b.withColumn("__state", F.substring(F.coalesce(F.lag("map").over(w), nothing), K.CLOSED + 1, 1).cast("int"))
    b = b.withColumn("__begun", F.get("begun", F.col("__state"))).withColumn("before", F.slice("before", 1, F.get("held", F.col("__state"))))
    b = b.withColumns({"__base": F.coalesce(F.sum("__begun").over(before), F.lit(0)), "__owner": F.last(F.when(F.col("__begun") > 0, F.col("__block")), ignorenulls=True).over(before)})
    own = F.struct(F.col("__block"), F.col("__state"), F.col("__base"), F.lit(None).cast("struct<no:bigint,lines:array<string>>").alias("__more"))
    back = F.struct(F.col("__owner").alias("__block"), F.lit(None).cast("int").alias("__state"), F.lit(None).cast("long").alias("__base"), F.struct(F.col("__block").alias("no"), F.col("before").alias("lines")).alias("__more"))
    told = b.select("__key", F.explode(F.when(F.size("before") > 0, F.array(own, back)).otherwise(F.array(own))).alias("c")).select("__key", "c.*")
    more = F.flatten(F.transform(F.array_sort(F.collect_list("__more")), lambda s: s["lines"]))
    return told.groupBy("__key", "__block").agg(F.max("__state").alias("__state"), F.max("__base").alias("__base"), more.alias("__more"))


def paragraphs_of_lines(lines: DataFrame, keys: Sequence[str] = ("book_id",), headers: Sequence[str] = (), header: str | None = None, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(keys, frag_idx, text): paragraphs end at blank lines, before indented lines, and before a capital at the left after an ended sentence.

    Page numbers and headers go first.  Texts are shuffled once, packed by blocks, and a
    block's paragraphs are put together where it lies.  Only of books with several
    blocks the states between them are found first, from the same shuffle; what a
    paragraph has in later blocks is sent to the one in which it begins.
    """
    names = frozenset(h.strip().upper() for h in headers)
    packed = _packed(lines, keys, block)
    carried = _carried(packed, names, header, rounds)
    here = (F.col("a.__key") == F.col("b.__key")) & (F.col("a.__block") == F.col("b.__block")) & F.col("a.__long")  # both sides read __long, else Spark leaves it out of one's shuffle and makes two
    texts = _of_lists(lambda rows, state, more: K.joined_paragraphs(rows, state, more, names, header), "array<string>")
    made = packed.alias("a").join(carried.alias("b"), here, "left").select("a.__key", "__base", texts("__lines", "__state", "__more").alias("__texts"))
    rows = made.select("__key", "__base", F.posexplode_outer("__texts").alias("__i", "text")).where("text is not null")
    return rows.select(*[F.col("__key")[k].alias(k) for k in keys], (F.coalesce("__base", F.lit(0)) + F.col("__i")).cast("int").alias("frag_idx"), "text")
