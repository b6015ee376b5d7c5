"""Registered queries of sources and sinks: the given tables are written to the shared folder in the form of files, and read back."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lectern.functions import text as X
from lectern.operators import audio as A
from lectern.operators import matching as M
from lectern.plans.queries import ORACLES, _CLEAN, _ENTRIES, _TIMED, _TIMELINE, _WS, BOUNDS, FRAGMENTS, PARTS, POINTS, _entries, _event_times, book_units, books, folder, fragments, parts, query, table
from lectern.sources import readers, sinks


def _lines(objects: DataFrame, spark: SparkSession, name: str) -> str:
    path = folder(spark, name)
    objects.write.text(path)
    return path


# -- sources ----------------------------------------------------------------------------------------


def _turn_list(item: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))), lambda x: x["item"])


def _stamp(half: Column) -> Column:
    """Seconds, which end in a half, as a time stamp."""
    k = F.floor(half).cast("long")
    return F.format_string("%02d:%02d,500", F.floor(k / 60).cast("long"), k % 60)


_SAID = "CASE WHEN conv_id % 10 = 9 THEN ' ' ELSE '  ' || replace(text, ' ', chr(10) || ' ') END"
_TURNS = f"""turns AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, trim(regexp_replace({_SAID}, '{_WS}', ' ', 'g'), ' ') AS said FROM conversations)"""


def _said(s, d) -> DataFrame:
    said = F.when(F.col("conv_id") % 10 == 9, " ").otherwise(F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("\n "))))
    return table(s, d, "conversations").select("conv_id", "turn", said.alias("said"))


@query(f"""WITH {_TURNS}, u AS (SELECT CAST(conv_id AS VARCHAR) AS source, CAST(pos AS INTEGER) AS seg_idx, turn * 10 + 0.5 AS start, turn * 10 + 5.5 AS "end", said AS text FROM turns WHERE said <> '' AND turn % 5 <> 4)
SELECT c.source, seg_idx, CAST(start AS DOUBLE) AS start, CAST("end" AS DOUBLE) AS "end", text, CASE WHEN u.source IS NULL THEN 'no usable segment' END AS problem FROM (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS source FROM conversations) c LEFT JOIN u ON c.source = u.source""")
def read_transcripts(s, d):
    """Each conversation as a transcript, by turns with seconds, time stamps or milliseconds; each fifth turn ends before it starts."""
    start = F.col("turn") * 10 + F.lit(0.5)
    end = start + F.when(F.col("turn") % 5 == 4, -1).otherwise(5)
    seconds = F.struct(start.alias("start"), end.alias("end"), F.col("said").alias("text"))
    stamps = F.struct(F.struct(_stamp(start).alias("from"), _stamp(F.greatest(end, F.lit(0.5))).alias("to")).alias("timestamps"), F.col("said").alias("text"))
    millis = F.struct(F.struct((start * 1000).cast("long").alias("from"), (end * 1000).cast("long").alias("to")).alias("offsets"), F.col("said").alias("text"))
    source = F.col("conv_id").cast("string").alias("source")

    def form(k: int, name: str, item: Column) -> DataFrame:
        return _said(s, d).where(F.col("conv_id") % 3 == k).groupBy("conv_id").agg(_turn_list(item).alias(name)).select(F.to_json(F.struct(source, name)).alias("value"))

    forms = form(0, "segments", seconds).unionByName(form(1, "transcription", stamps)).unionByName(form(2, "transcription", millis))
    return readers.read_transcripts(s, _lines(forms, s, "transcripts"), lines=True)


@query(f"""WITH {_TURNS} SELECT CAST(conv_id AS VARCHAR) AS source, CASE WHEN conv_id % 2 = 0 THEN 'All of ' || conv_id ELSE coalesce(string_agg(said, ' ' ORDER BY turn) FILTER (said <> ''), '') END AS text, count(*) FILTER (said <> '') AS segments, coalesce(string_agg(said, ' ' ORDER BY turn) FILTER (said <> ''), '') AS words FROM turns GROUP BY conv_id""")
def read_verbose_transcripts(s, d):
    """Conversations with turns as segments and their words; half of them have no text of their own."""
    segment = F.struct(F.col("turn").cast("double").alias("start"), (F.col("turn") + 1.0).alias("end"), F.col("said").alias("text"))
    words = F.transform(F.split("said", " "), lambda w: F.struct(F.col("turn").cast("double").alias("start"), F.when(F.length(w) % 2 == 0, w).alias("word"), w.alias("text")))
    text = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("All  of\n"), F.col("conv_id").cast("string"))).otherwise(" ").alias("text")
    objects = _said(s, d).groupBy("conv_id").agg(_turn_list(segment).alias("segments"), F.flatten(_turn_list(words)).alias("words"))
    value = F.to_json(F.struct(F.col("conv_id").cast("string").alias("source"), text, "segments", "words")).alias("value")
    out = readers.read_verbose_transcripts(s, _lines(objects.select(value), s, "verbose"), lines=True)
    return out.select("source", "text", F.size("segments").cast("long").alias("segments"), F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("words"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS source, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS frag_idx, 'f' || lpad(CAST(turn + 1 AS VARCHAR), 6, '0') AS id, CAST(turn * 2.5 AS DOUBLE) AS "begin", CASE WHEN turn % 4 <> 3 THEN CAST((turn + 1) * 2.5 AS DOUBLE) END AS "end", trim(role || ' ' || text, ' ') AS text FROM conversations""")
def read_alignments(s, d):
    """Conversations as aligner files, a turn for each fragment; each fourth has an end that is no number."""
    end = F.when(F.col("turn") % 4 == 3, "open").otherwise(((F.col("turn") + 1) * 2.5).cast("string"))
    item = F.struct(X.fragment_id(F.col("turn") + 1).alias("id"), (F.col("turn") * 2.5).cast("string").alias("begin"), end.alias("end"), F.array("role", "text").alias("lines"))
    objects = table(s, d, "conversations").groupBy("conv_id").agg(_turn_list(item).alias("fragments"))
    value = F.to_json(F.struct(F.col("conv_id").cast("string").alias("source"), "fragments")).alias("value")
    return readers.read_alignments(s, _lines(objects.select(value), s, "alignments"), lines=True)


@query(f"""WITH {PARTS}, {_ENTRIES} SELECT CAST(book_id AS VARCHAR) AS book_id, CAST(pos AS INTEGER) AS pos, title, CAST(spine_index AS INTEGER) AS spine_index, CAST("offset" AS DOUBLE) AS "offset", CASE WHEN spine_index = 0 THEN 60.0::DOUBLE ELSE 75.5::DOUBLE END AS duration FROM entries""")
def read_audiobook_metadata(s, d):
    """Each order's chapters and two spine parts."""
    item = F.struct("title", F.col("spine_index").alias("spine"), "offset")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))), lambda x: x["item"]).alias("chapters")
    spine = F.array(F.struct(F.lit(60.0).alias("duration")), F.struct(F.lit(75.5).alias("duration"))).alias("spine")
    objects = _entries(s, d).groupBy("book_id").agg(listed)
    value = F.to_json(F.struct(F.col("book_id").cast("string").alias("source"), spine, "chapters")).alias("value")
    entries, spines = readers.read_audiobook_metadata(s, _lines(objects.select(value), s, "metadata"), lines=True)
    return entries.join(spines, ["book_id", "spine_index"], "left")


@query(f"""WITH l AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS l FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), '&', 'and'), chr(10)) AS a FROM documents WHERE doc_id % 50 <> 7)),
c AS (SELECT doc_id, i, trim(regexp_replace(l, '{_WS}', ' ', 'g'), ' ') AS l FROM l), t AS (SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (l <> '') || chr(10) || chr(10), '') || 'The end' AS text FROM c GROUP BY 1)
SELECT CAST(d.doc_id AS VARCHAR) AS book_id, 'Book ' || d.doc_id AS title, coalesce({_CLEAN.format('t.text')}, '') AS text, CASE WHEN t.text IS NULL THEN 'no text' END AS problem FROM documents d LEFT JOIN t USING (doc_id)""")
def read_epubs(s, d):
    """Each document as a book of two pages, the second listed first; each fiftieth book has blank pages."""
    escaped = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("and")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<style>p {}</style><p>"), F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    blank = F.col("book_id") % 50 == 7
    made = books(s, d).select(F.col("book_id").cast("string").alias("path"), F.when(blank, "<p> </p>").otherwise(page).alias("page"), F.when(blank, "").otherwise("<h1>The <b>end</b></h1>").alias("last"))
    return readers.epub_texts(readers.epub_pages(made.select("path", _epub("path", "page", "last").alias("content"))))


def _epub_bytes(n: str, p: str, e: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", f'<package><metadata><title>Book\n {n}</title></metadata><manifest><item id="e" href="e.html" media-type="application/xhtml+xml"/><item id="p" href="p.html" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="p"/><itemref idref="e"/></spine></package>')
        z.writestr("O/p.html", p)
        z.writestr("O/e.html", e)
    return out.getvalue()


_epub = F.udf(_epub_bytes, BinaryType(), useArrow=False)


@query("""WITH u AS (SELECT page_id, url || ['.pdf', '.EPUB', '.markdown', '.txt', '.Md'][page_id % 5 + 1] AS path FROM pages)
SELECT page_id, path, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' WHEN 2 THEN 'markdown' WHEN 4 THEN 'markdown' END AS route, CASE WHEN page_id % 5 = 3 THEN 'unsupported source' END AS problem FROM u""")
def route_sources(s, d):
    suffix = F.element_at(F.array(*map(F.lit, (".pdf", ".EPUB", ".markdown", ".txt", ".Md"))), (F.col("page_id") % 5 + 1).cast("int"))
    return readers.route_sources(table(s, d, "pages").select("page_id", F.concat("url", suffix).alias("path")))


@query(f"""WITH {PARTS}, f AS (SELECT 'audio/' || book_id || '/' || CASE WHEN book_id % 3 = 0 AND part_no % 2 = 1 THEN 'Part ' || (10 - part_no) || '.mp3' WHEN book_id % 3 < 2 AND part_no % 3 > 0 THEN lpad(CAST(20 - part_no AS VARCHAR), 3, '0') || ' track.mp3' ELSE 'track ' || part_no || '.mp3' END AS path, book_id, part_no FROM parts),
t AS (SELECT *, CASE WHEN path LIKE '%/Part %' THEN 0 WHEN regexp_matches(path, '/\\d{{3}} ') THEN 1 ELSE 2 END AS tier, coalesce(TRY_CAST(regexp_extract(path, '/(?:Part )?(\\d+)[^/]*$', 1) AS INTEGER), 10000) AS number FROM f),
b AS (SELECT *, min(tier) OVER (PARTITION BY book_id) AS best FROM t) SELECT path, 'audio/' || book_id || '/' AS dir, regexp_extract(path, '([^/]*)$', 1) AS name, number, CAST(row_number() OVER (PARTITION BY book_id ORDER BY number, path) AS INTEGER) AS part_no FROM b WHERE tier = best""")
def rank_parts(s, d):
    """Each order's parts as audio files: 'Part n' files, numbered ones and others mixed."""
    b, n = F.col("book_id"), F.col("part_no")
    name = F.when((b % 3 == 0) & (n % 2 == 1), F.format_string("Part %d.mp3", 10 - n)).when((b % 3 < 2) & (n % 3 > 0), F.format_string("%03d track.mp3", 20 - n)).otherwise(F.format_string("track %d.mp3", n))
    return A.rank_parts(parts(s, d).select(F.concat(F.lit("audio/"), b.cast("string"), F.lit("/"), name).alias("path")))


@query(f"""WITH {PARTS}, s AS (SELECT book_id, part_no AS number, part_no % 3 AS spine_index, part_no * 5.0::DOUBLE AS start, CASE WHEN part_no % 7 <> 0 THEN part_no * 5.0::DOUBLE + duration - 25 END AS "end" FROM parts)
SELECT *, CASE WHEN spine_index = 2 THEN 'spine out of range' ELSE 'no duration' END AS problem FROM s WHERE spine_index = 2 OR "end" IS NULL OR "end" <= start""")
def validate_spans(s, d):
    n = F.col("part_no")
    spans = parts(s, d).select("book_id", n.alias("number"), (n % 3).alias("spine_index"), (n * 5.0).alias("start"), F.when(n % 7 != 0, n * 5.0 + F.col("duration") - 25).alias("end"))
    spine = spans.select("book_id").distinct().select("book_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("spine_index"))
    return A.span_problems(spans, spine)


# -- sinks ------------------------------------------------------------------------------------------


def _by_tens(s, d) -> DataFrame:
    return fragments(s, d).withColumn("chapter_no", F.floor(F.col("frag_idx") / 10).cast("int") + 1)


@query(f"WITH {FRAGMENTS} SELECT book_id, 'chapter_' || lpad(CAST(frag_idx // 10 + 1 AS VARCHAR), CAST(greatest(3, length(CAST(frag_idx // 10 + 1 AS VARCHAR))) AS INTEGER), '0') AS name, string_agg(text, chr(10) ORDER BY frag_idx) AS text FROM fragments GROUP BY 1, 2")
def write_chapter_text(s, d):
    """Ten fragments a chapter."""
    path = folder(s, "chapters")
    sinks.write_chapter_text(_by_tens(s, d), path)
    return s.read.schema("book_id long, name string, text string").json(path).select("book_id", "name", "text")


@query(f"WITH {FRAGMENTS} SELECT CAST(book_id AS VARCHAR) AS book_id, string_agg(text, chr(10) ORDER BY frag_idx) AS text FROM fragments GROUP BY 1")
def write_book_text(s, d):
    path = folder(s, "books")
    sinks.write_book_text(_by_tens(s, d), path)
    return readers.read_book_text(s, path, lines=True)


@query(f"""WITH {PARTS}, {FRAGMENTS}, {BOUNDS}, {_TIMED}, {_TIMELINE}, b AS (SELECT * FROM timeline WHERE book_id IN (SELECT doc_id FROM documents)), w AS (SELECT book_id, round_even(max(start + duration), 3) AS whole FROM b GROUP BY 1)
SELECT b.book_id, whole, b.part_no, 'Unit ' || lpad(CAST(b.part_no AS VARCHAR), 3, '0') AS title, 'f' || lpad(CAST(frag_idx + 1 AS VARCHAR), 6, '0') AS id, text, round_even(start + "begin", 3) AS "begin", round_even(start + "end", 3) AS "end" FROM b JOIN w USING (book_id) LEFT JOIN timed t ON t.book_id = b.book_id AND t.part_no = b.part_no""")
def write_manifest(s, d):
    """The nested manifest of all books, written, read and laid flat."""
    path = folder(s, "manifest")
    chapters, paragraphs = book_units(s, d)
    made = M.manifest(chapters, paragraphs)
    sinks.write_manifest(made, path)
    rows = s.read.schema(made.schema).json(path).select("book_id", F.col("duration").alias("whole"), F.explode("chapters").alias("c"))
    rows = rows.select("book_id", "whole", "c.part_no", "c.title", F.explode_outer("c.paragraphs").alias("p"))
    return rows.select("book_id", "whole", "part_no", "title", "p.id", "p.text", "p.begin", "p.end")


@query(f"""WITH {POINTS}, a AS (SELECT user_id AS book_id, CAST(event_id % 3 + 1 AS INTEGER) AS chapter_no, t AS clip_start, CASE WHEN event_id % 4 > 0 THEN event_id % 97 END AS frag_idx, value FROM ev)
SELECT book_id, chapter_no, clip_start, frag_idx, CASE WHEN frag_idx IS NOT NULL THEN clip_start + 1 END AS time, CASE WHEN frag_idx IS NOT NULL THEN value END AS score FROM a""")
def write_anchors(s, d):
    """Events as anchors of clips, of which each fourth was skipped; written, read and laid flat."""
    anchors = _event_times(s, d).select(F.col("user_id").alias("book_id"), (F.col("event_id") % 3 + 1).cast("int").alias("chapter_no"), F.col("t").alias("clip_start"), F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 97).alias("frag_idx"), (F.col("t") + 1).alias("time"), F.col("value").alias("score"), F.col("event_id").cast("string").alias("text"))
    path = folder(s, "anchors")
    sinks.write_anchors(anchors, path)
    back = s.read.schema("book_id long, chapter_no int, anchors array<struct<clip_start:double,frag_idx:long,time:double,score:double,text:string>>, skipped array<double>").json(path)
    matched = back.select("book_id", "chapter_no", F.explode("anchors").alias("a")).select("book_id", "chapter_no", "a.clip_start", "a.frag_idx", "a.time", "a.score")
    return matched.unionByName(back.select("book_id", "chapter_no", F.explode("skipped").alias("clip_start")), allowMissingColumns=True)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 2 ELSE 1 END AS price FROM orders")
def incremental_write(s, d):
    """Orders by status as units: those of F are there, the others are appended, and O is then forced anew."""
    path, o = folder(s, "units"), table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    sinks.write_units(o.where("o_orderstatus = 'F'"), path, ("o_orderstatus",))
    rest = A.incremental(o, s.read.parquet(path), ["o_orderstatus"]).withColumn("price", F.col("price") + 1)
    sinks.write_units(rest, path, ("o_orderstatus",))
    forced = o.where("o_orderstatus = 'O'").withColumn("price", F.col("price") + 2)
    sinks.write_units(forced, path, ("o_orderstatus",), force=True)
    return s.read.parquet(path)


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders")
def commit_units(s, d):
    """Orders in units of their status and key modulo 10: half of the units first, then all that aren't there, then some again with a new price."""
    by = ("o_orderstatus", "unit")
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 10).cast("int").alias("unit"), F.col("o_totalprice").alias("price"))
    path = folder(s, "units")
    sinks.commit_units(o.where("unit < 5"), path, by)
    sinks.commit_units(o.withColumn("price", F.when(F.col("unit") < 5, -1.0).otherwise(F.col("price"))), path, by)
    sinks.commit_units(o.where("unit in (0, 5)").withColumn("price", F.col("price") + 1), path, by, force=True)
    return sinks.read_units(s, path, by).drop("unit")


_MD = ORACLES["clean_markdown"]
_SIMPLE = ORACLES["split_sentences_simple"].replace("FROM documents", "FROM md").replace("WITH l AS", "l AS").replace("SELECT doc_id AS book_id", "SELECT CAST(doc_id AS VARCHAR) AS book_id")


@query(f"WITH md AS (SELECT doc_id, out AS text FROM ({_MD})), {_SIMPLE}")
def read_markdown(s, d):
    """Each document as a Markdown text, an object on each line."""
    t = F.replace("text", F.lit("\n"), F.lit("\n- **a** `b` [c](d) [e][1] "))
    marked = F.concat(F.lit("# "), F.replace(t, F.lit(". "), F.lit(".\n[1]: http://x\n> ")))
    objects = books(s, d).select(F.to_json(F.struct(F.col("book_id").cast("string").alias("source"), marked.alias("text"))).alias("value"))
    return readers.read_markdown(s, _lines(objects, s, "markdown"), lines=True)
