"""Sources: books, pages, transcripts, alignments, metadata, audio listings."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators import audio
from lectern.operators.structure import html_to_text

_TIMES = "start double, end double, timestamps struct<from:string,to:string>, offsets struct<from:bigint,to:bigint>, text string"
_SEGMENTS = f"array<struct<{re.sub(r'(^|, )(\w+) ', r'\1\2:', _TIMES)}>>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _spine(name: str, content: bytes) -> list[tuple[str, int, str]]:
    """(title, position, html) of a book's reading order; without one, of all its pages."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        package = None
        if "META-INF/container.xml" in names:
            roots = [e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _local(e.tag) == "rootfile"]
            package = next((r for r in roots if r in names), None)
        package = package or next((n for n in z.namelist() if n.endswith(".opf")), None)
        if package is None:
            return []
        tree = list(ElementTree.fromstring(z.read(package)).iter())
        title = next((" ".join(e.text.split()) for e in tree if _local(e.tag) == "title" and e.text and e.text.strip()), name)
        items = {e.get("id"): e.get("href") for e in tree if _local(e.tag) == "item" and "html" in (e.get("media-type") or e.get("href") or "").lower()}
        order = [items[e.get("idref")] for e in tree if _local(e.tag) == "itemref" and e.get("idref") in items] or list(items.values())
        paths = [posixpath.normpath(posixpath.join(posixpath.dirname(package), h.split("#")[0])) for h in order]
        return [(title, i, z.read(p).decode("utf-8", "replace")) for i, p in enumerate(paths) if p in names]


def epub_pages(files: DataFrame) -> DataFrame:
    """book_id (the file's path), title, spine_pos, html of files (path, content); an unreadable book or one without pages is a row without html."""

    def read(path: str, content: bytes) -> list[tuple[str, str, int, str | None]]:
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        try:
            rows = _spine(stem, bytes(content))
        except (zipfile.BadZipFile, ElementTree.ParseError):
            rows = []
        return [(path, *r) for r in rows or [(stem, 0, None)]]

    pages = F.udf(read, "array<struct<book_id:string,title:string,spine_pos:int,html:string>>", useArrow=False)  # by 100 rows: Arrow's batches hold 10,000 books
    return files.select(F.explode_outer(pages("path", "content")).alias("page")).select("page.*")


def read_epub_pages(spark: SparkSession, path: str) -> DataFrame:
    return epub_pages(spark.read.format("binaryFile").load(path))


def epub_texts(pages: DataFrame) -> DataFrame:
    """book_id, title, text, problem: clean pages in reading order, two line ends between them, blank ones dropped."""
    rows = F.array_sort(F.collect_list(F.struct("spine_pos", html_to_text(F.col("html")).alias("text"))))
    shown = F.filter(F.transform(rows, lambda p: p["text"]), lambda t: t.isNotNull() & (t != ""))
    out = pages.groupBy("book_id", "title").agg(X.clean_text(F.array_join(shown, "\n\n")).alias("text"))
    return out.withColumn("problem", F.when(F.col("text") == "", "no text"))


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    return epub_texts(read_epub_pages(spark, path))


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """source, value: a file each; with `lines`, a JSON object on each line that names its own `source`, as large sets come in few files."""
    files = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("source"), "value")
    return files.withColumn("source", F.coalesce(F.get_json_object("value", "$.source"), "source")) if lines else files


def read_book_text(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """book_id, text: a file each; with `lines`, objects of `source` and `text`."""
    text = F.get_json_object("value", "$.text") if lines else F.col("value")
    return read_documents(spark, path, lines).select(F.col("source").alias("book_id"), text.alias("text"))


def read_book_lines(spark: SparkSession, path: str) -> DataFrame:
    """book_id, line_no, line: the lines of plain text files, also of files that several tasks read.

    A line is numbered within its split of the file, and the splits by their lines; no row
    holds a file.  Lines are cleaned, and end wherever `str.splitlines` ends them.  An empty
    file has no lines.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("book_id"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"), "value")
    lines = read.select("book_id", "at", "row", F.posexplode(F.split(X.clean_text(F.col("value")), X.LINE_END)).alias("piece", "line"))
    own = lines.withColumn("n", F.row_number().over(Window.partitionBy("book_id", "at").orderBy("row", "piece")))
    sizes = lines.groupBy("book_id", "at").agg(F.count(F.lit(1)).alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("book_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(sizes.select("book_id", "at", before.alias("before")), ["book_id", "at"]).select("book_id", (F.col("before") + F.col("n") - 1).alias("line_no"), "line")


def route_sources(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds `route`: pdf, epub or markdown by the suffix, else null, and then a `problem`."""
    suffix = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    route = F.when(suffix.isin("pdf", "epub"), suffix).when(suffix.isin("md", "markdown"), "markdown")
    return files.withColumn("route", route).withColumn("problem", F.when(route.isNull(), "unsupported source"))


def read_markdown(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    books = read_book_text(spark, path, lines)
    clean = books.select("book_id", F.posexplode_outer(X.split_sentences_simple(X.clean_markdown(F.col("text")))).alias("frag_idx", "text"))
    return clean.where("frag_idx is not null")  # outer: an inner explode tests the array's size first, and cleans each text twice


def read_transcripts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """source, seg_idx, start, end, text, problem from {segments}, {transcription} or a bare list; times in seconds, time stamps or milliseconds.

    Blank segments and those that end before they start go; a transcript of which
    nothing is left is one row with a problem.
    """
    raw = read_documents(spark, path, lines)
    bare = F.when(F.ltrim("value").startswith("["), F.from_json("value", _SEGMENTS))
    parsed = F.from_json("value", f"struct<segments:{_SEGMENTS},transcription:{_SEGMENTS}>")
    found = raw.select("source", F.coalesce(bare, parsed["segments"], parsed["transcription"]).alias("found"))
    usable = found.select("source", F.filter(F.transform("found", _segment), lambda s: (s["text"] != "") & (s["end"] >= s["start"])).alias("usable"))
    problem = F.when(F.coalesce(F.size("usable"), F.lit(0)) <= 0, "no usable segment")
    return usable.select("source", problem.alias("problem"), F.explode_outer("usable").alias("s")).select("source", "s.*", "problem")


def _segment(s: Column, pos: Column) -> Column:
    start = F.coalesce(s["start"], X.timestamp_seconds(s["timestamps"]["from"]), s["offsets"]["from"] / 1000)
    end = F.coalesce(s["end"], X.timestamp_seconds(s["timestamps"]["to"]), s["offsets"]["to"] / 1000)
    return F.struct(pos.alias("seg_idx"), start.alias("start"), end.alias("end"), X.collapse_ws(s["text"]).alias("text"))


def read_verbose_transcripts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """source, text, segments, words of verbose transcripts; blank items dropped, text from the segments where it is missing."""
    item = "array<struct<start:double,end:double,text:string,word:string>>"
    raw = _objects(spark, path, lines, f"text:string,segments:{item},words:{item}")

    def items(c: str):
        named = F.transform(F.coalesce(F.col(c), F.array().cast(item)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), X.collapse_ws(F.coalesce(x["word"], x["text"])).alias("text")))
        return F.filter(named, lambda x: x["text"] != "")

    out = raw.select("source", "text", items("segments").alias("segments"), items("words").alias("words"))
    return out.withColumn("text", F.coalesce(F.nullif(X.collapse_ws(F.col("text")), F.lit("")), F.array_join(F.transform("segments", lambda s: s["text"]), " ")))


def _objects(spark: SparkSession, path: str, lines: bool, fields: str) -> DataFrame:
    return read_documents(spark, path, lines).select("source", F.from_json("value", f"struct<{fields}>").alias("o")).select("source", "o.*")


def read_alignments(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """source, frag_idx, id, begin, end, text of aligner files."""
    raw = _objects(spark, path, lines, "fragments:array<struct<id:string,begin:string,end:string,lines:array<string>>>")
    raw = raw.select("source", F.posexplode("fragments").alias("frag_idx", "f"))
    return raw.select("source", "frag_idx", "f.id", F.col("f.begin").try_cast("double").alias("begin"), F.col("f.end").try_cast("double").alias("end"), F.trim(F.array_join("f.lines", " ")).alias("text"))


def read_audiobook_metadata(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, spine): chapters (book_id, pos, title, spine_index, offset) and spine parts (book_id, spine_index, duration)."""
    raw = _objects(spark, path, lines, "spine:array<struct<duration:double>>,chapters:array<struct<title:string,spine:int,offset:double>>").withColumnRenamed("source", "book_id")
    entries = raw.select("book_id", F.posexplode_outer("chapters").alias("pos", "c")).select("book_id", "pos", "c.title", F.col("c.spine").alias("spine_index"), "c.offset")
    return entries, raw.select("book_id", F.posexplode_outer("spine").alias("spine_index", "s")).select("book_id", "spine_index", "s.duration")


def list_audio_parts(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return audio.rank_parts(files)
