"""Registered queries and their SQL twins: each applies one operator to whole tables.

Roles: `documents` are books, `lineitem` gives their audio parts (numbered within an
order, l_quantity seconds long), `events` are playback events and anchors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators import audio as A
from lectern.operators import lines as L
from lectern.operators import matching as M
from lectern.operators import structure as S
from lectern.operators import timeline as T
from lectern.operators.tasks import dealt, folder, stored  # noqa: F401 - files takes folder from here
from lectern.streaming import playback as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that are worth a task of their own, where each is searched by many patterns.
TASK_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table, of which a scan makes fewer tasks than the session has cores, dealt over the cores. Larger ones stay as they are read."""
    size, cores = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < cores * TASK_BYTES else df


def books(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").select(F.col("doc_id").alias("book_id"), "text"))


def parts(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("book_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    lines = table(s, d, "lineitem").withColumnRenamed("l_orderkey", "book_id")  # first, so that joins by book find the parts dealt by it
    return dealt(lines, "book_id").select("book_id", F.row_number().over(w).alias("part_no"), F.col("l_quantity").cast("double").alias("duration"))


def fragments(s: SparkSession, d: str) -> DataFrame:
    return S.book_fragments(books(s, d)).drop("n")


def book_parts(s: SparkSession, d: str) -> DataFrame:
    return parts(s, d).join(books(s, d).select("book_id"), "book_id", "left_semi")


def bounds(s: SparkSession, d: str) -> DataFrame:
    counts = books(s, d).select("book_id", F.size(X.split_sentences(F.col("text"))).cast("long").alias("n"))
    return T.allocation_bounds(counts, parts(s, d))


# -- shared SQL ---------------------------------------------------------------------------------

PARTS = """parts AS (SELECT l_orderkey AS book_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS part_no, CAST(l_quantity AS DOUBLE) AS duration FROM lineitem)"""
_SHORT = r"(?i)(^|[^\p{L}\p{N}_])([A-Z]|Dr|Mr|Mrs|Ms|Prof|St|Jr|Sr|vs|cf|e\.g|i\.e)\.( )"
_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_HOLD = rf"'{_SHORT}', '\1\2' || chr(1) || '\3', 'g'"
FRAGMENTS = rf"""lines AS (SELECT doc_id, i, trim(regexp_replace(l, '{_WS}', ' ', 'g'), ' ') AS line FROM (
  SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS l FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS a FROM documents WHERE text IS NOT NULL))),
pieces AS (SELECT doc_id, i, CASE WHEN length(line) <= 100 AND regexp_matches(line, '^(\d+[.)]\s+)?[A-Z]') AND NOT regexp_matches(line, '[.?!]$') THEN [line]
  ELSE [replace(x, chr(1), '.') FOR x IN string_split(regexp_replace(regexp_replace(regexp_replace(line, {_HOLD}), {_HOLD}), '([.!?]["'')\]}}]*) ', '\1' || chr(2), 'g'), chr(2))] END AS p FROM lines),
flat AS (SELECT doc_id, i, unnest(range(len(p))) AS j, unnest(p) AS text FROM pieces),
fragments AS (SELECT doc_id AS book_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS frag_idx, text FROM flat WHERE regexp_matches(text, '[A-Za-z]'))"""
BOUNDS = """counts AS (SELECT doc_id AS book_id, (SELECT count(*) FROM fragments f WHERE f.book_id = d.doc_id) AS n FROM documents d),
p1 AS (SELECT p.book_id, p.part_no, p.duration, c.n, row_number() OVER w AS i, count(*) OVER (PARTITION BY p.book_id) AS k, sum(duration) OVER (PARTITION BY p.book_id) AS total, sum(duration) OVER (PARTITION BY p.book_id ORDER BY part_no) AS cum
  FROM parts p JOIN counts c USING (book_id) WINDOW w AS (PARTITION BY p.book_id ORDER BY part_no)),
p2 AS (SELECT *, CASE WHEN n <= 0 THEN 'no fragments' WHEN total <= 0 THEN 'no duration' WHEN n < k THEN 'fewer fragments than parts' END AS problem, least(round_even(n * cum / nullif(total, 0), 0), n - (k - i)) - i AS t FROM p1),
p3 AS (SELECT *, CASE WHEN problem IS NULL THEN CASE WHEN i = k THEN n ELSE CAST(i + greatest(0, max(t) OVER (PARTITION BY book_id ORDER BY part_no)) AS BIGINT) END END AS end_idx FROM p2),
bounds AS (SELECT book_id, part_no, duration, CASE WHEN problem IS NULL THEN coalesce(lag(end_idx) OVER (PARTITION BY book_id ORDER BY part_no), 0) END AS start_idx, end_idx, problem FROM p3)"""
POINTS = "ev AS (SELECT user_id, event_id, epoch(ts) - (SELECT min(epoch(ts)) FROM events) AS t, value FROM events)"

# -- scalars --------------------------------------------------------------------------------------


def _scalar(sql: str, source: str = "documents", key: str = "doc_id"):
    def add(f: Callable[[], Column]):
        def run(s: SparkSession, d: str) -> DataFrame:
            return table(s, d, source).select(key, f().alias("out"))

        run.__name__ = f.__name__
        return query(f"SELECT {key}, {sql} AS out FROM {source}")(run)

    return add


_CLEAN = "translate(replace(replace(regexp_replace({}, '\\r\\n?', chr(10), 'g'), chr(12), chr(10) || chr(10)), '—', ' - '), '‘’“”–' || chr(145) || chr(146), '''''\"\"-')"
_DIRTY_SQL = "replace(replace(replace(text, ',', '’,'), ' de ', ' — '), '. ', '.' || chr(12))"


def _dirty() -> Column:
    return F.replace(F.replace(F.replace("text", F.lit(","), F.lit("’,")), F.lit(" de "), F.lit(" — ")), F.lit(". "), F.lit(".\f"))


@_scalar(_CLEAN.format(_DIRTY_SQL))
def clean_text():
    return X.clean_text(_dirty())


@_scalar(f"trim(regexp_replace(text, '{_WS}', ' ', 'g'), ' ')")
def collapse_ws():
    return X.collapse_ws(F.col("text"))


@_scalar("regexp_replace(upper(replace(" + _CLEAN.format("text") + ", 'ß', 'ss')), '[^A-Z0-9]', '', 'g')")
def normalize_title():
    return X.normalize_title(F.col("text"))


@_scalar("trim(regexp_replace(lower(" + _CLEAN.format("text") + "), '[^a-z0-9]+', ' ', 'g'), ' ')")
def normalize_match():
    return X.normalize_match(F.col("text"))


@query(f"WITH {FRAGMENTS} SELECT * FROM fragments")
def split_sentences(s, d):
    return fragments(s, d)


@query(rf"""WITH l AS (SELECT doc_id, i, trim(regexp_replace(l, '{_WS}', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))),
p AS (SELECT doc_id, i, CASE WHEN length(line) <= 80 AND regexp_matches(line, '^(\d+\.\s+)?[A-Z]') AND NOT regexp_matches(line, '[.?!]$') THEN [line]
  ELSE string_split(regexp_replace(regexp_replace(line, '([.!?]) (["'']?[A-Z0-9])', '\1' || chr(2) || '\2', 'g'), '([.!?]) (["'']?[A-Z0-9])', '\1' || chr(2) || '\2', 'g'), chr(2)) END AS p FROM l),
f AS (SELECT doc_id, i, unnest(range(len(p))) AS j, unnest(p) AS text FROM p)
SELECT doc_id AS book_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS frag_idx, text FROM f WHERE text <> ''""")
def split_sentences_simple(s, d):
    return S.book_fragments(books(s, d), X.split_sentences_simple).drop("n")


_MD_SQL = "'# ' || replace(replace(text, chr(10), chr(10) || '- **a** `b` [c](d) [e][1] '), '. ', '.' || chr(10) || '[1]: http://x' || chr(10) || '> ')"


@_scalar(
    r"""array_to_string([regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^#{1,6}\s*', ''), '^>\s*', ''), '^\s*[-*]\s+', ''), '\*\*(.+?)\*\*', '\1', 'g'), '`(.+?)`', '\1', 'g'), '\(\[([^\]]+)\]\[\d+\]\)', '\1', 'g'), '\[([^\]]+)\]\[\d+\]', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g')
FOR x IN [trim(y, ' ' || chr(9)) FOR y IN string_split(""" + _MD_SQL + r""", chr(10))] IF x <> '' AND NOT regexp_full_match(x, '\[\d+\]:\s+\S+.*')], chr(10))"""
)
def clean_markdown():
    t = F.replace("text", F.lit("\n"), F.lit("\n- **a** `b` [c](d) [e][1] "))
    return X.clean_markdown(F.concat(F.lit("# "), F.replace(t, F.lit(". "), F.lit(".\n[1]: http://x\n> "))))


@_scalar("CAST(event_id % 50 AS DOUBLE) * 3600 + CAST(event_id % 60 AS DOUBLE) * 60 + CAST(event_id % 59 AS DOUBLE) + 0.25", "events", "event_id")
def timestamp_seconds():
    e = F.col("event_id")
    return X.timestamp_seconds(F.format_string("%d:%02d:%02d,250", e % 50, e % 60, e % 59))


@_scalar("CASE WHEN value IS NULL OR value < 3600 THEN format('{}:{:02d}', CAST(floor(greatest(coalesce(value, 0), 0) / 60) AS BIGINT), CAST(floor(greatest(coalesce(value, 0), 0)) AS BIGINT) % 60) ELSE format('{}:{:02d}:{:02d}', CAST(floor(value / 3600) AS BIGINT), CAST(floor(value) AS BIGINT) % 3600 // 60, CAST(floor(value) AS BIGINT) % 60) END", "events", "event_id")
def format_clock():
    return X.format_clock(F.col("value"))


_WORDS = ", ".join(f"'{w}': {n}" for n, w in enumerate(X.number_words(), 1))


@_scalar(f"CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS INTEGER) ELSE map {{{_WORDS}}}[upper(['one', 'twenty-two', 'Thirty Eight', 'forty', 'nine'][CAST(p_partkey % 5 + 1 AS INTEGER)].replace('-', ' '))] END", "part", "p_partkey")
def chapter_number():
    k = F.col("p_partkey")
    words = F.element_at(F.array(*map(F.lit, ["one", "twenty-two", "Thirty Eight", "forty", "nine"])), (k % 5 + 1).cast("int"))
    return X.chapter_number(F.when(k % 2 == 0, k.cast("string")).otherwise(words))


@query(f"WITH {FRAGMENTS} SELECT book_id, frag_idx, " + r"regexp_full_match(text, '[·.\- ]*\d{1,4}[·.\- ]*') OR regexp_full_match(text, '\d{1,4}\s+[A-Z][A-Z .''\-]+') OR regexp_full_match(text, '(?i)CHAPTER\s+[A-Z]+([- ]+[A-Z]+)?') AS artifact, length(text) <= 100 AND regexp_matches(text, '^(\d+[.)]\s+)?[A-Z]') AND NOT regexp_matches(text, '[.?!]$') AS standalone FROM (SELECT book_id, frag_idx, CASE frag_idx % 4 WHEN 0 THEN CAST(frag_idx AS VARCHAR) WHEN 1 THEN '12 THE HEADER' WHEN 2 THEN 'Chapter Two' ELSE text END AS text FROM fragments)")
def page_artifacts(s, d):
    k = F.col("frag_idx") % 4
    t = F.when(k == 0, F.col("frag_idx").cast("string")).when(k == 1, "12 THE HEADER").when(k == 2, "Chapter Two").otherwise(F.col("text"))
    f = fragments(s, d).withColumn("text", t)
    return f.select("book_id", "frag_idx", X.is_page_artifact(F.col("text")).alias("artifact"), X.is_standalone(F.col("text")).alias("standalone"))


@query(f"WITH {FRAGMENTS}" + r""", l AS (SELECT book_id, frag_idx, text, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS up, regexp_extract_all(text, '[A-Za-z][A-Za-z.'']*') AS w, regexp_extract_all(text, '[A-Za-z][A-Za-z.''\-]*') AS h FROM fragments)
SELECT book_id, frag_idx, letters > 0 AND (up >= 0.7 * letters OR (length(text) <= 90 AND NOT regexp_matches(text, '[.?!,;:]$') AND len(w) BETWEEN 1 AND 12 AND len([x FOR x IN w IF NOT (regexp_matches(x, '^[A-Z]') OR lower(x) IN ('a','an','and','at','by','for','in','of','on','the','to'))]) = 0)) AS title_line, len(h) BETWEEN 1 AND 5 AND length(text) <= 45 AS short_heading FROM l""")
def title_lines(s, d):
    return fragments(s, d).select("book_id", "frag_idx", X.is_title_line(F.col("text")).alias("title_line"), X.is_short_heading(F.col("text")).alias("short_heading"))


@_scalar(r"regexp_replace(text || chr(10) || 'Text copyright ' || doc_id || chr(10) || text, '(?im)^[ \t]*(?:Titles available in\b|Read on for the first chapter\b|Text copyright\b)[\s\S]*\z', '')")
def trim_back_matter():
    return X.trim_back_matter(F.concat(F.col("text"), F.lit("\nText copyright "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")))


@query(f"WITH {FRAGMENTS} SELECT book_id, frag_idx, CASE WHEN text = '' OR regexp_matches(text, '[.?!]$') THEN text ELSE text || '.' END AS ended, format('f{{:06d}}', frag_idx) AS id, format('c{{:03d}}_f{{:06d}}', CAST(book_id AS INTEGER), frag_idx) AS paragraph FROM (SELECT book_id, frag_idx, trim(text, ' ') AS text FROM fragments)")
def fragment_ids(s, d):
    idx = F.col("frag_idx")
    return fragments(s, d).select("book_id", "frag_idx", X.ensure_terminal(F.col("text")).alias("ended"), X.fragment_id(idx).alias("id"), X.paragraph_id(F.col("book_id"), X.fragment_id(idx), idx).alias("paragraph"))


# -- time algebra -----------------------------------------------------------------------------------


@query(f"WITH {PARTS}, {FRAGMENTS}, {BOUNDS} SELECT * FROM bounds")
def allocate_by_duration(s, d):
    return bounds(s, d)


_SLICED = "sliced AS (SELECT f.book_id, frag_idx, part_no FROM fragments f JOIN bounds b ON f.book_id = b.book_id AND frag_idx >= start_idx AND frag_idx < end_idx)"


@query(f"WITH {PARTS}, {FRAGMENTS}, {BOUNDS}, {_SLICED} SELECT * FROM sliced")
def slice_by_boundaries(s, d):
    return T.slice_by_boundaries(fragments(s, d), bounds(s, d)).select("book_id", "frag_idx", "part_no")


@query(f"WITH {PARTS}, {FRAGMENTS}, c AS (SELECT book_id, part_no AS chapter_no, CAST(duration AS BIGINT) AS n, sum(CAST(duration AS BIGINT)) OVER (PARTITION BY book_id ORDER BY part_no) AS e FROM parts) SELECT f.book_id, frag_idx, chapter_no FROM fragments f JOIN c ON f.book_id = c.book_id AND frag_idx >= e - n AND frag_idx < e")
def slice_by_counts(s, d):
    chapters = parts(s, d).select("book_id", F.col("part_no").alias("chapter_no"), F.col("duration").cast("long").alias("n"))
    return T.slice_by_counts(fragments(s, d), chapters).select("book_id", "frag_idx", "chapter_no")


@query(f"""WITH {PARTS}, {FRAGMENTS}, n AS (SELECT book_id, CAST(sum(CAST(duration AS BIGINT)) AS BIGINT) AS need FROM parts GROUP BY 1), h AS (SELECT book_id, count(*) AS have FROM fragments GROUP BY 1)
SELECT n.book_id, need, have, 'too few aligned fragments' AS problem FROM n LEFT JOIN h USING (book_id) WHERE coalesce(have, 0) < need""")
def short_alignments(s, d):
    chapters = parts(s, d).select("book_id", F.col("part_no").alias("chapter_no"), F.col("duration").cast("long").alias("n"))
    return T.short_alignments(fragments(s, d), chapters)


_TIMELINE = "timeline AS (SELECT book_id, part_no, duration, coalesce(sum(duration) OVER (PARTITION BY book_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM parts)"


@query(f'WITH {PARTS}, {_TIMELINE} SELECT book_id, part_no, duration, start, start + duration AS "end" FROM timeline')
def timeline(s, d):
    return T.timeline(parts(s, d), order="part_no")


def _timed(s, d) -> DataFrame:
    """Fragments in their parts, with the part's time as the segment."""
    f = S.book_fragments(books(s, d)).withColumn("w", T.weight(F.col("text")))
    placed = T.allocated_texts(f, parts(s, d)).withColumn("seg_start", F.lit(0.0)).withColumn("seg_end", F.col("duration"))
    return T.proportional_times(placed, ["book_id", "part_no"])


_TIMED = f"""wt AS (SELECT f.book_id, frag_idx, part_no, text, duration, greatest(1, length(trim(regexp_replace(lower({_CLEAN.format('text')}), '[^a-z0-9]+', ' ', 'g'), ' '))) AS w FROM fragments f JOIN bounds b ON f.book_id = b.book_id AND frag_idx >= start_idx AND frag_idx < end_idx),
ws AS (SELECT *, sum(w) OVER (PARTITION BY book_id, part_no) AS total, sum(w) OVER (PARTITION BY book_id, part_no ORDER BY frag_idx) AS upto, row_number() OVER (PARTITION BY book_id, part_no ORDER BY frag_idx DESC) AS r FROM wt),
timed AS (SELECT book_id, part_no, frag_idx, text, round_even(greatest(0.001, duration) * (upto - w) / total, 3) AS "begin", round_even(CASE WHEN r = 1 THEN greatest(duration, 0.001) ELSE greatest(0.001, duration) * upto / total END, 3) AS "end" FROM ws)"""


@query(f'WITH {PARTS}, {FRAGMENTS}, {BOUNDS}, {_TIMED} SELECT book_id, part_no, frag_idx, "begin", "end" FROM timed')
def proportional_times(s, d):
    return _timed(s, d).select("book_id", "part_no", "frag_idx", "begin", "end")


@query(f"""WITH {PARTS}, {FRAGMENTS}, {BOUNDS}, {_TIMED}, {_TIMELINE} SELECT t.book_id, t.part_no AS segment_no, frag_idx, row_number() OVER (PARTITION BY t.book_id ORDER BY t.part_no, frag_idx) AS frag_no, format('f{{:06d}}', row_number() OVER (PARTITION BY t.book_id ORDER BY t.part_no, frag_idx)) AS id, round_even("begin" + start, 3) AS "begin", round_even("end" + start, 3) AS "end" FROM timed t JOIN timeline l ON t.book_id = l.book_id AND t.part_no = l.part_no""")
def merge_segments(s, d):
    f = _timed(s, d).select("book_id", F.col("part_no").alias("segment_no"), "frag_idx", "begin", "end")
    return T.merge_segments(f, parts(s, d).withColumnRenamed("part_no", "segment_no"))


@query(f"""WITH {PARTS}, {FRAGMENTS}, {BOUNDS}, {_TIMED} SELECT book_id, part_no AS segment_no, frag_idx, row_number() OVER (PARTITION BY book_id ORDER BY part_no, frag_idx) AS frag_no, format('f{{:06d}}', row_number() OVER (PARTITION BY book_id ORDER BY part_no, frag_idx)) AS id, round_even("begin" + part_no * 100, 3) AS "begin", round_even("end" + part_no * 100, 3) AS "end" FROM timed""")
def merge_intervals(s, d):
    f = _timed(s, d).select("book_id", F.col("part_no").alias("segment_no"), "frag_idx", "begin", "end")
    return T.merge_intervals(f, parts(s, d).select("book_id", F.col("part_no").alias("segment_no"), (F.col("part_no") * 100.0).alias("time_start")))


@query("""WITH e AS (SELECT user_id AS book_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frag_idx, value AS "begin", value + 1 AS "end" FROM events WHERE value IS NOT NULL),
a AS (SELECT *, lag("end") OVER w AS b, lead("end") OVER w IS NULL AS l FROM e WINDOW w AS (PARTITION BY book_id ORDER BY frag_idx))
SELECT book_id, frag_idx, "begin", "end", CASE WHEN "begin" < b - 0.001 THEN 'overlap' WHEN "end" < "begin" THEN 'negative length' WHEN l AND "end" <= 0 THEN 'empty' WHEN l AND "end" > 50 + 5 THEN 'overrun' END AS problem FROM a WHERE ("begin" < b - 0.001) OR ("end" < "begin") OR (l AND ("end" <= 0 OR "end" > 55))""")
def validate_alignment(s, d):
    e = table(s, d, "events").where("value is not null")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    a = e.select(F.col("user_id").alias("book_id"), F.row_number().over(w).cast("long").alias("frag_idx"), F.col("value").alias("begin"), (F.col("value") + 1).alias("end"))
    return T.alignment_problems(a, a.select("book_id").distinct().withColumn("duration", F.lit(50.0)), ["book_id"])


@query(f"""WITH {PARTS}, {FRAGMENTS}, {BOUNDS}, {_TIMED}, g AS (SELECT book_id, part_no, frag_idx, text, "begin", "end", min(CASE WHEN starts_with(text, 'The') THEN frag_idx END) OVER (PARTITION BY book_id, part_no) AS f FROM timed),
h AS (SELECT *, 100 - max(CASE WHEN frag_idx = f THEN "begin" END) OVER (PARTITION BY book_id, part_no) AS delta FROM g)
SELECT book_id, part_no, frag_idx, round_even("begin" + CASE WHEN frag_idx >= f THEN delta ELSE 0 END, 3) AS "begin", round_even("end" + CASE WHEN frag_idx >= f THEN delta ELSE 0 END, 3) AS "end", CASE WHEN f IS NULL THEN 'no fragment matches the override' END AS problem FROM h""")
def apply_overrides(s, d):
    f = _timed(s, d).select("book_id", "part_no", "frag_idx", "text", "begin", "end")
    o = parts(s, d).select("book_id", "part_no", F.lit("The").alias("text_prefix"), F.lit(100.0).alias("local_begin"))
    return T.apply_overrides(f, o, ("book_id", "part_no")).drop("text")


@query(f"""WITH {POINTS}, e AS (SELECT user_id AS book_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS frag_idx, event_id % 3 = 0 AS o, t FROM ev),
g AS (SELECT *, CASE WHEN NOT o THEN t END AS b, CASE WHEN NOT o THEN t + 1 END AS e FROM e),
h AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY frag_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l, coalesce(first_value(b IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY frag_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1e7) AS r, count(CASE WHEN NOT o THEN 1 END) OVER (PARTITION BY book_id ORDER BY frag_idx) AS island FROM g),
i AS (SELECT *, row_number() OVER (PARTITION BY book_id, island, o ORDER BY frag_idx) AS k, count(*) OVER (PARTITION BY book_id, island, o) AS m FROM h)
SELECT book_id, frag_idx, round_even(CASE WHEN o THEN l + (k - 1) * (greatest(0.001, r - l) / m) ELSE b END, 3) AS "begin", round_even(CASE WHEN o THEN l + k * (greatest(0.001, r - l) / m) ELSE e END, 3) AS "end" FROM i""")
def interpolate_gaps(s, d):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = _event_times(s, d).select(F.col("user_id").alias("book_id"), F.row_number().over(w).cast("long").alias("frag_idx"), F.when(F.col("event_id") % 3 != 0, F.col("t")).alias("begin"), F.when(F.col("event_id") % 3 != 0, F.col("t") + 1).alias("end"))
    return T.interpolate_gaps(e, F.lit(0.0), F.lit(1e7))


def _event_times(s, d) -> DataFrame:
    e = table(s, d, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    least = e.agg(F.min(seconds).alias("least"))
    return e.withColumn("s", seconds).join(F.broadcast(least)).select("user_id", "event_id", (F.col("s") - F.col("least")).alias("t"), "value", "ts")  # one row


@query(f"""WITH {PARTS}, {FRAGMENTS}, {BOUNDS}, {_TIMED}, s AS (SELECT book_id, part_no AS chapter_no, min_by("begin" + 1000 * part_no, frag_idx) AS start FROM timed GROUP BY 1, 2)
SELECT book_id, chapter_no, start, coalesce(lead(start) OVER (PARTITION BY book_id ORDER BY chapter_no), 99999.0) AS "end" FROM s""")
def single_alignment_bounds(s, d):
    f = _timed(s, d).select("book_id", F.col("part_no").alias("chapter_no"), "frag_idx", (F.col("begin") + 1000 * F.col("part_no")).alias("begin"))
    return T.single_alignment_bounds(f, books(s, d).select("book_id", F.lit(99999.0).alias("duration")))


@query(f"WITH {PARTS}, t AS (SELECT book_id, sum(duration) * 60 AS duration FROM parts GROUP BY 1), k AS (SELECT *, unnest(range(CAST(ceil(duration / 600) AS BIGINT))) AS k FROM t) SELECT book_id, duration, k * 600.0::DOUBLE AS clip_start, least(30.0::DOUBLE, duration - k * 600.0::DOUBLE) AS clip_length FROM k")
def anchor_windows(s, d):
    return T.anchor_windows(parts(s, d).groupBy("book_id").agg((F.sum("duration") * 60).alias("duration")))


@query(f"""WITH {PARTS}, {FRAGMENTS}, a AS (SELECT book_id, count(*) AS n, min(CASE WHEN starts_with(text, 'The ') OR starts_with(text, 'La ') THEN frag_idx END) AS anchor0, min(CASE WHEN starts_with(text, 'The') THEN frag_idx END) AS anchor FROM fragments GROUP BY 1),
q AS (SELECT book_id, count(*) AS k, max(CASE WHEN part_no = 1 THEN duration END) AS d1, max(CASE WHEN part_no = 2 THEN duration END) AS d2 FROM parts GROUP BY 1),
g AS (SELECT a.book_id, n, anchor, CAST(least(greatest(round_even(anchor * d1 / nullif(d1 + d2, 0), 0), 1), anchor - 1) AS BIGINT) AS cut FROM a JOIN q USING (book_id) WHERE k = 3 AND n >= 3 AND anchor >= 2), {BOUNDS.replace('parts p JOIN', '(SELECT * FROM parts WHERE book_id NOT IN (SELECT book_id FROM g)) p JOIN')}
SELECT book_id, 1 AS part_no, 0 AS start_idx, cut AS end_idx FROM g UNION ALL SELECT book_id, 2, cut, anchor FROM g UNION ALL SELECT book_id, 3, anchor, n FROM g
UNION ALL SELECT book_id, part_no, start_idx, end_idx FROM bounds WHERE book_id IN (SELECT book_id FROM a)""")
def anchor_segments(s, d):
    return T.anchor_segments(fragments(s, d), parts(s, d), "The")


_LONG_PARTS = "lp AS (SELECT book_id, part_no, duration FROM parts), chapters AS (SELECT book_id, part_no AS chapter_no, duration FROM lp WHERE part_no <= 3)"


@query(f"WITH {PARTS}, {_LONG_PARTS}, n AS (SELECT book_id, count(*) AS n FROM chapters GROUP BY 1) SELECT book_id, 'chapter' AS kind, chapter_no AS number, chapter_no AS part_no, duration FROM chapters UNION ALL SELECT lp.book_id, 'outro', NULL, part_no, duration FROM lp JOIN n ON lp.book_id = n.book_id AND part_no = n + 1")
def outro_append(s, d):
    p = parts(s, d)
    return T.append_outro(p.where("part_no <= 3").select("book_id", F.col("part_no").alias("chapter_no"), "duration"), p)


@query(f"""WITH {PARTS}, sp AS (SELECT o_orderkey AS book_id, unnest([1, 2]) AS chapter_no, unnest([[1, 3], [2]]) AS a FROM orders), w AS (SELECT book_id, chapter_no, unnest(a) AS part_no, unnest(range(len(a))) AS pos FROM sp),
j AS (SELECT w.*, duration FROM w LEFT JOIN parts p ON w.book_id = p.book_id AND w.part_no = p.part_no)
SELECT book_id, chapter_no, sum(duration) AS duration, array_to_string(list(part_no ORDER BY pos), ',') AS parts, CASE WHEN count(*) > count(duration) THEN 'missing audio part' END AS problem FROM j GROUP BY 1, 2""")
def chapter_audio(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("book_id"))
    specs = o.select("book_id", F.explode(F.array(F.struct(F.lit(1).alias("chapter_no"), F.array(F.lit(1), F.lit(3)).alias("audio_parts")), F.struct(F.lit(2).alias("chapter_no"), F.array(F.lit(2)).alias("audio_parts"))))).select("book_id", "col.*")
    return A.chapter_audio(specs, parts(s, d)).withColumn("parts", F.array_join("parts", ","))


@query(f"""WITH {PARTS}, c AS (SELECT book_id, part_no * 10 AS chapter_no, row_number() OVER (PARTITION BY book_id ORDER BY part_no) AS n FROM parts WHERE part_no % 2 = 1 OR duration > 25), p AS (SELECT *, part_no AS n FROM parts)
SELECT coalesce(c.book_id, p.book_id) AS book_id, coalesce(c.n, p.n) AS n, chapter_no, part_no, duration, CASE WHEN chapter_no IS NULL THEN 'no chapter' WHEN part_no IS NULL THEN 'no audio part' END AS problem FROM c FULL JOIN p ON c.book_id = p.book_id AND c.n = p.n""")
def chapters_with_audio(s, d):
    p = parts(s, d)
    return A.chapters_with_audio(p.where("part_no % 2 = 1 or duration > 25").select("book_id", (F.col("part_no") * 10).alias("chapter_no")), p)


_ENTRIES = "entries AS (SELECT book_id, part_no - 1 AS pos, CASE WHEN part_no % 3 = 0 THEN 'Interlude' ELSE 'Chapter ' || (part_no % 4 + 1) || ': Title ' || part_no END AS title, part_no % 2 AS spine_index, floor(duration / 5) * 5 AS \"offset\" FROM parts)"


def _entries(s, d) -> DataFrame:
    n = F.col("part_no")
    title = F.when(n % 3 == 0, "Interlude").otherwise(F.concat(F.lit("Chapter "), (n % 4 + 1).cast("string"), F.lit(": Title "), n.cast("string")))
    return parts(s, d).select("book_id", (n - 1).alias("pos"), title.alias("title"), (n % 2).alias("spine_index"), (F.floor(F.col("duration") / 5) * 5.0).alias("offset"))


@query(f"""WITH {PARTS}, {_ENTRIES}, o AS (SELECT DISTINCT book_id, spine_index, "offset" FROM entries), n AS (SELECT *, lead("offset") OVER (PARTITION BY book_id, spine_index ORDER BY "offset") AS nx FROM o)
SELECT e.book_id, CAST(regexp_extract(title, 'Chapter (\\d+)', 1) AS INTEGER) AS number, regexp_extract(title, ': (.+)', 1) AS title, e.spine_index, e."offset" AS start, coalesce(nx, 60.0) AS "end" FROM entries e JOIN n USING (book_id, spine_index, "offset") WHERE title LIKE 'Chapter%'""")
def spans_from_metadata(s, d):
    e = _entries(s, d)
    return A.spans_from_metadata(e, e.select("book_id", "spine_index").distinct().withColumn("duration", F.lit(60.0)))


@query(f"""WITH {PARTS}, {_ENTRIES}, n AS (SELECT book_id, pos, CAST(regexp_extract(title, 'Chapter (\\d+)', 1) AS INTEGER) AS number, regexp_extract(title, ': (.+)', 1) AS title FROM entries WHERE title LIKE 'Chapter%'),
t AS (SELECT book_id, number, max_by(title, pos) AS title FROM n GROUP BY 1, 2) SELECT *, max(number) OVER (PARTITION BY book_id) AS chapter_count FROM t""")
def book_config(s, d):
    return A.book_config(_entries(s, d))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def incremental(s, d):
    done = table(s, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return A.incremental(table(s, d, "orders").select("o_orderkey", "o_totalprice"), done, ["o_orderkey"])


_RECURSE = f"""{POINTS}, pts AS (SELECT user_id AS book_id, floor(t / 1000) AS time, CAST(event_id % 977 AS BIGINT) AS idx FROM ev),
ord AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY time, idx) AS r FROM pts),
walk AS (SELECT book_id, time, idx, r, true AS keep, time AS lt, idx AS li FROM ord WHERE r = 1
  UNION ALL SELECT o.book_id, o.time, o.idx, o.r, o.time > w.lt AND o.idx > w.li, CASE WHEN o.time > w.lt AND o.idx > w.li THEN o.time ELSE w.lt END, CASE WHEN o.time > w.lt AND o.idx > w.li THEN o.idx ELSE w.li END FROM walk w JOIN ord o ON o.book_id = w.book_id AND o.r = w.r + 1),
kept AS (SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY r) - 1 AS INTEGER) AS pos, time, idx FROM walk WHERE keep)"""


def _points(s, d) -> DataFrame:
    return _event_times(s, d).select(F.col("user_id").alias("book_id"), F.floor(F.col("t") / 1000).cast("double").alias("time"), (F.col("event_id") % 977).alias("idx"))


@query(f"WITH RECURSIVE {_RECURSE} SELECT * FROM kept")
def monotone_points(s, d):
    return T.monotone_points(_points(s, d).withColumn("source", F.lit("")), ("book_id",)).drop("source")


@query(f"""WITH RECURSIVE {_RECURSE.replace("FROM ev)", "FROM ev UNION ALL SELECT DISTINCT user_id, 0, 0 FROM ev UNION ALL SELECT DISTINCT user_id, 1e7, 1000 FROM ev)")} SELECT book_id, idx AS fragment_start, time AS time_start, fe AS fragment_end, te AS time_end FROM (SELECT *, lead(idx) OVER w AS fe, lead(time) OVER w AS te FROM kept WINDOW w AS (PARTITION BY book_id ORDER BY pos)) WHERE fe IS NOT NULL""")
def boundaries(s, d):
    p = _points(s, d)
    ends = p.select("book_id").distinct().select("book_id", F.lit(1000).cast("long").alias("n"), F.lit(1e7).alias("duration"))
    return T.boundaries(p, ends, keys=("book_id",)).drop("source_start", "source_end")


# -- matching and playback ------------------------------------------------------------------------------


_NORM = "trim(regexp_replace(lower(" + _CLEAN + "), '[^a-z0-9]+', ' ', 'g'), ' ')"


@query(f"WITH b AS (SELECT item_id AS clip_id, {_NORM.format('text')} AS n FROM benchmark), d AS (SELECT doc_id AS frag_idx, {_NORM.format('text')} AS m FROM documents) SELECT clip_id, min(frag_idx) AS frag_idx FROM b JOIN d ON n <> '' AND m <> '' AND (contains(m, n) OR contains(n, m)) GROUP BY 1")
def match_anchor_containment(s, d):
    clips = table(s, d, "benchmark").select(F.col("item_id").alias("clip_id"), X.normalize_match(F.col("text")).alias("norm"))
    f = stored(books(s, d).select(F.col("book_id").alias("frag_idx"), X.normalize_match(F.col("text")).alias("norm")), "norms")  # read three times
    return M.contained_anchors(clips, f, ())


def _turns(s, d) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("seg_idx")
    t = spread(table(s, d, "conversations").select("conv_id", "turn", "text")).select("conv_id", F.col("turn").alias("seg_idx"), "text", F.length("text").cast("double").alias("len"))
    return t.withColumn("end", F.sum("len").over(w)).withColumn("start", F.col("end") - F.col("len")).select(F.col("conv_id").alias("book_id"), F.lit(1).alias("chapter_no"), "seg_idx", "start", "end", "text")


def _turn_fragments(s, d) -> DataFrame:
    w = Window.partitionBy("book_id", "chapter_no").orderBy("seg_idx", "pos")
    f = S.book_fragments(_turns(s, d), keys=("book_id", "chapter_no", "seg_idx")).withColumnRenamed("frag_idx", "pos")
    return f.withColumn("frag_idx", F.row_number().over(w) - 1).select("book_id", "chapter_no", "frag_idx", "text")


@query()
def match_anchor(s, d):
    clips = _turns(s, d).select("book_id", "chapter_no", F.concat_ws("-", "book_id", "seg_idx").alias("clip_id"), "text", F.col("start").alias("clip_start"), F.lit(0.0).alias("first_start"))
    return M.match_anchor(clips, _turn_fragments(s, d))


@query()
def align_to_segments(s, d):
    return M.assign_times(_turn_fragments(s, d), _turns(s, d))


@query()
def match_audit(s, d):
    return M.match_audit(M.assign_times(_turn_fragments(s, d), _turns(s, d)))


def _positions(s, d) -> DataFrame:
    e = _event_times(s, d)
    return e.select(F.col("event_id").alias("position_id"), "user_id", "ts", F.col("user_id").alias("book_id"), (F.col("event_id") % 3 + 1).cast("int").alias("chapter_no"), F.pmod(F.col("t"), F.lit(60.0)).alias("t"))


_POS = f"{POINTS}, pos AS (SELECT event_id AS position_id, user_id AS book_id, CAST(event_id % 3 + 1 AS INTEGER) AS chapter_no, t % 60 AS t FROM ev)"


def _paragraphs(s, d) -> DataFrame:
    return _timed(s, d).select("book_id", F.col("part_no").alias("chapter_no"), "frag_idx", "begin", "end")


@query(f"""WITH {PARTS}, {FRAGMENTS}, {BOUNDS}, {_TIMED}, {_POS}, h AS (SELECT position_id, max(frag_idx) AS frag_idx FROM pos p JOIN timed t ON p.book_id = t.book_id AND p.chapter_no = t.part_no AND p.t >= t."begin" AND p.t < t."end" GROUP BY 1) SELECT position_id, frag_idx FROM pos LEFT JOIN h USING (position_id)""")
def active_paragraph(s, d):
    return T.active_paragraph(_positions(s, d), _paragraphs(s, d)).select("position_id", "frag_idx")


@query("SELECT user_id, event_type AS book_id, max_by(event_id, ts) AS event_id FROM events GROUP BY 1, 2")
def latest_progress(s, d):
    e = table(s, d, "events").select("user_id", F.col("event_type").alias("book_id"), "ts", "event_id")
    return P.latest_progress(e).drop("ts")


@query(f"""WITH {PARTS}, {_TIMELINE}, {_POS} SELECT position_id, greatest(0, t) AS local, CAST(CASE WHEN duration > 0 THEN least(1000, floor(1000 * greatest(0, t) / duration + 0.5)) ELSE 0 END AS INTEGER) AS permille, start + greatest(0, t) AS clock, t >= duration - 0.15 AND coalesce(nx = part_no // 2, false) AS advance FROM pos p JOIN (SELECT *, lead(part_no // 2) OVER (PARTITION BY book_id ORDER BY part_no) AS nx FROM timeline) l ON p.book_id = l.book_id AND p.chapter_no = l.part_no""")
def chapter_progress(s, d):
    chapters = T.timeline(parts(s, d), order="part_no").withColumnRenamed("part_no", "chapter_no").withColumn("audio", F.floor(F.col("chapter_no") / 2))
    return P.chapter_progress(_positions(s, d), chapters).select("position_id", "local", "permille", "clock", "advance")


@query(f"""WITH {PARTS}, {FRAGMENTS}, {BOUNDS}, {_TIMED}, {_POS}, h AS (SELECT position_id, max(frag_idx) AS frag_idx FROM pos p JOIN timed t ON p.book_id = t.book_id AND p.chapter_no = t.part_no AND p.t >= t."begin" AND p.t < t."end" GROUP BY 1),
l AS (SELECT e.user_id, e.event_id AS position_id, frag_idx, lag(frag_idx) OVER w AS before, row_number() OVER w AS n FROM events e LEFT JOIN h ON e.event_id = h.position_id WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, position_id, frag_idx FROM l WHERE (n = 1 AND frag_idx IS NOT NULL) OR (n > 1 AND frag_idx IS DISTINCT FROM before)""")
def paragraph_changes(s, d):
    return P.paragraph_changes(_positions(s, d), _paragraphs(s, d)).select("user_id", "position_id", "frag_idx")


# -- structure ---------------------------------------------------------------------------------------------


def _made_books(s, d) -> DataFrame:
    """Each document between chapter headings, a running header, a page number, a figure and a citation that are cut in two."""
    body = F.replace("text", F.lit(". "), F.lit(".\n     "))
    text = F.concat(F.lit("CHAPTER ONE\nThe First Part\n\n"), body, F.lit("\n12\nTHE FIRST PART 13\nCHAPTER TWO - More\n\nTHE SECOND\nPART\n\nIt was (see Figs.\n3)and so it went.\nAs said (Mill 1940:\n12).\n"), body, F.lit("\nText copyright 2020\nEnd"))
    return books(s, d).select("book_id", text.alias("text"))


def _strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{_WS}|{_WS}$', '', 'g')"


_BODY = _CLEAN.format("replace(text, '. ', '.' || chr(10) || '     ')")
_CHAPTERS = f"""made AS (SELECT doc_id, {_BODY} AS b FROM documents WHERE text IS NOT NULL),
chapters AS (SELECT doc_id AS book_id, 1 AS chapter_no, 'The First Part' AS title, {_strip_sql("b || chr(10) || '12' || chr(10) || 'THE FIRST PART 13'")} AS body FROM made
  UNION ALL SELECT doc_id, 2, 'The Second Part', {_strip_sql("'It was (see Figs.' || chr(10) || '3)and so it went.' || chr(10) || 'As said (Mill 1940:' || chr(10) || '12).' || chr(10) || b")} FROM made)"""


@query(f"WITH {_CHAPTERS} SELECT * FROM chapters")
def extract_chapters(s, d):
    return S.extract_chapters(_made_books(s, d), {1: "The First Part", 2: "The Second Part"}, 2)


@query(f"WITH {_CHAPTERS} SELECT * FROM chapters")
def chapters_of_lines(s, d):
    """The same from tables of lines, in which no row holds a book."""
    return L.chapters_of_lines(stored(L.text_lines(_made_books(s, d)), "lines"), {1: "The First Part", 2: "The Second Part"}, 2)


@query(f"SELECT doc_id AS book_id, unnest([1, 2]) AS chapter_no, unnest(['First', 'Second']) AS title, {_strip_sql('text')} AS body, CAST(NULL AS VARCHAR) AS problem FROM documents WHERE text IS NOT NULL")
def extract_marked_chapters(s, d):
    text = F.concat(F.lit("x\n1\nThe First\n"), F.col("text"), F.lit("\n 2 \n\nThe  Second\n"), F.col("text"), F.lit("\nREFERENCES\nend"))
    specs = [{"chapter_no": 1, "marker_title": "The First", "display_title": "First"}, {"chapter_no": 2, "marker_title": "The Second", "display_title": "Second"}]
    return S.extract_marked_chapters(books(s, d).select("book_id", text.alias("text")), specs)


def _chapters(s, d) -> DataFrame:
    return S.extract_chapters(_made_books(s, d), {1: "The First Part", 2: "The Second Part"}, 2)


_PARAGRAPHS = rf"""WITH RECURSIVE {_CHAPTERS}, raw AS (SELECT book_id, chapter_no, unnest(range(len(a))) AS i, unnest(a) AS l FROM (SELECT book_id, chapter_no, string_split(body, chr(10)) AS a FROM chapters)),
x AS (SELECT book_id, chapter_no, i, replace(l, chr(9), '    ') AS wide, {_strip_sql("l")} AS line FROM raw),
k AS (SELECT book_id, chapter_no, row_number() OVER (PARTITION BY book_id, chapter_no ORDER BY i) AS r, length(wide) - length(regexp_replace(wide, '^{_WS}', '')) AS indent, regexp_replace(line, '\b([A-Z])\s{{2,}}([a-z])', '\1\2', 'g') AS line FROM x
  WHERE line = '' OR NOT (regexp_full_match(line, '[·.\- ]*\d{{1,4}}[·.\- ]*') OR regexp_full_match(line, '\d{{1,4}}\s+[A-Z][A-Z .''\-]+') OR regexp_full_match(line, '(?i)CHAPTER\s+[A-Z]+([- ]+[A-Z]+)?') OR upper(line) = 'THE FIRST PART' OR regexp_replace(upper(line), '\s+\d{{1,4}}$', '') = 'THE FIRST PART')),
f AS (SELECT book_id, chapter_no, r, line <> '' AS open, line <> '' AND indent BETWEEN 2 AND 5 AS indented, line AS cur, CASE WHEN line = '' THEN 0 ELSE 1 END AS p FROM k WHERE r = 1
  UNION ALL SELECT book_id, chapter_no, r, line <> '', CASE WHEN line = '' THEN false WHEN more THEN indented ELSE indent BETWEEN 2 AND 5 END,
    CASE WHEN line = '' THEN cur WHEN NOT more THEN line WHEN cur LIKE '%-' AND regexp_matches(line, '^\p{{Ll}}') THEN CASE WHEN regexp_matches(cur, '-[^ ]*-$') THEN cur ELSE cur[:-2] END || line ELSE cur || ' ' || line END, p + CASE WHEN line = '' OR more THEN 0 ELSE 1 END
  FROM (SELECT k.*, f.indented, f.cur, f.p, f.open AND NOT k.indent BETWEEN 2 AND 5 AND NOT (NOT f.indented AND k.indent <= 1 AND regexp_matches(f.cur, '[.?!]"?$') AND regexp_matches(k.line, '^["'']?[A-Z]')) AS more FROM f JOIN k ON k.book_id = f.book_id AND k.chapter_no = f.chapter_no AND k.r = f.r + 1))"""


@query(rf"""{_PARAGRAPHS}
SELECT book_id, chapter_no, CAST(p AS INTEGER) AS frag_idx, trim(regexp_replace(max_by(cur, r), '{_WS}', ' ', 'g'), ' ') AS text FROM f WHERE p > 0 GROUP BY ALL
UNION ALL SELECT book_id, chapter_no, 0, 'Chapter ' || ['One', 'Two'][chapter_no] || '. ' || title || '.' FROM chapters""")
def paragraph_fragments(s, d):
    return S.paragraph_fragments(_chapters(s, d), ["The First Part"])


@query(rf"""{_PARAGRAPHS}
SELECT book_id, chapter_no, CAST(p - 1 AS INTEGER) AS frag_idx, trim(regexp_replace(max_by(cur, r), '{_WS}', ' ', 'g'), ' ') AS text FROM f WHERE p > 0 GROUP BY ALL""")
def paragraphs_of_lines(s, d):
    return L.paragraphs_of_lines(L.text_lines(_chapters(s, d), ("book_id", "chapter_no"), "body"), ("book_id", "chapter_no"), ["The First Part"])


@query(f"""WITH {_CHAPTERS}, texts AS (SELECT book_id * 2 + chapter_no AS doc_id, body AS text FROM chapters), {FRAGMENTS.replace("FROM documents", "FROM texts")}
SELECT c.book_id, c.chapter_no, frag_idx + 1 AS frag_idx, text FROM fragments f JOIN chapters c ON f.book_id = c.book_id * 2 + c.chapter_no
UNION ALL SELECT book_id, chapter_no, 0, 'Chapter ' || chapter_no || '. ' || title || '.' FROM chapters""")
def sentence_fragments(s, d):
    return S.sentence_fragments(_chapters(s, d))


def _by_place(s, d, texts: list[str | None]) -> DataFrame:
    """The fragments, of which the k-th of each len(texts) is followed by texts[k], or is that alone if it begins with '='."""
    k = F.col("frag_idx") % len(texts)
    text = F.col("text")
    for i, t in enumerate(texts):
        if t is not None:
            text = F.when(k == i, F.lit(t[1:]) if t.startswith("=") else F.concat(F.col("text"), F.lit(t))).otherwise(text)
    return fragments(s, d).withColumn("text", text)


def _by_place_sql(texts: list[str | None]) -> str:
    cases = " ".join(f"WHEN {i} THEN " + (f"'{t[1:]}'" if t.startswith("=") else f"text || '{t}'") for i, t in enumerate(texts) if t is not None)
    return f"placed AS (SELECT book_id, frag_idx, CASE frag_idx % {len(texts)} {cases} ELSE text END AS text FROM fragments)"


_FIGURES = [" (see Figs.", "=3) and so it went", None, " in Fig.", "=4 and 5, which is so", "=12) (see Fig.", "=7) and (see Figs.", "=8", "=9", " (see Table 3 and Fig.", None]
_CITED = [" (Mill 1940:", "=12).", None, " as Smith 1999:", "=3; ", "=and B. Mill 1950:", "=14)", "=(Mill 1940:", "=Mill 1940: 3", None, "=as it is", "=J. Mill 1940: 4.", "=by Mill 1940:"]
_FIGURE_SQL = r"'\s*\((see\s+)?(Table\s+\d+\s+and\s+)?Figs?\.$|\s+in\s+Figs?\.$'"


@query(rf"""WITH RECURSIVE {FRAGMENTS}, {_by_place_sql(_FIGURES)},
k AS (SELECT *, CASE WHEN regexp_matches(text, {_FIGURE_SQL}) THEN trim(regexp_replace(text, {_FIGURE_SQL}, '')) END AS cut, CASE WHEN regexp_matches(text, '^\d+\)') THEN regexp_extract(text, '^\d+\)\s*(.*)$', 1) WHEN regexp_matches(text, '^\d+(\s+and\s+\d+)?(,\s+which\b.*)?\.?$') THEN '' END AS prose FROM placed),
f AS (SELECT book_id, frag_idx, cut IS NOT NULL AS held, false AS taken FROM k WHERE frag_idx = 0
  UNION ALL SELECT k.book_id, k.frag_idx, cut IS NOT NULL AND NOT (held AND prose IS NOT NULL), held AND prose IS NOT NULL FROM f JOIN k ON k.book_id = f.book_id AND k.frag_idx = f.frag_idx + 1),
n AS (SELECT k.*, taken, lead(taken) OVER w AS next_taken, lead(prose) OVER w AS next_prose FROM k JOIN f USING (book_id, frag_idx) WINDOW w AS (PARTITION BY k.book_id ORDER BY k.frag_idx)),
o AS (SELECT book_id, frag_idx, CASE WHEN cut IS NULL THEN text ELSE trim(cut || CASE WHEN next_taken THEN ' ' || next_prose ELSE '' END) END AS t, cut FROM n WHERE NOT taken),
e AS (SELECT book_id, frag_idx, CASE WHEN cut IS NULL OR t = '' OR regexp_matches(t, '[.?!]$') THEN t ELSE t || '.' END AS text FROM o)
SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY frag_idx) - 1 AS INTEGER) AS frag_idx, text FROM e WHERE text <> ''""")
def repair_figure_refs(s, d):
    return S.repair_figure_refs(_by_place(s, d, _FIGURES), ("book_id",))


_NAME_YEAR_SQL = r"[A-Z][A-Za-z'' \-]+ \d{{4}}:"


@query(rf"""WITH RECURSIVE {FRAGMENTS}, {_by_place_sql(_CITED)},
k AS (SELECT *, regexp_matches(text, '^\d+[),;:\-]|^((and\s+)?[A-Z](\.\s*)?\s*)?{_NAME_YEAR_SQL}') AS more, regexp_matches(text, '^([A-Z](\.\s*)?\s*)?{_NAME_YEAR_SQL}') AS orphan, regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_]){_NAME_YEAR_SQL}$') AS head, regexp_matches(text, '[.?!]$') AS ended, trim(regexp_replace(text, '\s*\([^()]*\b{_NAME_YEAR_SQL}$', '')) AS alone FROM (SELECT book_id, frag_idx, trim(text) AS text FROM placed)),
f AS (SELECT book_id, frag_idx, head AS run, 1 AS pieces, NOT ended AND NOT head AS open, NOT ended AND NOT head AS under, false AS joins FROM k WHERE frag_idx = 0
  UNION ALL SELECT book_id, frag_idx,
    CASE WHEN joins THEN in_run AND NOT ended ELSE head END, CASE WHEN in_run THEN pieces + 1 ELSE 1 END,
    CASE WHEN joins OR NOT head THEN NOT ended ELSE false END, CASE WHEN joins OR NOT head THEN NOT ended ELSE CASE WHEN alone = '' THEN was_open ELSE false END END, joins
  FROM (SELECT k.*, pieces, run AND more AS in_run, was_open, (run AND more) OR (was_open AND orphan) AS joins FROM (SELECT f.*, CASE WHEN run THEN CASE WHEN pieces > 1 THEN true ELSE under END ELSE open END AS was_open FROM f) f JOIN k ON k.book_id = f.book_id AND k.frag_idx = f.frag_idx + 1)),
n AS (SELECT k.*, joins, run, pieces, coalesce(lead(joins AND pieces > 1) OVER (PARTITION BY k.book_id ORDER BY k.frag_idx), false) AS taken FROM k JOIN f USING (book_id, frag_idx)),
o AS (SELECT book_id, frag_idx, joins, CASE WHEN head AND NOT joins AND NOT taken THEN CASE WHEN alone = '' OR regexp_matches(alone, '[.?!]$') THEN alone ELSE alone || '.' END ELSE text END AS text FROM n WHERE NOT (head AND NOT joins AND NOT taken AND alone = '')),
g AS (SELECT *, count(CASE WHEN NOT joins THEN 1 END) OVER (PARTITION BY book_id ORDER BY frag_idx) AS g FROM o)
SELECT book_id, CAST(g - 1 AS INTEGER) AS frag_idx, string_agg(text, ' ' ORDER BY frag_idx) AS text FROM g GROUP BY book_id, g""".replace("{{4}}", "{4}"))
def merge_citations(s, d):
    return S.merge_citations(_by_place(s, d, _CITED), ("book_id",))


@query(rf"""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, replace(regexp_replace(l, '^{_WS}|{_WS}$', '', 'g'), chr(12), '') AS x FROM l),
p AS (SELECT doc_id, count(CASE WHEN x <> '' AND NOT regexp_full_match(x, '[·.\- ]*\d{{1,4}}[·.\- ]*') AND NOT regexp_full_match(x, '\d{{1,4}}\s+[A-Z][A-Z .''\-]+') THEN 1 END) AS n FROM t GROUP BY 1)
SELECT doc_id AS book_id, CAST(NULL AS INTEGER) AS chapter_no, 'chapters not 1..n' AS problem FROM p WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, unnest([CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END]), 'few paragraphs' FROM p WHERE n < 5""")
def validate_chapters(s, d):
    """Each document's lines as the paragraphs of two chapters; in every third book the chapters are 2 and 3."""
    body = F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body")
    first = F.when(F.col("book_id") % 3 == 0, 2).otherwise(1)
    c = books(s, d).where("text is not null").select("book_id", F.explode(F.array(first, first + 1)).alias("chapter_no"), body)
    return S.chapter_problems(c, 2)


_REFLOW = _CLEAN.format("replace(text, ' de ', '-' || chr(10) || 'de ')")


_REFLOWED = rf"""WITH RECURSIVE l AS (SELECT doc_id, i, trim(regexp_replace(l, '{_WS}', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS l FROM (SELECT doc_id, regexp_split_to_array({_REFLOW}, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS a FROM documents WHERE text IS NOT NULL))),
f AS (SELECT doc_id, i, line AS cur, true AS fresh FROM l WHERE i = 0
  UNION ALL SELECT doc_id, i, CASE WHEN fresh THEN line WHEN cur LIKE '%-' AND low THEN cur[:-2] || line ELSE cur || ' ' || line END, fresh FROM (
    SELECT l.doc_id, l.i, cur, line, low, line = '' OR cur = '' OR NOT (low OR regexp_matches(cur, '(^|[^\p{{L}}\p{{N}}_])[A-Z]\.$') OR NOT (regexp_matches(cur, '[.?!;:]$') OR (words BETWEEN 1 AND 5 AND length(cur) <= 45 AND regexp_matches(line, '^[A-Z]')))) AS fresh
    FROM (SELECT *, len(regexp_extract_all(cur, '[A-Za-z][A-Za-z.''\-]*')) AS words FROM f) f JOIN (SELECT *, regexp_matches(line, '^\p{{Ll}}') AS low FROM l) l ON l.doc_id = f.doc_id AND l.i = f.i + 1)),
g AS (SELECT *, coalesce(lead(fresh) OVER (PARTITION BY doc_id ORDER BY i), true) AS done FROM f)
SELECT doc_id AS book_id, {_strip_sql("regexp_replace(string_agg(cur, chr(10) ORDER BY i), '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM g WHERE done GROUP BY doc_id"""


@query(_REFLOWED)
def normalize_pdf_lines(s, d):
    return books(s, d).select("book_id", S.normalize_pdf_lines(F.replace("text", F.lit(" de "), F.lit("-\nde "))).alias("text"))


@query(f"SELECT book_id, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS line FROM (SELECT book_id, string_split(text, chr(10)) AS a FROM ({_REFLOWED}) WHERE text <> '')")
def reflow_lines(s, d):
    """The same as rows, numbered in order."""
    made = books(s, d).select("book_id", F.replace("text", F.lit(" de "), F.lit("-\nde ")).alias("text"))
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("line_no")).cast("long")
    return L.reflow_lines(L.text_lines(made)).select("book_id", n.alias("n"), "line")


@query()
def html_to_text(s, d):
    return table(s, d, "pages").select("page_id", S.html_to_text(F.col("html")).alias("text"))


@query(f"""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, array_to_string([CASE WHEN i > 1 AND w[i] IN ('a','an','and','at','by','for','in','of','on','the','to') THEN w[i] ELSE upper(w[i][1]) || lower(w[i][2:]) END FOR i IN range(1, len(w) + 1)], ' ') AS title FROM w""")
def title_case_heading(s, d):
    return table(s, d, "part").select("p_partkey", S.title_case_heading(F.col("p_name")).alias("title"))


_CAPTIONED = "cf AS (SELECT book_id, frag_idx, CASE WHEN frag_idx % 7 = 1 THEN 'Fig.' WHEN frag_idx % 7 = 4 THEN 'Fig. 3 shows that ' || text WHEN frag_idx % 7 IN (2, 3, 5) THEN 'Copyright ' || frag_idx ELSE text END AS text FROM fragments)"


@query(f"""WITH {FRAGMENTS}, {_CAPTIONED}, b AS (SELECT *, count(CASE WHEN NOT starts_with(text, 'Copyright') THEN 1 END) OVER (PARTITION BY book_id ORDER BY frag_idx) AS b FROM cf), l AS (SELECT *, first_value(text) OVER (PARTITION BY book_id, b ORDER BY frag_idx) AS l FROM b) SELECT book_id, frag_idx, text FROM l WHERE NOT (l = 'Fig.' AND b > 0)""")
def drop_figure_blocks(s, d):
    k = F.col("frag_idx") % 7
    t = F.when(k == 1, "Fig.").when(k == 4, F.concat(F.lit("Fig. 3 shows that "), F.col("text"))).when(k.isin(2, 3, 5), F.concat(F.lit("Copyright "), F.col("frag_idx").cast("string"))).otherwise(F.col("text"))
    return S.drop_figure_blocks(fragments(s, d).withColumn("text", t), ["Copyright"], ("book_id",))


@query(f"""WITH {FRAGMENTS}, c AS (SELECT book_id, frag_idx, CASE frag_idx % 8 WHEN 0 THEN text || ' (see Figs.' WHEN 1 THEN 'Copyright' WHEN 2 THEN 'Mill 1940: 3' WHEN 3 THEN 'by Mill et al.' WHEN 4 THEN ' Fig. ' WHEN 5 THEN 'one two three four five six seven eight)' WHEN 6 THEN 'one two three four five six seven eight nine)' ELSE text || ' (' END AS text FROM fragments)
SELECT book_id, frag_idx, text, CASE frag_idx % 8 WHEN 0 THEN 'dangling figure' WHEN 1 THEN 'caption' WHEN 2 THEN 'orphan citation' WHEN 3 THEN 'et al.' WHEN 4 THEN 'caption' WHEN 5 THEN 'short unmatched )' ELSE 'unmatched (' END AS reason FROM c WHERE frag_idx % 8 <> 6""")
def fragment_audit(s, d):
    k = F.col("frag_idx") % 8
    t = F.when(k == 0, F.concat(F.col("text"), F.lit(" (see Figs."))).when(k == 1, "Copyright").when(k == 2, "Mill 1940: 3").when(k == 3, "by Mill et al.").when(k == 4, " Fig. ").when(k == 5, "one two three four five six seven eight)").when(k == 6, "one two three four five six seven eight nine)").otherwise(F.concat(F.col("text"), F.lit(" (")))
    return S.audit_fragments(fragments(s, d).withColumn("text", t), ["Copyright"])


@query(f"""WITH {PARTS}, {FRAGMENTS}, {BOUNDS}, j AS (SELECT f.book_id, part_no, duration, text FROM fragments f JOIN bounds b ON f.book_id = b.book_id AND frag_idx >= start_idx AND frag_idx < end_idx),
g AS (SELECT book_id, part_no, duration, count(*) AS fragments, CAST(sum(len([x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> ''])) AS BIGINT) AS words FROM j GROUP BY ALL) SELECT *, CASE WHEN duration > 0 THEN round_even(words / (duration / 60), 1) END AS words_per_minute FROM g""")
def segment_rates(s, d):
    f = T.slice_by_boundaries(fragments(s, d), bounds(s, d).drop("duration"))
    return S.segment_rates(f, parts(s, d))


@query(f"WITH {FRAGMENTS} SELECT book_id, frag_idx, text FROM fragments WHERE upper(text) NOT IN (SELECT upper(trim(text)) FROM fragments WHERE frag_idx = 0) AND regexp_replace(upper(text), '\\s+\\d{{1,4}}$', '') NOT IN (SELECT upper(trim(text)) FROM fragments WHERE frag_idx = 0)")
def running_headers(s, d):
    f = fragments(s, d)
    return S.drop_running_headers(f, f.where("frag_idx = 0").select(F.col("text").alias("header")), "text")


# -- manifest: the flagship -----------------------------------------------------------------------------------


@query(f"""WITH {PARTS}, {FRAGMENTS}, {BOUNDS}, {_TIMED}, {_TIMELINE} SELECT t.book_id, t.part_no, frag_idx, round_even(start + "begin", 3) AS "begin", round_even(start + "end", 3) AS "end", "begin" AS local_begin, "end" AS local_end FROM timed t JOIN timeline l ON t.book_id = l.book_id AND t.part_no = l.part_no""")
def manifest_rows(s, d):
    t = T.timeline(parts(s, d), order="part_no").select("book_id", "part_no", "start")
    j = dealt(_timed(s, d), "book_id", "part_no").join(t, ["book_id", "part_no"])
    return j.select("book_id", "part_no", "frag_idx", X.round3(F.col("start") + F.col("begin")).alias("begin"), X.round3(F.col("start") + F.col("end")).alias("end"), F.col("begin").alias("local_begin"), F.col("end").alias("local_end"))


def book_units(s, d) -> tuple[DataFrame, DataFrame]:
    """Each part of a book as a chapter, and its time-coded paragraphs."""
    chapters = book_parts(s, d).select("book_id", F.lit("chapter").alias("kind"), F.col("part_no").alias("number"), F.format_string("Unit %03d", F.col("part_no")).alias("title"), "part_no", "duration")
    return chapters, _timed(s, d).select("book_id", "part_no", "frag_idx", X.fragment_id(F.col("frag_idx") + 1).alias("id"), "text", "begin", "end")


@query()
def manifest(s, d):
    return M.manifest(*book_units(s, d))
