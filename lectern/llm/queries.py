"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import archive, decontamination, fingerprints, language, lengths, local_search, near_duplicates, packing, periodic_runs, phrases, site_style, substrings, token_files
from lectern.llm.batches import release, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of documents whose crc32(doc_id) mod 4 is 2 are held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.train(docs, where=~held_out & F.col("doc_id").isNotNull())
    found = language.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), shared_folder(spark, "token-files"))
    return token_files.read_token_files(manifest)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.drop_repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_table(lengths.encoded_lengths(_table(spark, sf_dir, "documents")))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op9_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "archive")
    archive.write_archive(_table(spark, sf_dir, "pages"), folder)
    release(spark)  # the payloads' shuffle, before records are made again
    record = archive.rebuild_records(spark, folder)
    block = F.octet_length("record") - F.col("block_start") - len(archive.END) * 2  # of the record's bytes; a revisit has none of its own
    size = F.when(F.col("record_type") == "response", block).otherwise(F.octet_length("payload")).cast("long")
    return record.select("page_id", size.alias("payload_bytes"), F.lower(F.hex("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(_table(spark, sf_dir, "pages"))


def op11_local_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_search.pack(_table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, by crc32 of the id, is made periodic first, as the contract says."""
    return periodic_runs.find_runs(_table(spark, sf_dir, "documents"), planted=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_language, op3_fingerprints, op4_token_files, op5_decontamination, op6_substrings, op7_token_counts, op8_near_duplicates, op9_archive, op10_main_text, op11_local_search, op12_phrases, op13_periodic_runs)
}

ORACLES = {
    "op12_phrases": r"""
WITH p AS (SELECT lang, [x for x in string_split(translate(piece, chr(9), ' '), ' ') if x <> ''] AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS t(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 10),
u AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE m = 3),
v AS (SELECT lang, phrase, max(a) AS around FROM u GROUP BY ALL),
k AS (SELECT c.*, unnest(range(1, m)) AS cut FROM c LEFT JOIN v USING (lang, phrase) WHERE around IS NULL OR around * 100 < a * 50),
s AS (SELECT k.lang, k.phrase, k.a, cut, x.a AS l, y.a AS r, CAST(1000000 * (CAST(k.a AS HUGEINT) * k.a) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(list_slice(w, 1, cut), ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(list_slice(w, cut + 1, len(w)), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM o JOIN t USING (lang) WHERE rank <= 2000""",
    "op6_substrings": r"""
WITH d AS (SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(list_slice(w, k, k + 12), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING count(*) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM g JOIN m USING (s) WHERE first < doc_id),
l AS (SELECT doc_id, list(k) AS gone FROM r GROUP BY doc_id),
o AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string([w[i] for i in range(1, len(w) + 1) if NOT list_contains(gone, i)], ' ')) AS kept_sha256
FROM o""",
    "op9_archive": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM k GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM k JOIN f USING (payload_digest)""",
}
