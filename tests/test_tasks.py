import re

import pytest

from lectern.operators import audio as A
from lectern.operators import tasks
from lectern.operators import timeline as T
from lectern.plans import files, jobs  # noqa: F401 - register rank_parts and anchored_alignment
from lectern.plans.queries import QUERIES


def dealt_by_number(df):
    return re.search(r"hashpartitioning\([^)]*\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString()) is not None


@pytest.mark.parametrize("name", ["rank_parts", "proportional_times", "merge_segments", "merge_intervals", "manifest_rows", "active_paragraph", "paragraph_changes", "single_alignment_bounds"])
def test_shuffles_grow_with_the_files(spark, monkeypatch, name):
    d = "/root/testdata/sf0.001"
    plain = QUERIES[name](spark, d)
    monkeypatch.setattr(tasks, "FILE_BYTES", 15_000)
    dealt = QUERIES[name](spark, d)
    assert dealt_by_number(dealt) and not dealt_by_number(plain)
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_small_or_unknown_tables_are_not_dealt(spark):
    small = spark.range(10).withColumnRenamed("id", "book_id")
    unknown = spark.createDataFrame(small.rdd, small.schema)
    assert tasks.dealt(small, "book_id") is small
    assert tasks.source_bytes(unknown) == 0


def test_dealt_operators_keep_their_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tasks, "FILE_BYTES", 100)
    seg = [(b, p, i, float(i), i + 1.0) for b in range(5) for p in (1, 2) for i in range(3)]
    spark.createDataFrame(seg, "book_id int, segment_no int, frag_idx int, begin double, end double").write.parquet(str(tmp_path / "f"))
    dur = spark.createDataFrame([(b, p, 10.0 * p) for b in range(5) for p in (1, 2)], "book_id int, segment_no int, duration double")
    out = T.merge_segments(spark.read.parquet(str(tmp_path / "f")), dur)
    assert [tuple(r) for r in out.orderBy("book_id", "frag_no").select("book_id", "frag_no", "begin").collect()] == [(b, k + 1, float(k % 3 + 10 * (k // 3))) for b in range(5) for k in range(6)]
    paths = [(f"a/{k}/{n:03d} x.mp3",) for k in range(5) for n in (2, 1)]
    spark.createDataFrame(paths, "path string").write.parquet(str(tmp_path / "p"))
    assert [(r.path, r.part_no) for r in A.rank_parts(spark.read.parquet(str(tmp_path / "p"))).orderBy("path").collect()] == [(f"a/{k}/{n:03d} x.mp3", n) for k in range(5) for n in (1, 2)]


def test_containment_normalises_the_books_once(spark):
    out = QUERIES["match_anchor_containment"](spark, "/root/testdata/sf0.001")
    assert not [f for f in out.inputFiles() if f.endswith("documents.parquet")]  # it reads the normalised texts, which are stored


def test_anchored_alignment_matches_once(spark):
    out = QUERIES["anchored_alignment"](spark, "/root/testdata/sf0.001")
    assert not [f for f in out.inputFiles() if "conversations.parquet" in f]  # fragments, anchors and bounds are stored, each made once
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and out.count() > 0
