import re

from lectern.plans import jobs
from lectern.plans.queries import QUERIES


def test_anchors_cut_a_chapter_into_timed_intervals(spark):
    texts = ["The roman collapse was expensive", "Energy returns declined", "Something else entirely", "Complex societies need more", "The end"]
    fragments = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(texts)], "book_id int, chapter_no int, frag_idx int, text string")
    clips = spark.createDataFrame([("a", 1, 1, "energy returns declined", 100.0, 2.0), ("b", 1, 1, "complex societies need more", 300.0, 0.0), ("c", 1, 1, "zzz", 50.0, 0.0)], "clip_id string, book_id int, chapter_no int, text string, clip_start double, first_start double")
    durations = spark.createDataFrame([(1, 1, 400.0)], "book_id int, chapter_no int, duration double")
    out = jobs.anchored_times(fragments, clips, durations).orderBy("frag_no").collect()
    assert [r.frag_idx for r in out] == [0, 1, 2, 3, 4] and [r.id for r in out] == [f"f{k:06d}" for k in range(1, 6)]
    assert [(out[i].begin, out[j].end) for i, j in ((0, 0), (1, 2), (3, 4))] == [(0.0, 102.0), (102.0, 300.0), (300.0, 400.0)]
    assert out[1].end == out[2].begin and out[3].end == out[4].begin
    manual = spark.createDataFrame([(1, 1, 200.0, 2)], "book_id int, chapter_no int, time double, idx bigint")
    assert [r.begin for r in jobs.anchored_times(fragments, clips, durations, manual).orderBy("frag_no").collect()][2] == 200.0


def test_a_book_of_chapters_becomes_a_manifest(spark):
    text = "CHAPTER ONE\nOne\n\nFirst paragraph here.\n\nSecond paragraph.\n\nCHAPTER TWO\nTwo\n\nThird paragraph.\n"
    books = spark.createDataFrame([(1, text)], "book_id int, text string")
    parts = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0), (1, 3, 5.0), (1, 4, 6.0)], "book_id int, part_no int, duration double")
    (m,) = jobs.chaptered_manifest(books, parts, {1: "One", 2: "Two"}, 2).collect()
    assert m.duration == 35.0
    assert [(c.kind, c.number, c.title, c.start, c.end) for c in m.chapters] == [("chapter", 1, "One", 0.0, 10.0), ("chapter", 2, "Two", 10.0, 30.0), ("outro", None, "Outro", 30.0, 35.0)]
    assert [p.text for p in m.chapters[0].paragraphs] == ["Chapter One. One.", "First paragraph here.", "Second paragraph."]
    assert m.chapters[1].paragraphs[0].begin == 10.0 and m.chapters[1].paragraphs[-1].end == 30.0 and m.chapters[2].paragraphs is None


def test_books_are_cut_once_and_their_texts_shuffled_once(spark):
    plan = QUERIES["chaptered_books"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython [") == 1
    assert len(re.findall(r"Exchange hashpartitioning\(", plan)) <= 3  # texts, parts, and the books' keys, if they aren't broadcast


def test_chapters_without_parts_and_parts_without_chapters(spark):
    text = "CHAPTER ONE\nOne\n\nFirst paragraph here.\n\nCHAPTER TWO\nTwo\n\nSecond.\n"
    books = spark.createDataFrame([(1, text), (2, "no chapters"), (3, text), (4, None), (5, ""), (None, text), (6, text), (7, text)], "book_id int, text string")
    rows = [(1, 1, 10.0), (2, 1, 5.0), (2, 2, 5.0), (4, 1, 5.0), (5, 1, 5.0), (6, 1, 1.0), (6, 2, None), (6, 4, 2.0), (None, 1, 1.0), (7, 2, 0.0), (7, 1, 4.0), (7, 3, 9.0), (7, 4, 9.0), (8, 1, 3.0)]
    parts = spark.createDataFrame(rows, "book_id int, part_no int, duration double")
    got = {m.book_id: m for m in jobs.chaptered_manifest(books, parts, {1: "One", 2: "Two"}, 2).collect()}
    assert sorted(got) == [1, 6, 7]  # of the others no chapter has a part
    assert [(c.kind, c.number, c.part_no, len(c.paragraphs)) for c in got[1].chapters] == [("chapter", 1, 1, 2)] and got[1].duration == 10.0
    assert [(c.kind, c.part_no, c.start, c.end) for c in got[6].chapters] == [("chapter", 1, 0.0, 1.0), ("chapter", 2, 1.0, None)]
    assert [(c.kind, c.title, c.part_no, c.start, c.end) for c in got[7].chapters] == [("chapter", "One", 1, 0.0, 4.0), ("chapter", "Two", 2, 4.0, 4.0), ("outro", "Outro", 3, 4.0, 13.0)]
    assert [p.id for p in got[7].chapters[1].paragraphs] == ["c002_f000001", "c002_f000002"] and got[7].chapters[2].paragraphs is None
