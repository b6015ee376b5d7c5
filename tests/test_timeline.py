import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import audio as A
from lectern.operators import matching as M
from lectern.operators import structure as S
from lectern.operators import timeline as T
from lectern.sources import readers, sinks
from lectern.streaming import playback as P


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_allocation_keeps_all_and_empties_none(spark):
    counts = spark.createDataFrame([(1, 6), (2, 2)], "book_id int, n bigint")
    parts = spark.createDataFrame([(b, k, float(k)) for b in (1, 2) for k in (1, 2, 3)], "book_id int, part_no int, duration double")
    out = rows(T.allocation_bounds(counts, parts).select("book_id", "part_no", "start_idx", "end_idx", "problem"), "book_id", "part_no")
    assert out[:3] == [(1, 1, 0, 1, None), (1, 2, 1, 3, None), (1, 3, 3, 6, None)]
    assert {r[4] for r in out[3:]} == {"fewer fragments than parts"}


def test_merges_gaps_overrides(spark):
    seg = spark.createDataFrame([(1, 1, 0, 0.0, 5.0), (1, 2, 0, 0.0, 4.0)], "book_id int, segment_no int, frag_idx int, begin double, end double")
    dur = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0)], "book_id int, segment_no int, duration double")
    assert [(r.id, r.begin) for r in T.merge_segments(seg, dur).orderBy("frag_no").collect()] == [("f000001", 0.0), ("f000002", 10.0)]
    gap = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, None, None), (1, 2, 8.0, 9.0)], "book_id int, frag_idx int, begin double, end double")
    assert [(r.begin, r.end) for r in T.interpolate_gaps(gap, F.lit(0.0), F.lit(9.0)).orderBy("frag_idx").collect()][1] == (2.0, 8.0)
    frag = spark.createDataFrame([(1, 1, 0, "a", 0.0, 90.0), (1, 1, 1, "Go on", 100.0, 110.0), (1, 1, 2, "b", 110.0, 120.0)], "book_id int, chapter_no int, frag_idx int, text string, begin double, end double")
    over = spark.createDataFrame([(1, 1, "Go", 8119.0)], "book_id int, chapter_no int, text_prefix string, local_begin double")
    assert [r.begin for r in T.apply_overrides(frag, over).orderBy("frag_idx").collect()] == [0.0, 8119.0, 8129.0]


def test_points_windows_spans(spark):
    pts = spark.createDataFrame([(1, 1, 1200.0, 2)], "book_id int, chapter_no int, time double, idx bigint")
    man = spark.createDataFrame([(1, 1, 8119.0, 3)], "book_id int, chapter_no int, time double, idx bigint")
    ends = spark.createDataFrame([(1, 1, 5, 9000.0)], "book_id int, chapter_no int, n bigint, duration double")
    b = T.boundaries(pts, ends, man).orderBy("fragment_start").collect()
    assert [(r.fragment_start, r.fragment_end, r.time_end) for r in b] == [(0, 2, 1200.0), (2, 3, 8119.0), (3, 5, 9000.0)]
    w = T.anchor_windows(spark.createDataFrame([(1, 1250.0)], "book_id int, duration double")).orderBy("clip_start").collect()
    assert [(r.clip_start, r.clip_length) for r in w] == [(0.0, 30.0), (600.0, 30.0), (1200.0, 30.0)]
    entries = spark.createDataFrame([(1, 0, "Chapter 1: A", 0, 0.0), (1, 1, "Chapter 2: B", 0, 40.0), (1, 2, "Chapter 3: C", 1, 0.0), (1, 3, "Credits", 1, 180.0)], "book_id int, pos int, title string, spine_index int, offset double")
    spine = spark.createDataFrame([(1, 0, 100.0), (1, 1, 200.0)], "book_id int, spine_index int, duration double")
    assert [r.end for r in A.spans_from_metadata(entries, spine).orderBy("number").collect()] == [40.0, 100.0, 180.0]


def test_anchor_match_and_times(spark):
    frag = spark.createDataFrame([(1, 1, 0, "Something else entirely"), (1, 1, 1, "Roman collapse was expensive.")], "book_id int, chapter_no int, frag_idx int, text string")
    clips = spark.createDataFrame([("x", 1, 1, "Roman collapse was expensive", 600.0, 2.0), ("y", 1, 1, "qqqq", 0.0, 0.0)], "clip_id string, book_id int, chapter_no int, text string, clip_start double, first_start double")
    got = {r.clip_id: (r.frag_idx, r.time) for r in M.match_anchor(clips, frag).collect()}
    assert got == {"x": (1, 602.0), "y": (None, None)}
    seg = spark.createDataFrame([(1, 1, 0, 10.0, 20.0, "something else entirely roman collapse was expensive")], "book_id int, chapter_no int, seg_idx int, start double, end double, text string")
    timed = M.assign_times(frag, seg).orderBy("frag_idx").collect()
    assert timed[0].begin == 10.0 and timed[-1].end == 20.0 and {r.status for r in timed} == {"matched"}


def test_every_whole_turn_is_a_clip(spark, tmp_path):
    from lectern.plans import queries as Q

    turns = [(1, 0, "user", "Tell me. How did the empire fall?"), (1, 1, "assistant", "Slowly, and at great expense."), (1, 2, "user", "Tell me. How did it end?"), (1, 3, "user", ""), (2, 0, "user", "Go on"), (2, 1, "user", "!!")]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.clip_id: (r.text, r.frag_idx) for r in Q.match_anchor(spark, str(tmp_path)).collect()}
    frag = Q._turn_fragments(spark, str(tmp_path)).collect()
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    want = {}
    for conv, turn, _, text in turns:
        held = [f.frag_idx for f in frag if f.book_id == conv and norm(f.text) and norm(text) and (norm(f.text) in norm(text) or norm(text) in norm(f.text))]
        want[f"{conv}-{turn}"] = (text, min(held, default=None))
    assert got == want


def test_sources_and_sinks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package><metadata><title>My  Book</title></metadata><manifest><item id="a" href="a.html" media-type="application/xhtml+xml"/><item id="b" href="b.html" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("O/a.html", "<p>first</p>")
        z.writestr("O/b.html", "<p>second</p>")
    book = readers.read_epubs(spark, str(tmp_path / "*.epub")).collect()[0]
    assert (book.title, book.text) == ("My Book", "second\n\nfirst")
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text(json.dumps({"transcription": [{"timestamps": {"from": "00:00:03,000", "to": "00:00:04,500"}, "offsets": {"from": 1, "to": 2}, "text": " a  b "}]}))
    (tmp_path / "t/b.json").write_text(json.dumps([{"start": 1.0, "end": 2.0, "text": "c"}]))
    assert sorted((r.start, r.end, r.text) for r in readers.read_transcripts(spark, str(tmp_path / "t")).collect()) == [(1.0, 2.0, "c"), (3.0, 4.5, "a b")]
    frag = spark.createDataFrame([(1, 1, 1, "b"), (1, 1, 0, "a")], "book_id int, chapter_no int, frag_idx int, text string")
    sinks.write_chapter_files(frag, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).select("value").collect()] == ["a", "b"]
    sinks.write_book_text(frag, str(tmp_path / "books"))
    assert [tuple(r) for r in readers.read_book_text(spark, str(tmp_path / "books"), lines=True).collect()] == [("1", "a\nb")]


def test_sources_report_what_they_cannot_use(spark, tmp_path):
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    book = readers.read_epubs(spark, str(tmp_path / "*.epub")).collect()
    assert [(b.title, b.text, b.problem) for b in book] == [("bad", "", "no text")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text("[]")
    (tmp_path / "t/b.json").write_text(json.dumps({"segments": [{"start": 2.0, "end": 1.0, "text": "x"}]}))
    (tmp_path / "t/c.json").write_text("no json")
    found = readers.read_transcripts(spark, str(tmp_path / "t")).collect()
    assert len(found) == 3 and {(r.seg_idx, r.text, r.problem) for r in found} == {(None, None, "no usable segment")}


def test_text_files_and_markdown_are_one_row_a_file(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Head\n\nOne **bold** word. Two [links](x).")
    assert [r.text for r in readers.read_book_text(spark, str(tmp_path / "a.md")).collect()] == ["# Head\n\nOne **bold** word. Two [links](x)."]
    found = readers.read_markdown(spark, str(tmp_path / "a.md")).orderBy("frag_idx").collect()
    assert [r.frag_idx for r in found] == list(range(len(found))) and found[-1].text == "Two links."


def test_verbose_transcripts_alignments_and_metadata(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"text": " ", "segments": [{"start": 0, "end": 1, "text": " a  b "}, {"text": ""}], "words": [{"word": "a", "text": "z"}, {"text": "b"}]}))
    v = readers.read_verbose_transcripts(spark, str(tmp_path / "v.json")).collect()[0]
    assert (v.text, [x.text for x in v.segments], [x.text for x in v.words]) == ("a b", ["a b"], ["a", "b"])
    (tmp_path / "a.json").write_text(json.dumps({"fragments": [{"id": "f1", "begin": "0.5", "end": "x", "lines": ["a", "b"]}]}))
    assert [tuple(r)[1:] for r in readers.read_alignments(spark, str(tmp_path / "a.json")).collect()] == [(0, "f1", 0.5, None, "a b")]
    (tmp_path / "m.json").write_text(json.dumps({"spine": [{"duration": 5.5}], "chapters": [{"title": "Chapter 1: A", "spine": 0, "offset": 1.5}]}))
    entries, spine = readers.read_audiobook_metadata(spark, str(tmp_path / "m.json"))
    assert [tuple(r)[1:] for r in entries.collect()] == [(0, "Chapter 1: A", 0, 1.5)] and [tuple(r)[1:] for r in spine.collect()] == [(0, 5.5)]


def test_audio_parts_are_the_best_tier_of_a_folder(spark, tmp_path):
    for name in ("p/Part 10.mp3", "p/Part 2.mp3", "p/001 x.mp3", "n/002 b.mp3", "n/001 a.mp3", "n/z.mp3", "o/z.mp3", "o/b.mp3", "o/c.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = readers.list_audio_parts(spark, str(tmp_path)).orderBy("dir", "part_no").collect()
    assert [(r.name, r.number) for r in found] == [("001 a.mp3", 1), ("002 b.mp3", 2), ("b.mp3", 10000), ("z.mp3", 10000), ("Part 2.mp3", 2), ("Part 10.mp3", 10)]


def test_forced_units_take_the_place_of_the_old(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "u int, v string")
    sinks.write_units(df, str(tmp_path / "u"), ("u",))
    sinks.write_units(spark.createDataFrame([(2, "c")], "u int, v string"), str(tmp_path / "u"), ("u",), force=True)
    assert sorted((r.u, r.v) for r in spark.read.parquet(str(tmp_path / "u")).collect()) == [(1, "a"), (2, "c")]


def test_stream_equals_batch(spark, tmp_path):
    para = spark.createDataFrame([(1, 1, 0, 0.0, 5.0), (1, 1, 1, 5.0, 90.0)], "book_id int, chapter_no int, frag_idx int, begin double, end double")
    ev = spark.createDataFrame([(7, k, k, 1, 1, float(t)) for k, t in enumerate([1, 2, 6, 70, 95, 3])], "user_id int, position_id bigint, ts bigint, book_id int, chapter_no int, t double")
    ev.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = P.active_paragraph_stream(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "e")), para)
    q = stream.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = sorted((r.position_id, r.frag_idx) for r in P.paragraph_changes(ev, para).collect())
    assert sorted((r.position_id, r.frag_idx) for r in spark.table("changes").collect()) == want and len(want) == 4


def test_progress_goes_on_within_one_audio_only(spark):
    chapters = spark.createDataFrame([(1, 1, 0.0, 10.0, "a"), (1, 2, 10.0, 10.0, "a"), (1, 3, 20.0, 0.0, "b")], "book_id int, chapter_no int, start double, duration double, audio string")
    at = spark.createDataFrame([(1, 1, 1, 9.9), (2, 1, 2, 9.9), (3, 1, 1, -1.0), (4, 1, 1, 0.005), (5, 1, 3, 2.0), (6, 1, 2, 12.0)], "position_id int, book_id int, chapter_no int, t double")
    got = {r.position_id: (r.local, r.permille, r.clock, r.advance) for r in P.chapter_progress(at, chapters).collect()}
    assert got == {1: (9.9, 990, 9.9, True), 2: (9.9, 990, 19.9, False), 3: (0.0, 0, 0.0, False), 4: (0.005, 1, 0.005, False), 5: (2.0, 0, 22.0, False), 6: (12.0, 1000, 22.0, False)}


def test_spans_and_alignments_that_break_rules(spark):
    spine = spark.createDataFrame([(1, 0, 100.0)], "book_id int, spine_index int, duration double")
    spans = spark.createDataFrame([(1, 1, 0, 0.0, 40.0), (1, 2, 0, 40.0, 40.0), (1, 3, 7, 0.0, 5.0)], "book_id int, number int, spine_index int, start double, end double")
    assert rows(A.span_problems(spans, spine).select("number", "problem"), "number") == [(2, "no duration"), (3, "spine out of range")]
    aligned = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "book_id int, frag_idx int")
    need = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 2), (3, 1, 1)], "book_id int, chapter_no int, n int")
    assert [r[0] for r in rows(T.short_alignments(aligned, need).select("book_id"), "book_id")] == [2, 3]
    with pytest.raises(ValueError):
        T.anchor_windows(spark.createDataFrame([(1, 5.0)], "book_id int, duration double"), step=0)


def test_allocated_texts_are_the_slices_of_the_bounds(spark):
    books = [(b, [f"s{b}.{k}" for k in range(n)]) for b, n in ((1, 6), (2, 2), (3, 0), (4, 17))]
    parts = spark.createDataFrame([(b, k, float(k % 3)) for b in (1, 2, 3, 4, 5) for k in (1, 2, 3)], "book_id int, part_no int, duration double")
    frame = spark.createDataFrame(books, "book_id int, fragments array<string>")
    counts = frame.select("book_id", F.size("fragments").cast("long").alias("n"))
    fragments = frame.select("book_id", F.posexplode("fragments").alias("frag_idx", "text"))
    want = T.slice_by_boundaries(fragments, T.allocation_bounds(counts, parts)).select("book_id", "part_no", "frag_idx", "text")
    got = T.allocated_texts(S.book_fragments(frame.withColumnRenamed("fragments", "text"), split=lambda c: c), parts).select("book_id", "part_no", "frag_idx", "text")
    assert rows(got, "book_id", "frag_idx") == rows(want, "book_id", "frag_idx") != []
