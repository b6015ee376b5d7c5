from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import kernels as K
from lectern.operators import structure as S


def one(spark, function, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v")).alias("o")).collect()]


def test_sentences(spark):
    text = "Chapter 1 Introduction\nFirst sentence. Second sentence? Third sentence!"
    got = one(spark, X.split_sentences, text, "One sentence.\n27\nNext sentence.", "J. K. Rowling said (e.g. to Mr. X) \"No.\" Then left?! Yes.", None, "")
    assert got[0] == ["Chapter 1 Introduction", "First sentence.", "Second sentence?", "Third sentence!"]
    assert got[1] == ["One sentence.", "Next sentence."]
    assert got[2] == ['J. K. Rowling said (e.g. to Mr. X) "No."', "Then left?!", "Yes."]
    assert got[3] is None and got[4] == []


def test_numbers_and_times(spark):
    assert one(spark, X.chapter_number, "12", "Thirty-Eight", "TWENTY two", "x", None) == [12, 38, 22, None, None]
    assert one(spark, X.timestamp_seconds, "00:00:03,000", "1:02", "4.5", "1:2:3:4", "x") == [3.0, 62.0, 4.5, None, None]
    assert one(spark, lambda c: X.format_clock(c.cast("double")), "3723.9", "59", "-3", None) == ["1:02:03", "0:59", "0:00", "0:00"]
    assert one(spark, lambda c: X.chapter_word(c.cast("int")), "22", "0", "39", "1") == ["Twenty Two", None, None, "One"]


def test_cleaning(spark):
    assert one(spark, X.clean_text, "“a”\r\n‘b’—c–d\f\u0091") == ["\"a\"\n'b' - c-d\n\n"]
    assert one(spark, X.strip_dangling_figure, "It rose (see Figs.", "as in Fig.", "plain") == ["It rose", "as", None]
    assert one(spark, X.prose_after_figure_number, "3) and so", "3 and 4, which fell.", "no") == ["and so", "", None]
    assert one(spark, X.trim_back_matter, "a\nText copyright x\nb") == ["a\n"]


def test_kernels():
    assert K.reflow("The wor-\nld is round and\nwide.\nNext one\n\n\n\nEnd") == "The world is round and wide.\nNext one\n\nEnd"
    assert K.title_case("THE ORDER OF THE DAY'S END") == "The Order of the Day's End"
    assert K.html_to_text("<p>a &amp;amp; b</p><script>x</script><b>c</b> <i>d</i><br>e") == "a & b\ncd\ne"
    found = K.chapters("CHAPTER ONE\nCHAPTER TWO\nCHAPTER ONE\nFirst Title\n\nbody one\nCHAPTER TWO - x\nSecond Title\n\nbody two\nText copyright", {}, 2)
    assert [c["chapter_no"] for c in found] == [1, 2]
    assert K.paragraphs("T      he start of\nit.\nNew one here.\n     Indented line\nand more.\n12\n\nLast", frozenset()) == ["The start of it.", "New one here.", "Indented line and more.", "Last"]
    assert K.align(["a b", "zz"], ["x", "a b c"]) == [(1, 1.0), (None, 0.0)]


def test_figures_fold(spark):
    rows = [(1, 1, 0, "It rose (see Figs."), (1, 1, 1, "3) and fell"), (1, 1, 2, "Plain in Fig."), (1, 1, 3, "Other.")]
    out = S.repair_figure_refs(spark.createDataFrame(rows, "book_id int, chapter_no int, frag_idx int, text string")).orderBy("frag_idx").collect()
    assert [r.text for r in out] == ["It rose and fell.", "Plain.", "Other."]


def test_citations_are_put_together(spark):
    out = S.merge_citations(fragments(spark, "As (Mill 1940:", "3), he said", "Next.")).orderBy("frag_idx").collect()
    assert [r.text for r in out] == ["As (Mill 1940: 3), he said", "Next."]


def fragments(spark, *texts):
    return spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(texts)], "book_id int, chapter_no int, frag_idx int, text string")


def test_only_a_bare_figure_begins_a_block(spark):
    got = S.drop_figure_blocks(fragments(spark, "Caption first", "One.", " Fig. ", "Caption a", "Caption b", "Fig. 3 shows that it rose.", "Caption c", "Fig."), ["Caption"])
    assert [r.text for r in got.orderBy("frag_idx").collect()] == ["Caption first", "One.", "Fig. 3 shows that it rose.", "Caption c"]


def test_audit_counts_words_not_characters(spark):
    texts = ["It rose (see Figs.", "Fig.", "Fig. 3 shows it.", "Mill 1940: 3", "by Mill et al.", "open (", "one two three four five six seven eight)", "a b c d e f g h i)", "extraordinarily incomprehensible representations notwithstanding internationalisation)"]
    got = {r.frag_idx: r.reason for r in S.audit_fragments(fragments(spark, *texts)).collect()}
    assert got == {0: "dangling figure", 1: "caption", 3: "orphan citation", 4: "et al.", 5: "unmatched (", 6: "short unmatched )", 8: "short unmatched )"}


def test_short_chapters_are_counted_without_their_heading(spark):
    body = lambda n: "\n\n".join(f"Paragraph {k} is here." for k in range(n))
    chapters = spark.createDataFrame([(1, 1, body(5)), (1, 2, body(4)), (2, 1, body(6)), (2, 3, None)], "book_id int, chapter_no int, body string")
    got = sorted((r.book_id, r.chapter_no or 0, r.problem) for r in S.chapter_problems(chapters, 2).collect())
    assert got == [(1, 2, "few paragraphs"), (2, 0, "chapters not 1..n"), (2, 3, "few paragraphs")]


def test_titles_and_marked_chapters():
    assert K.split_title(["", "SOME LINE", "THE LONG", "TITLE", "", "Body here.", "more"], "The Long Title") == ("The Long Title", ["Body here.", "more"])
    assert K.split_title(["the body starts here.", "x"], None) == ("", ["the body starts here.", "x"]) and K.split_title(["", " "], "T") == ("", [])
    found = K.marked_chapters("0\n1\nThe First\nbody one\n 2 \n\nThe  Second\nbody two\nINDEX\nx", [{"chapter_no": n, "marker_title": t, "display_title": t.upper()} for n, t in ((1, "the first"), (2, "the second"), (3, "third"))])
    assert [(c["title"], c["body"], c["problem"]) for c in found] == [("THE FIRST", "body one", None), ("THE SECOND", "body two", None), ("THIRD", None, "marker not found")]
