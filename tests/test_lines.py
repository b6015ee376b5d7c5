"""Books as tables of lines give what the rules on whole texts give, wherever blocks end."""

import random

import pytest

from lectern.functions import text as X
from lectern.operators import kernels as K
from lectern.operators import lines as L
from lectern.plans.queries import QUERIES
from lectern.sources import readers

PIECES = ["The end of it.", "An Old Part", "and so on", "com-", "pound", "- - -", "", "", "  An indented one", "\tTabbed line", " \tMore tabs", "12", "13 THE FIRST PART", "The First Part 14", "Mr. A.", "A.", "Who?", "“Yes.”", "\"Then\" he said:", "a well-be-", "having word", "x\x0by", "Éa part", "A  dog", "CHAPTER  Two", "1", "No stop here but it goes on and on", "Short; ", "     ", "—dash", "\f"]


def made(rng, lines):
    return "\n".join(rng.choice(PIECES) for _ in range(lines))


@pytest.fixture(scope="module")
def books(spark):
    rng = random.Random(4)
    rows = [(i, made(rng, rng.choice([1, 3, 40, 120]))) for i in range(40)] + [(90, None), (91, ""), (92, "\n\n"), (93, "one"), (None, "Null key.\nits line")]
    return rows, spark.createDataFrame(rows, "book_id long, text string").repartition(3)


@pytest.mark.parametrize("block", [5, 8192])
def test_reflow_and_paragraphs(books, block):
    rows, df = books
    lines = L.text_lines(df)
    got = {}
    for r in sorted(L.reflow_lines(lines, block=block).collect(), key=lambda r: r.line_no):
        got.setdefault(r.book_id, []).append((r.line_no, r.line))
    for book, text in rows:
        want = K.reflow(text or "")
        assert "\n".join(x for _, x in got.get(book, [])) == want, (book, text)
        assert len({n for n, _ in got.get(book, [])}) == len(got.get(book, []))
    for header in (None, r"x.?y"):
        got = {}
        for r in sorted(L.paragraphs_of_lines(lines, headers=["The First Part"], header=header, block=block).collect(), key=lambda r: r.frag_idx):
            got.setdefault(r.book_id, []).append((r.frag_idx, r.text))
        for book, text in rows:
            want = K.paragraphs(text or "", frozenset(["THE FIRST PART"]), header)
            assert got.get(book, []) == list(enumerate(want)), (book, text)


@pytest.mark.parametrize("block", [4, 8192])
def test_chapters(spark, block):
    rng = random.Random(7)
    heads = ["CHAPTER {w}", "  Chapter {n} - more", "\tchapter {w}", "CHAPTER {w} : on"]
    words = X.number_words()

    def book():
        out, n = [made(rng, 4)], rng.choice([1, 1, 1, 3])
        for _ in range(6):
            k = n if rng.random() < 0.8 else rng.randint(1, 9)
            n += k == n
            out += [rng.choice(heads).format(w=words[k - 1], n=k), rng.choice(["", "THE FIRST\nPART\n", "The First Part\n\n", "no title here it is."]), made(rng, rng.choice([0, 2, 15]))]
        return "\n".join([*out, rng.choice(["", "Text copyright 2020\nrest", "x"])])

    rows = [(i, book()) for i in range(30)] + [(60, None), (61, ""), (62, "CHAPTER ONE"), (63, "no chapters"), (None, "CHAPTER ONE\nOne\n\nbody")]
    titles = {1: "The First Part", 4: "Elsewhere"}
    df = spark.createDataFrame(rows, "book_id long, text string").repartition(3)
    got = {(r.book_id, r.chapter_no): (r.title, r.body) for r in L.chapters_of_lines(L.text_lines(df), titles, 7, block).collect()}
    want = {(i, c["chapter_no"]): (c["title"], c["body"]) for i, t in rows for c in K.chapters(t or "", titles, 7)}
    assert len(want) > 60 and got == want


def test_empty_table_and_null_lines(spark):
    empty = spark.createDataFrame([], "book_id long, line_no long, line string")
    assert L.reflow_lines(empty).collect() == L.paragraphs_of_lines(empty).collect() == L.chapters_of_lines(empty).collect() == []
    some = spark.createDataFrame([(1, 0, "One"), (1, 1, None), (1, 2, "two")], "book_id long, line_no long, line string")
    assert [r.line for r in L.reflow_lines(some).orderBy("line_no").collect()] == ["One", "", "two"]
    assert [r.text for r in L.paragraphs_of_lines(some).orderBy("frag_idx").collect()] == ["One", "two"]


def test_files_of_several_splits(spark, tmp_path):
    """A file that is read by many tasks has its lines numbered through."""
    rng = random.Random(2)
    texts = {f"b{i}.txt": "\n".join(f"{rng.random()}{'é' * rng.randint(0, 9)}" for _ in range(n)) + end for i, (n, end) in enumerate([(4000, ""), (1, "\n"), (900, "\r\nlast\fone")])}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(str(tmp_path)).selectExpr("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 10
        df = readers.read_book_lines(spark, str(tmp_path))
        got = {}
        for r in df.collect():
            got.setdefault(r.book_id.rsplit("/", 1)[1], {})[r.line_no] = r.line
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, text in texts.items():
        assert [got[name][i] for i in range(len(got[name]))] == K.clean(text).splitlines()


def test_lines_that_a_cheap_test_lets_through_or_holds(spark):
    """What the tests of the raw line pass must be all that the rules drop."""
    texts = ["12", "  12  ", "—12", "’12", "· 12 ·", "chapter one", " Chapter Two", "12 THE HEADER", "cat", "A 12", "the first part", "  The First Part 13", "x The First Part", "", "9 Lives"]
    rows = [(1, i, t) for i, t in enumerate(x for t in texts for x in (t, "", f"kept {t}", ""))]
    lines = spark.createDataFrame(rows, "book_id long, line_no long, line string")
    got = [K.clean(r.text) for r in L.paragraphs_of_lines(lines, headers=["The First Part"], block=8).orderBy("frag_idx").collect()]
    want = [" ".join(t.split()) for t in K.paragraphs("\n".join(r[2] for r in rows), frozenset(["THE FIRST PART"]))]
    assert len(got) == len(want) and [g for g in got if not g.startswith("kept")] == [w for w in want if not w.startswith("kept")]


def test_paragraphs_read_and_shuffle_their_lines_once(spark, tmp_path):
    rng = random.Random(11)
    rows = [(b, i, rng.choice(PIECES)) for b in range(6) for i in range(rng.choice([3, 90]))]
    spark.createDataFrame(rows, "book_id long, line_no long, line string").write.parquet(str(tmp_path / "lines"))
    out = L.paragraphs_of_lines(spark.read.parquet(str(tmp_path / "lines")), block=8)
    assert out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1 and plan.count("ReusedExchange") == 1
    assert QUERIES["paragraphs_of_lines"](spark, "/root/testdata/sf0.001").inputFiles()[0].endswith("documents.parquet")  # nothing is stored


def test_paragraphs_over_many_blocks_and_missing_lines(spark):
    """Blocks in which nothing begins or ends, first blocks without lines, null keys: as the kernel on the lines in order."""
    rng = random.Random(12)
    flat = ["The end of it.", "and so on", "com-", "pound", "12", "Éa part", "a well-be-", "Who?\"", "No stop here"]
    texts = {b: [rng.choice(flat if rng.random() < 0.97 else PIECES[:10]) for _ in range(rng.choice([1, 20, 70]))] for b in [*range(12), None]}
    rows = [(b, i, x) for b, t in texts.items() for i, x in enumerate(t) if b is None or b % 3 == 0 or (i % 7 if b % 3 == 1 else i > 11)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "book_id long, line_no long, line string").repartition(3)
    for block in (1, 4, 9):
        got = {}
        for r in sorted(L.paragraphs_of_lines(df, block=block).collect(), key=lambda r: r.frag_idx):
            got.setdefault(r.book_id, []).append((r.frag_idx, r.text))
        for b in texts:
            kept = [x for k, _, x in sorted((r for r in rows if r[0] == b), key=lambda r: r[1]) if k == b]
            assert got.get(b, []) == list(enumerate(K.paragraphs("\n".join(kept)))), (b, block)
