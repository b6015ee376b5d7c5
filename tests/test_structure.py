"""Repairs of fragments against plain folds, chapters and paragraphs against their rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import lines as L
from lectern.operators import structure as S
from lectern.sources import readers

NAME_YEAR = r"[A-Z][A-Za-z' \-]+ \d{4}:"


def fold_citations(texts):
    """The rule as it is told: one fragment after another."""
    out, rest = [], [t.strip() for t in texts]
    ended = lambda t: t[-1:] in (".", "?", "!")
    while rest:
        t = rest.pop(0)
        if out and not ended(out[-1]) and re.match(rf"([A-Z](\.\s*)?\s*)?{NAME_YEAR}", t):
            out[-1] = f"{out[-1]} {t}"
        elif not re.search(rf"\b{NAME_YEAR}$", t):
            out.append(t)
        else:
            run = [t]
            while rest and not (len(run) > 1 and ended(run[-1])) and re.match(rf"\d+[),;:\-]|((and\s+)?[A-Z](\.\s*)?\s*)?{NAME_YEAR}", rest[0]):
                run.append(rest.pop(0))
            alone = re.sub(rf"\s*\([^()]*\b{NAME_YEAR}$", "", t).strip()
            if len(run) > 1:
                out.append(" ".join(run))
            elif alone:
                out.append(alone if ended(alone) else f"{alone}.")
    return out


def fold_figures(texts):
    cut = re.compile(r"\s*\((see\s+)?(Table\s+\d+\s+and\s+)?Figs?\.$|\s+in\s+Figs?\.$")
    end = lambda t: t if not t or t[-1] in ".?!" else f"{t}."
    out, held = [], None
    for t in texts:
        s = t.strip()
        number = re.match(r"\d+\)\s*([\s\S]*)$", s)
        prose = number[1] if number else "" if re.match(r"\d+(\s+and\s+\d+)?(,\s+which\b.*)?\.?$", s) else None
        if held is not None and prose is not None:
            out.append(end(f"{held} {prose}".strip()))
            held = None
            continue
        if held is not None:
            out.append(end(held))
            held = None
        if cut.search(s):
            held = cut.sub("", s).strip()
        else:
            out.append(t)
    return [t for t in [*out, *([end(held)] if held is not None else [])] if t]


CITATIONS = ["As said (Mill 1940:", "(Mill 1940:", "Mill 1940:", "12).", "12)", "3; ", "and B. Mill 1950:", "B. Mill 1950: 7", "Plain text", "Plain text.", "", "Smith 1999: 4).", "Is it? Smith 1999:", "é Mill 1940:", "éMill 1940:", "and more"]
FIGURES = ["It was (see Figs.", "3)and so on", "3) and (see Fig.", "4", "4 and 5, which is so.", "Plain", "Done.", " (Fig.", "shown in Fig.", "7)", " 8. ", "", "(Fig."]


@pytest.mark.parametrize("function, fold, pieces", [(S.merge_citations, fold_citations, CITATIONS), (S.repair_figure_refs, fold_figures, FIGURES)])
def test_repairs_are_the_plain_folds(spark, function, fold, pieces):
    rng = random.Random(len(pieces))
    chapters = {(b, c): rng.choices(pieces, k=rng.choice([1, 2, 3, 8, 40])) for b in range(60) for c in (1, 2)}
    chapters[99, 1] = [CITATIONS[2], *["B. Mill 1950: 7"] * 300, "x"] if function is S.merge_citations else ["It was (see Figs.", *["3) and (see Fig."] * 301]
    rows = [(b, c, 3 * i, t) for (b, c), texts in chapters.items() for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got: dict = {}
    for r in function(spark.createDataFrame(rows, "book_id int, chapter_no int, frag_idx int, text string")).orderBy("frag_idx").collect():
        got.setdefault((r.book_id, r.chapter_no), []).append((r.frag_idx, r.text))
    assert got == {k: list(enumerate(fold(t))) for k, t in chapters.items() if fold(t)}


def test_headers_are_compared_letter_by_letter(spark):
    lines = spark.createDataFrame([("DASS ER",), ("daß er 12",), ("Daẞ er",), ("ﬁn",), ("FIN",), ("ΑΙ",), ("ᾼ 3",), ("É 7",)], "line string")
    headers = spark.createDataFrame([(" Daß er",), ("ﬁn",), ("ᾳ",), ("é",)], "header string")
    assert [r.line for r in S.drop_running_headers(lines, headers).orderBy("line").collect()] == ["DASS ER", "FIN", "ΑΙ"]


def test_books_go_to_python_by_few_rows(spark):
    """Arrow's batches of 10,000 rows would hold as many whole books."""
    books = spark.createDataFrame([(1, "CHAPTER ONE\nA\nb.")], "book_id long, text string")
    lines = L.text_lines(books)
    pages = readers.epub_texts(readers.epub_pages(books.select(F.col("text").alias("path"), F.col("text").cast("binary").alias("content"))))
    made = [S.extract_chapters(books), S.extract_marked_chapters(books, []), books.select(S.html_to_text(F.col("text"))), books.select(S.normalize_pdf_lines(F.col("text"))), books.select(S.normalize_paragraphs(F.col("text"))), L.chapters_of_lines(lines), L.paragraphs_of_lines(lines), L.reflow_lines(lines), pages]
    for df in made:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "BatchEvalPython" in plan and "Arrow" not in plan and "MapInPandas" not in plan
