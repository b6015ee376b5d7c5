"""Alignment and anchors with bounds against the plain rules, and how few comparisons they take."""

import difflib
import random

from pyspark.sql import functions as F

from lectern.operators import kernels as K
from lectern.operators import matching as M

WORDS = "the roman collapse was an expensive thing to keep in state of complex society returns on energy declining marginal a i of".split()


def plain(a, b):
    if not a or not b:
        return 0.0
    return 1.0 if a in b or b in a else difflib.SequenceMatcher(None, a, b).ratio()


def plain_align(fragments, segments, accept=0.58, stop=0.92):
    cursor, out = 0, []
    for f in fragments:
        best, at = 0.0, None
        for i in range(cursor, len(segments)):
            score = plain(f, segments[i])
            if score > best:
                best, at = score, i
            if score >= stop:
                break
        if at is not None and best >= accept:
            cursor = at
            out.append((at, best))
        else:
            out.append((None, 0.0))
    return out


def spoken(rng, text):
    """The text as a recogniser may hear it."""
    return " ".join(rng.choice(WORDS) if rng.random() < 0.1 else w[: rng.randint(1, len(w))] if rng.random() < 0.1 else w for w in text.split())


def chapter(rng, n):
    fragments = [" ".join(rng.choices(WORDS, k=rng.randint(2, 25))) for _ in range(n)]
    segments = [spoken(rng, f) for f in fragments if rng.random() < 0.9]
    return fragments, segments


def test_alignment_is_the_plain_rule_with_few_comparisons():
    rng = random.Random(1)
    pairs = compared = 0
    for n in (1, 5, 30, 120):
        for _ in range(4):
            fragments, segments = chapter(rng, n)
            fragments.insert(n // 2, rng.choice(["", "zzz qqq", "a"]))
            segments.insert(0, "")
            assert K.align(fragments, segments) == plain_align(fragments, segments)
            if n == 120:
                index, first = K.SegmentIndex(segments), 0
                for f in fragments:
                    _, found = index.best(f, first, len(segments), 0.58, 0.92)
                    pairs += len(segments) - first
                    first = max(first, found)
                compared += index.compared
    assert compared < 0.1 * pairs
    assert K.align(["abc", "abd"], ["xx", "abc", "abd"], lookahead=1) == [(None, 0.0), (None, 0.0)]


def test_alignment_seeks_no_subsequence_where_lengths_or_containment_decide():
    rng = random.Random(5)
    segments = ["\n".join(rng.choices(["a b", "b a", "ab", "c"], k=rng.randint(0, 3))) for _ in range(40)] + [spoken(rng, " ".join(rng.choices(WORDS, k=80))) for _ in range(60)]
    fragments = [rng.choice(segments)[rng.randint(0, 9) :][: rng.randint(1, 40)] for _ in range(80)] + ["zq" * 3]
    assert K.align(fragments, segments) == plain_align(fragments, segments)
    assert K.align(fragments, segments, stop=1.5) == plain_align(fragments, segments, stop=1.5)
    index = K.SegmentIndex(segments)
    long = len(segments) - 60
    for word in WORDS:  # short texts of letters that all long segments have
        index.best(f"{word} zz {word}", long, len(segments), 0.58, 0.92)
    assert index.bounded == 0


def test_times_align_each_chapter_once(spark):
    f = spark.createDataFrame([(1, 1, 0, "a cat sat"), (1, 1, 1, "zzz"), (1, 1, 2, "on the mat")], "book_id int, chapter_no int, frag_idx int, text string")
    s = spark.createDataFrame([(1, 1, 0, 0.0, 3.0, "a cat sat"), (1, 1, 1, 5.0, 9.0, "on the mat")], "book_id int, chapter_no int, seg_idx int, start double, end double, text string")
    out = M.assign_times(f, s)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapCoGroups" not in plan  # nor a call for each chapter
    assert [(r.frag_idx, r.begin, r.end, r.status) for r in out.orderBy("frag_idx").collect()] == [(0, 0.0, 3.0, "matched"), (1, 3.0, 5.0, "unmatched"), (2, 5.0, 9.0, "matched")]


def test_ratio_bound_is_never_below_the_ratio():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choices("abc d", k=rng.randint(1, 60))) for _ in range(2))
        assert K.ratio_bound(K.letter_masks(a), len(a), b) >= difflib.SequenceMatcher(None, a, b).ratio()


def test_contained_texts_meet_wherever_they_stand(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 12))) for _ in range(60)] + ["", "a", "ex", "om", "e c", "n s", "man coll", "apse was an exp", "the the the", "state of complex society"]
    clips = [(f"c{i}", rng.choice(texts)[rng.randint(0, 3) :].strip()) for i in range(40)] + [(f"d{i}", t) for i, t in enumerate(texts[-10:])]
    f = spark.createDataFrame(list(enumerate(texts)), "frag_idx long, norm string")
    c = spark.createDataFrame(clips, "clip_id string, norm string")
    want = sorted((k, i) for k, a in clips for i, b in enumerate(texts) if a and b and (a in b or b in a))
    assert sorted(map(tuple, M.contained_pairs(c, f).select("clip_id", "frag_idx").collect())) == want
    assert {r.clip_id: r.frag_idx for r in M.contained_anchors(c, f, ()).collect()} == {k: min(i for x, i in want if x == k) for k, _ in want}


def test_anchors_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    frags, clips, want = [], [], {}
    for book in (1, 2):
        texts, heard = chapter(rng, 25)
        frags += [(book, 1, i, t) for i, t in enumerate(texts)]
        more = [" ".join(texts[i : i + 4]) for i in range(len(texts))]
        for k in range(25):
            i = rng.randrange(len(texts))
            t = rng.choice([spoken(rng, texts[i]), spoken(rng, more[i]), more[i][5:80].strip(), "zzz", ""])
            clips.append((f"{book}-{k}", book, 1, t, 10.0 * k, 1.0))
            score, at = max((max(plain(t, texts[j]), 0.92 * plain(t, more[j])), -j) for j in range(len(texts)))
            want[f"{book}-{k}"] = (-at, round(score, 3)) if score >= 0.58 else (None, None)
    f = spark.createDataFrame(frags, "book_id int, chapter_no int, frag_idx int, text string")
    c = spark.createDataFrame(clips, "clip_id string, book_id int, chapter_no int, text string, clip_start double, first_start double")
    got = {r.clip_id: (r.frag_idx, None if r.score is None else round(r.score, 3)) for r in M.match_anchor(c, f).collect()}
    assert got == want and sum(v[0] is not None for v in want.values()) > 20
    assert M.match_anchor(c.limit(0), f).count() == 0 and M.match_anchor(c, f.limit(0)).where(F.col("frag_idx").isNotNull()).count() == 0
