import math
import random
from collections import Counter

import numpy as np
import pytest

from lectern.llm import batches, near_duplicates
from lectern.llm.components import components
from lectern.llm.near_duplicates import drop_near_duplicates, near_duplicate_classes


def brute(rows, threshold=0.8, spread=0.1):
    def grams(t):
        w = (t or "").encode().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    sets = [grams(t) for _, t in rows]
    df, n = Counter(g for s in sets for g in s), len(rows)
    weigh = [{g: (1 + math.log(c)) * (1 + spread * math.log((n + 1) / (2 ** (round(8 * math.log2(df[g])) / 8) + 1)) / math.log(n + 1)) for g, c in s.items()} for s in sets]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            least = sum(min(w, weigh[j][g]) for g, w in weigh[i].items() if g in weigh[j])
            total = sum(weigh[i].values()) + sum(weigh[j].values()) - least
            if (rows[i][1] or "") == (rows[j][1] or "") or total and least / total >= threshold:
                parent[find(i)] = find(j)
    classes = {}
    for i in range(n):
        classes.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], min(classes[find(i)]), len(classes[find(i)])) for i in range(n))


def make(rng, groups=25):
    rows = []
    for _ in range(groups):
        base = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                text[rng.randrange(len(text))] = "edited%d" % rng.randrange(10**6)
            rows.append((len(rows), " ".join(text)))
    return rows + [(1000, None), (1001, ""), (1002, "one two"), (1003, "one  two"), (1004, "one two three")]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(batches, "BATCH_BYTES", 20_000)
    rows = make(random.Random(3))
    got = near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == brute(rows)


@pytest.mark.parametrize("tile", [5, 1000])
def test_families_that_share_buckets(spark, monkeypatch, tile):
    """Texts about 0.5 to 0.75 alike fill the buckets; linked ones among them are seldom a bucket's leaders."""
    monkeypatch.setattr(near_duplicates, "TILE", tile)
    monkeypatch.setattr(near_duplicates, "TASK_ROWS", 300)
    rng, rows = random.Random(8), []
    base = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(220)]
    for k in range(60):
        text, n = list(base), rng.choice([12, 20, 28])
        at = rng.randrange(len(base) - n)
        text[at : at + n] = [f"w{k}x{i}" for i in range(n)]
        rows.append((len(rows), " ".join(text)))
        for _ in range(k % 3):
            for _ in range(rng.choice([1, 2, 3])):
                text[rng.randrange(len(text))] = "edited%d" % rng.randrange(10**6)
            rows.append((len(rows), " ".join(text)))
    got = near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == brute(rows)


def test_links_among_pages_of_a_template(spark, monkeypatch):
    """Pages of one template, under the threshold, fill the buckets; pairs above it hide among them."""
    monkeypatch.setattr(near_duplicates, "TILE", 150)
    rng = random.Random(11)
    template = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(100)]
    rows = []
    for k in range(330):
        rows.append((len(rows), " ".join([*template, *(f"p{k}w{i}" for i in range(13))])))
        if k % 4 == 0:
            text = rows[-1][1].split()
            text[rng.randrange(100)] = f"edit{k}"
            rows.append((len(rows), " ".join(text)))
    want = {d: c for d, c, _ in brute(rows)}
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [d for d, c in want.items() if c != d]
    assert len(set(want.values())) == 330 and len(linked) == 83
    assert sum(got[d] == want[d] for d in linked) >= 0.9 * len(linked)
    assert all(got[d] == d for d in want if want[d] == d)


def test_overlaps_and_links():
    rng = np.random.Generator(np.random.PCG64(1))
    vectors = []
    for _ in range(40):
        h = np.sort(rng.choice(60, rng.integers(0, 50), replace=False).astype(np.uint64))
        vectors.append((h, rng.choice([0.5, 1.0, 1.7], len(h)).astype(np.float32)))
    for columns in (7, 1024):
        near_duplicates.COLUMNS = columns
        least = near_duplicates.overlaps(vectors)
        for i, (h1, w1) in enumerate(vectors):
            for j, (h2, w2) in enumerate(vectors):
                other = dict(zip(h2.tolist(), w2.tolist(), strict=True))
                assert abs(least[i, j] - sum(min(w, other.get(h, 0)) for h, w in zip(h1.tolist(), w1.tolist(), strict=True))) < 1e-9 or i == j
    assert near_duplicates.links(vectors[:1] * 3, np.array([0, 1, 0]), 0.8)[0] == (0, 1)


def test_one_row_of_each_class_stays(spark):
    rows = make(random.Random(4), 10)
    rows = [(d, t, "x") for d, t in [*rows, rows[0]]]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, batch string").selectExpr("*", "1 as __batch", "2 as id")).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c, _ in brute([r[:2] for r in rows])})
    assert kept[0].batch == "x"


def test_empty_table_and_chains(spark):
    assert near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a int, b int")
    assert sorted(map(tuple, components(batches.shared_folder(spark, "c"), links).collect())) == [(k, 0) for k in range(41)] + [(100, 100), (101, 100)]
