"""Monotone points: a key cut into blocks keeps what a walk over all its points keeps."""

import random

import pytest

from lectern.operators import timeline as T


def walk(points):
    kept = []
    for time, idx, source in sorted(points):
        if not kept or time > kept[-1][0] and idx > kept[-1][1]:
            kept.append((time, idx, source))
    return kept


@pytest.mark.parametrize("block", [1, 3, 20, 50_000])
def test_blocks_keep_what_a_walk_keeps(spark, block):
    rng = random.Random(block)
    points = {}
    for k in range(40):
        n, times, most = rng.choice([1, 2, 9, 60]), rng.choice([2, 8, 1000]), rng.choice([3, 30, 1000])
        points[k] = [(float(rng.randrange(times)) ** rng.choice([1, 3]), rng.randrange(-2, most), rng.choice(["a", "b"])) for _ in range(n)]
    points[99] = [(float(i), i, "a") for i in range(100)]
    points[98] = [(5.0, i % 7, "a") for i in range(30)]
    rows = [(k, *p) for k, own in points.items() for p in own]
    df = spark.createDataFrame([*rows, (1, None, 5, "a"), (1, 7.0, None, "a")], "book_id int, time double, idx bigint, source string").repartition(3)
    got: dict = {}
    for r in T.monotone_points(df, ("book_id",), block_points=block).orderBy("book_id", "pos").collect():
        got.setdefault(r.book_id, []).append((r.pos, r.time, r.idx, r.source))
    assert got == {k: [(i, *p) for i, p in enumerate(walk(own))] for k, own in points.items()}


def test_a_long_key_is_many_blocks(spark):
    df = spark.range(0, 200_000, 1, 4).selectExpr("1 as book_id", "cast(id div 3 as double) as time", "cast(pmod(id * 7919, 1000) + id div 2 as bigint) as idx", "'' as source")
    blocks = T._point_blocks(df, ("book_id",), 10_000).groupBy("block").count().collect()
    assert len(blocks) >= 15 and max(r["count"] for r in blocks) <= 15_000
    want = walk([(r.time, r.idx, "") for r in df.collect()])
    got = T.monotone_points(df, ("book_id",), block_points=10_000).orderBy("pos").collect()
    assert [(r.time, r.idx) for r in got] == [(t, i) for t, i, _ in want] and [r.pos for r in got] == list(range(len(want)))
