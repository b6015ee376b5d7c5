import hashlib
import random
import re

import numpy as np
import pytest

from lectern.llm import batches, substrings
from lectern.llm.substrings import drop_repeated_passages


def brute(rows, window=13):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, (_, t) in enumerate(rows)}
    least = {}
    for i, (d, _) in enumerate(rows):
        for k in range(len(split[i]) - window + 1):
            key = tuple(split[i][k : k + window])
            least[key] = min(least.get(key, d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        gone = set()
        for k in range(len(split[i]) - window + 1):
            if least[tuple(split[i][k : k + window])] < d:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(split[i]) if k not in gone)
        out.append((d, len(split[i]), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows, schema="doc_id long, text string"):
    out = drop_repeated_passages(spark.createDataFrame(rows, schema)).collect()
    return sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out)


@pytest.mark.parametrize("size", [3000, 4 << 20])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(batches, "BATCH_BYTES", size)
    rng = random.Random(5)
    passages = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(8, 40))) for _ in range(12)]
    rows = []
    for d in range(160):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join("".join(rng.choices("xyzéü", k=3)) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 5))]
        rows.append((d * 3 % 97, "\n ".join(parts)))
    rows += [(500, None), (501, ""), (502, "  \t\n"), (503, "a " * 300), (504, "a " * 40), (7, rows[0][1])]
    assert run(spark, rows) == brute(rows)


def documents(rng, n):
    passages = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(8, 40))) for _ in range(12)]
    return [(d, " ".join(rng.choice(passages) if rng.random() < 0.4 else " ".join("".join(rng.choices("xyzéü", k=3)) for _ in range(20)) for _ in range(4))) for d in range(n)]


def test_two_levels_of_buckets_and_linear_rows(spark, monkeypatch):
    monkeypatch.setattr(batches, "BATCH_BYTES", 2000)
    monkeypatch.setattr(batches, "FAN", 4)
    monkeypatch.setattr(batches, "CHUNK", 5)
    counts, pack = [], batches.packed_rows
    for n in (60, 240):
        rows = documents(random.Random(n), n)
        assert run(spark, rows) == brute(rows)
        n_batches = batches.in_batches(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id")[1]
        exchange = batches.Exchange(n_batches, np.dtype(np.uint16), substrings._merged, substrings._answer)
        assert exchange.inner == -(-n_batches // 5)
        hashes = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
        keys, inverse, edges = exchange.split(hashes)
        assert (keys[inverse] == hashes).all()
        counts.append(n_batches * exchange.pack(0, keys, np.zeros(len(keys)), edges).num_rows / n_batches)
    assert counts[0] == counts[1] == 4 and pack is batches.packed_rows


def test_windows_without_anchor_are_out():
    value = lambda *places: substrings._values(np.zeros(len(places), np.int64), *(np.array(x) for x in zip(*places, strict=True)))[0]
    own, other, block = value((0, 10, False)), value((0, 30, False)), value((0, 30, True))
    merged = lambda *v: substrings._merged(np.array(v, np.uint16), np.array([0]))[0]
    answer = lambda mine, *v: int(substrings._answer(np.array([mine]), np.array([merged(*v)]))[0])
    assert answer(own, own) == 0 and answer(own, own, other) == substrings.SHARED  # no block has it
    assert answer(own, own, block) == substrings.SHARED  # the block comes later
    assert answer(value((0, 40, False)), value((0, 40, False)), block) == substrings.SHARED | substrings.HIT
    assert answer(block, own, block) == substrings.SHARED  # its own block: probed by an earlier document only
    assert answer(block, block, value((0, 40, False))) == substrings.SHARED | substrings.PROBED
    assert merged(merged(own, block), other) == merged(own, block, other)


def test_clashing_names(spark):
    text = " ".join(str(k) for k in range(30))
    df = spark.createDataFrame([(1, text, 5, 6, 7), (2, text, 5, 6, 7)], "doc_id long, text string, __batch int, c0 int, __bucket int")
    out = {r.doc_id: r for r in drop_repeated_passages(df).collect()}
    assert out[2].n_removed == 30 and out[1]["__batch"] == 5 and out[1].c0 == 6 and out[1]["__bucket"] == 7


def test_empty_table_null_ids_and_clashing_columns(spark):
    assert run(spark, []) == []
    text = " ".join(str(k) for k in range(30))
    df = spark.createDataFrame([(None, text, 1), (2, text, 2), (3, text, 3)], "doc_id long, text string, n_words int")
    assert {(r.doc_id, r.n_words, r.n_removed) for r in drop_repeated_passages(df).collect()} == {(None, 30, 0), (2, 30, 0), (3, 30, 30)}
