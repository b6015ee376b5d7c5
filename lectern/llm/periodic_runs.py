"""Periodic runs of words: long documents are dealt out as tiles for each octave of periods, and what tiles find is stitched by document and period.

Word i repeats at period q where it equals word i + q; a run of period q is a maximal
stretch of such i, and q words more.  For the periods of an octave [P, 2P) a grid of
boundaries is laid so closely that each long enough stretch spans a whole gap.  At each
boundary the Z-function of the words from there on is taken at the octave's periods:
whether it reaches the next boundary, for all boundaries of a tile at once, by hashes
of windows; chains of such boundaries are compared word by word, and where they end
the Z-function is read on forwards and backwards, so a tile gives exact intervals.

Documents of at most TILE words are one tile of all octaves, solved where it lies; the
tiles of longer ones overlap by what the boundaries that they own can see, and
are dealt over all tasks.  A tile of a long document has a few times its octave's period in words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm import batches as B

LEAST_LENGTH, LEAST_EXPONENT = 24, 3
#: Words of a tile, and of documents that are solved together.
TILE = 1 << 17

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def octaves(longest: int, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(first period, end, gap between boundaries) up to the period `longest`: a stretch of the least length of any of the octave's periods holds two gaps."""
    out, low = [], 1
    while low <= longest:
        high = 2 * low
        shortest = min(max(least, exponent * q) - q for q in range(low, min(high, max(low, least // exponent) + 1) + 1)) if low <= least else (exponent - 1) * low
        gap = 1
        while 4 * gap <= shortest:
            gap *= 2
        out.append((low, high, gap))
        low = high
    return out


def _agree(w: np.ndarray, begin: int, end: int, period: int) -> list[tuple[int, int]]:
    """The stretches of [begin, end) whose words equal those a period on; one, the whole, unless two windows of equal hash differ."""
    same = w[begin:end] == w[begin + period : end + period]
    if same.all():
        return [(begin, end)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    return [(begin + int(a), begin + int(b)) for a, b in edge.reshape(-1, 2)]


def _z_forward(w: np.ndarray, at: int, period: int, most: int) -> int:
    """How many words from `at` on equal those a period on, `most` at most."""
    most = min(most, len(w) - period - at)
    if most <= 0:
        return 0
    differ = w[at : at + most] != w[at + period : at + period + most]
    first = int(differ.argmax())
    return first if differ[first] else most


def _z_backward(w: np.ndarray, at: int, period: int, most: int) -> int:
    """The same of the words before `at`."""
    most = min(most, at)
    if most <= 0:
        return 0
    differ = (w[at - most : at] != w[at - most + period : at + period])[::-1]
    first = int(differ.argmax())
    return first if differ[first] else most


def _hits(h: np.ndarray, begin: int, end: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(j, q): the boundaries j * gap and periods of [begin, end) where two windows have equal hashes, that is, the Z-function reaches the next boundary; sorted by q, then j."""
    blocks = -(-(len(h) - begin) // gap)
    here, found = h[: blocks * gap : gap], []
    if end - begin <= 16:
        for q in range(begin, end):
            there = h[q::gap]
            hit = np.flatnonzero(here[: len(there)] == there[: len(here)])
            found.append((hit, np.full(len(hit), q)))
    else:  # a row for each boundary, a column for each period
        span = end - begin
        padded = np.concatenate([h[begin:], np.zeros(max(0, (blocks - 1) * gap + span - (len(h) - begin)), np.uint64)])
        lagged = np.lib.stride_tricks.sliding_window_view(padded, span)[::gap][:blocks]
        rows = max(1, (1 << 18) // span)
        for x in range(0, blocks, rows):
            row, lag = np.nonzero(lagged[x : x + rows] == here[x : x + rows, None])
            inside = (row + x) * gap + begin + lag < len(h)
            found.append((row[inside] + x, lag[inside] + begin))
    block, q = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.lexsort([block, q])
    return block[order], q[order]


def _stretches(w: np.ndarray, block: np.ndarray, q: np.ndarray, gap: int) -> Iterator[tuple[int, int, int]]:
    """(period, begin, end) of the chains of neighbouring boundaries, read on at both ends by a gap at most."""
    if not len(q):
        return
    starts = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (block[1:] != block[:-1] + 1)]))
    ends = np.append(starts[1:], len(q)) - 1
    for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
        p = int(q[i])
        for x, y in _agree(w, int(block[i]) * gap, (int(block[j]) + 1) * gap, p):
            yield p, x - _z_backward(w, x, p, gap), y + _z_forward(w, y, p, gap)


def solve(w: np.ndarray, low: int, high: int, own: tuple[int, int] | None = None, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT, upto: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(period, begin, end): the stretches where words equal those a period on, of periods in [low, high), around the boundaries in [own) or anywhere.

    Stretches too short for a run are left out unless they come from the edge of what
    is owned, where another tile goes on.  Where a run of a shorter period covers a
    boundary up to a period behind the next one, its multiples are no run's smallest
    period there or anywhere, and are left out.  `upto[k]`: octave k looks at that many
    words only.
    """
    out = []
    h, width = _mixed(w.astype(np.uint64) * _A), 1
    reach, period_of = np.zeros(len(w) + 1, np.int64), np.ones(len(w) + 1, np.int64)
    for k, (begin, end, gap) in enumerate(octaves(high - 1, least, exponent)):
        n = len(w) if upto is None else int(upto[k])
        while width < gap and len(h) > width:
            h = _mixed(h[: len(h) - width] * _A + h[width:])
            width *= 2
        h = h[: max(0, n - width + 1)]
        if len(h) <= begin or width < gap:
            break
        block, q = _hits(h, begin, end, gap)
        at = block * gap
        keep = ~((reach[at] >= at + gap + q) & (q % period_of[at] == 0))
        block, q, at = block[keep], q[keep], at[keep]
        for p, x, y in _stretches(w, block, q, gap):
            if y - x >= max(least, exponent * p) - p:
                fill = reach[x : y + p] < y + p
                reach[x : y + p][fill] = y + p
                period_of[x : y + p][fill] = p
                if begin >= low and own is None:
                    out.append((p, x, y))
        if begin >= low and own is not None:
            mine = (at >= own[0]) & (at < own[1])
            for p, x, y in _stretches(w, block[mine], q[mine], gap):
                if y - x >= max(least, exponent * p) - p or x <= own[0] + gap or y >= own[1] - gap:
                    out.append((p, x, y))
    return out


def tiles(n: int, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT, size: int = TILE) -> list[tuple[int, int, int, int, int, int]]:
    """(first period, end, begin, end, own begin, own end) in words: the tiles of a document of n words; short octaves share tiles, longer ones have tiles of a few periods."""
    out, shared = [], [o for o in octaves(max(1, n // exponent), least, exponent) if 8 * o[1] <= size] or octaves(1, least, exponent)
    groups = [(1, shared[-1][1], shared[-1][2], size)]
    groups += [(a, b, gap, 2 * b) for a, b, gap in octaves(n // exponent, least, exponent) if a >= shared[-1][1]]
    for low, high, gap, step in groups:
        step = -(-step // gap) * gap
        for own in range(0, n, step):
            begin = max(0, own - gap - least)
            begin -= begin % gap  # so that boundaries are the same in all tiles
            out.append((low, high, begin, min(n, own + step + 2 * gap + high + least), own, min(n, own + step)))
    return out


def _dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words lie in a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) > 0


def _summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs; start, length, period and exponent_milli of the run of greatest exponent; the two digests."""
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    best: tuple = (None,) * 4
    kept = words
    if runs:
        s, m, p = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, m, p, 1000 * m // p)
        kept = [words[i] for i in np.flatnonzero(~_dropped(len(words), runs)).tolist()]
    return (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def plant(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words made periodic from some place on where crc32 of the decimal id ends in 0; a null id changes nothing."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


RESULT = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
_FOUND = "array<struct<period:bigint,begin:bigint,end:bigint>>"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT, tile: int = TILE) -> DataFrame:
    """One row for each row of `docs`: id, n_runs, the run of greatest length by period (start, length, period, exponent_milli; nulls where there is none), and digests of all runs and of the words that stay when each run keeps its first period.

    Runs are stretches of words of smallest period q and at least max(`least`,
    `exponent` * q) words that can't be extended.  Ties go to the least start, then
    the least period.  A null text has no words; rows with null, equal or repeated
    ids are rows of their own; other columns are left out; an empty table gives no
    rows.  A very long text is cut and rebuilt by one task; its periods are searched by many.
    `planted`: see `plant`.
    """
    kind = f"uid bigint, id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, words binary, found {_FOUND}, low bigint, high bigint, base bigint, own_begin bigint, own_end bigint, ids binary"
    fields = [f.split()[0] for f in kind.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(kind))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, uid, part = 0, 0, 0

        def rows(items: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in items], schema.field(f).type) for f in fields], schema=schema)

        def flush() -> Iterator[pa.RecordBatch]:
            known: dict[bytes, int] = {}
            number, pieces, begins, at = known.setdefault, [], [], 0
            held.sort(key=lambda x: -len(x[2]))  # so that the documents long enough for an octave come first
            for k, (_, _, words) in enumerate(held):
                begins.append(at)
                pieces.append(np.array([number(x, len(known)) for x in words] + [-1 - k], np.int64))
                at += len(words) + 1
            together = np.concatenate(pieces)
            lengths = np.array([len(p) - 1 for p in pieces])
            longest = int(lengths[0])
            ends = np.append(0, np.cumsum(lengths + 1))
            upto = np.array([ends[np.searchsorted(-lengths, -max(least, exponent * o[0]), side="right")] for o in octaves(max(1, longest // exponent), least, exponent)])
            found: list[list] = [[] for _ in held]
            starts = np.array(begins)
            for p, x, y in solve(together, 1, longest // exponent + 1, None, least, exponent, upto) if longest >= least else []:
                k = int(np.searchsorted(starts, x, side="right")) - 1
                found[k].append({"period": p, "begin": x - begins[k], "end": y - begins[k]})
            out = []
            for (own, doc, words), f in zip(held, found, strict=True):
                if f:
                    out.append({"uid": own, "id": doc, "words": b" ".join(words), "found": f})
                else:
                    out.append({"uid": own, "id": doc, **dict(zip(RESULT, _summary(words, []), strict=True))})
            yield rows(out)

        for batch in batches:
            for doc, raw, part in zip(batch["id"].to_pylist(), batch["raw"].to_pylist(), batch["part"].to_pylist(), strict=True):
                words = (raw or b"").split()
                words = plant(words, doc) if planted else words
                uid += 1
                if len(words) > tile:
                    yield rows([{"uid": (part << 33) + uid, "id": doc, "words": b" ".join(words)}])
                    known: dict[bytes, int] = {}
                    ids = np.array([known.setdefault(x, len(known)) for x in words], np.int32)
                    for low, high, begin, end, own_begin, own_end in tiles(len(words), least, exponent, tile):
                        yield rows([{"uid": (part << 33) + uid, "low": low, "high": high, "base": begin, "own_begin": own_begin, "own_end": own_end, "ids": zlib.compress(ids[begin:end].tobytes(), 1)}])
                    continue
                held.append(((part << 33) + uid, doc, words))
                size += len(words) + 1
                if size >= tile:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"), F.spark_partition_id().alias("part"))
    table = B.checkpoint(source.mapInArrow(explode, kind))

    def solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(zlib.decompress(r["ids"]), np.int32).astype(np.int64)
                found = solve(ids, r["low"], r["high"], (r["own_begin"] - r["base"], r["own_end"] - r["base"]), least, exponent)
                columns = list(zip(*[(r["uid"], p, x + r["base"], y + r["base"]) for p, x, y in found], strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["uid", "period", "begin", "end"])

    dealt = table.where("ids is not null").select("uid", "low", "high", "base", "own_begin", "own_end", "ids").repartition("uid", "low", "base")
    pieces = table.where("found is not null").select("uid", F.inline("found")).unionByName(dealt.mapInArrow(solve_tiles, "uid bigint, period bigint, begin bigint, end bigint"))
    by = Window.partitionBy("uid", "period").orderBy("begin", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("begin") <= before, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    stitched = pieces.withColumn("island", island).groupBy("uid", "period", "island").agg(F.min("begin").alias("start"), (F.max("end") + F.col("period")).alias("stop"))
    long = stitched.where(F.col("stop") - F.col("start") >= F.greatest(F.lit(least), F.lit(exponent) * F.col("period")))
    smallest = long.groupBy("uid", "start", "stop").agg(F.min("period").alias("period"))
    listed = smallest.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("stop") - F.col("start")).alias("length"), "period"))).alias("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 6 + [pa.string()] * 2
        for batch in batches:
            for doc, words, runs in zip(batch["id"].to_pylist(), batch["words"].to_pylist(), batch["runs"].to_pylist(), strict=True):
                row = (doc, *_summary(words.split(), [(r["start"], r["length"], r["period"]) for r in runs or []]))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["id", *RESULT])

    open_docs = table.where("words is not null").select("uid", "id", "words").join(listed, "uid", "left").select("id", "words", "runs")
    result = "id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    done = table.where("n_runs is not null").select("id", *RESULT)
    return done.unionByName(open_docs.mapInArrow(finish, result)).withColumnRenamed("id", id_col)
