"""Near-duplicate classes: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard similarity.

1. Document frequencies of all five-word shingles, over all documents.
2. Improved consistent weighted sampling (Ioffe, 2010): each of `bands * rows`
   samples picks one weighted shingle; two documents pick the same one with a
   probability equal to their weighted Jaccard similarity.
3. Texts that agree on all samples of a band share a bucket.  Every text of a bucket
   is compared exactly with one leader, and the leader differs from band to band; so
   groups of copies, however large, become one class by as many comparisons as texts.
4. In buckets whose texts still are in different classes, all pairs of different
   classes are compared by their samples, in tiles of bounded size.  The texts that
   have such a pair go to the tile, which compares them exactly, all at once.

So any two texts that share a bucket are in one class at the end, or were compared.
A pair at 0.8 shares a bucket with a probability of 0.9992; its samples must agree in
half of all, which it fails with a probability under 0.0002.

The weight of a shingle is (1 + ln tf) * (1 + spread * ln((N + 1) / (df + 1)) / ln(N + 1)).
With a plain idf the shingles that a thousand near copies share would weigh a third
of those that one edit made new, and large groups of copies would fall apart: at ten
percent of changed shingles weighted similarity falls to 0.65.  `spread` bounds that.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import batches as B
from lectern.llm.components import components
from lectern.llm.words import Words, mix, words

SIZE, THRESHOLD, BANDS, ROWS, SPREAD = 5, 0.8, 10, 3, 0.1
#: Members of a bucket in one verification task, and batches whose members have a leader of their own.
BLOCK, LEADER_BATCHES = 200, 512
#: Texts, and bytes of their weight vectors, in one block of a bucket (two are a tile); rows, or bytes, in one task of tiles; shingles held against all texts at once.
TILE, TILE_BYTES, TASK_ROWS, TASK_BYTES, COLUMNS = 1000, 4 << 20, 20_000, 8 << 20, 1024
SIGNATURES = "id long, digest binary, batch int, copy int, bands array<bigint>, sketch binary, size int"


def _digest(text: str | None) -> bytes:
    return hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by text and hash: hash, index of the text, times. Fewer words than `size` are one shingle."""
    at = found.left() >= size
    hashes, docs = [found.windows(size)[at]], [found.doc[at]]
    length = np.diff(found.first)
    for n in range(1, size):
        short = np.flatnonzero(length == n)
        hashes.append(found.windows(n, salt=48)[found.first[short]] if len(short) else np.empty(0, np.uint64))
        docs.append(short)
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.argsort((d.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))  # far faster than sorting by two keys
    again = h[order]
    if len(length) >= 1 << 20 or ((again[1:] < again[:-1]) & (d[order][1:] == d[order][:-1])).any():
        order = np.lexsort((h, d))
    h, d = h[order], d[order]
    begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.empty(0, np.int64)
    return h[begin], d[begin], np.diff(np.append(begin, len(h)))


def samples(h: np.ndarray, weight: np.ndarray, begin: np.ndarray, n_samples: int) -> np.ndarray:
    """Consistent weighted samples of the sets that begin at `begin`: one row of 64-bit values for each set."""
    out = [np.empty((0, n_samples), np.uint64)]
    edge, low = np.append(begin, len(h)), 0
    while low < len(begin):  # some sets at a time, so that the arrays stay in the processor's cache
        high = max(low + 1, int(np.searchsorted(edge, edge[low] + 20_000, "right")) - 1)
        x, y = edge[low], edge[high]
        out.append(_samples(h[x:y], weight[x:y], begin[low:high] - x, n_samples))
        low = high
    return np.concatenate(out)


def _samples(h: np.ndarray, weight: np.ndarray, begin: np.ndarray, n_samples: int) -> np.ndarray:
    out = np.empty((len(begin), n_samples), np.uint64)
    log_weight = np.log(weight).astype(np.float32)
    count = np.diff(np.append(begin, len(h)))
    rank = np.repeat(np.arange(len(begin)), count)
    unit, low = np.float32(2.0**-16), np.uint64(0xFFFF)

    def part(u: np.ndarray, shift: int) -> np.ndarray:
        return ((u >> np.uint64(shift)) & low).astype(np.float32) * unit + unit / 2

    for k in range(n_samples):
        u = mix(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
        r = -np.log(part(u, 0) * part(u, 16))
        log_c = np.log(-np.log(part(u, 32) * part(u, 48)))
        beta = ((u * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_weight / r + beta)
        score = log_c - r * (t - beta + 1)
        best = np.flatnonzero(score == np.repeat(np.minimum.reduceat(score, begin), count))
        pick = best[np.searchsorted(rank[best], np.arange(len(begin)))]
        out[:, k] = mix(h[pick] ^ mix(t[pick].astype(np.int64).view(np.uint64) + np.uint64(k)))
    return out


def similarity(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Weighted Jaccard similarity of two vectors with sorted keys."""
    if not len(h1) or not len(h2):
        return 0.0
    at = np.minimum(np.searchsorted(h1, h2), len(h1) - 1)
    both = h1[at] == h2
    least = float(np.minimum(w1[at[both]], w2[both]).sum())
    return least / (float(w1.sum()) + float(w2.sum()) - least)


def _unpacked(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(vector) // 12
    return np.frombuffer(vector, np.uint64, n), np.frombuffer(vector, np.float32, n, 8 * n)


def overlaps(vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum of the lesser weights of each two vectors, by matrix products over the shingles that several of them have.

    Of a shingle with weights v1 < v2 < ..., the lesser of two weights is the sum of
    v1, v2 - v1 ... up to where one of them ends: one column for each step.
    """
    m = len(vectors)
    row = np.repeat(np.arange(m), [len(h) for h, _ in vectors])
    h, w = np.concatenate([v[0] for v in vectors]), np.concatenate([v[1] for v in vectors]).astype(np.float64)
    order = np.lexsort((w, h))
    h, w, row = h[order], w[order], row[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    count = np.diff(np.append(begin, len(h)))
    shared = np.repeat(count > 1, count)
    h, w, row = h[shared], w[shared], row[shared]
    step = np.ones(len(h), bool)
    step[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    level = np.cumsum(step) - 1
    at = np.flatnonzero(step)
    below = np.zeros(len(at))
    same = h[at[1:]] == h[at[:-1]]
    below[1:][same] = w[at[:-1]][same]
    root = np.sqrt(w[at] - below)
    base = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]) if len(at) else np.empty(0, bool), np.arange(len(at)), 0))
    steps = level - base[level] + 1  # each entry fills the columns of its own step and all below
    entry = np.repeat(np.arange(len(h)), steps)
    col = level[entry] - (np.arange(len(entry)) - np.repeat(np.cumsum(steps) - steps, steps))
    by = np.argsort(col, kind="stable")
    col, rows, out = col[by], row[entry[by]], np.zeros((m, m))
    for low in range(0, len(at), COLUMNS):
        x, y = np.searchsorted(col, (low, low + COLUMNS))
        dense = np.zeros((m, min(COLUMNS, len(at) - low)))
        dense[rows[x:y], col[x:y] - low] = root[col[x:y]]
        out += dense @ dense.T
    return out


def links(vectors: list[tuple[np.ndarray, np.ndarray]], root: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of at least the threshold that are in different classes; of those that join the same two classes, one."""
    total = np.array([float(w.astype(np.float64).sum()) for _, w in vectors])
    least = overlaps(vectors)
    alike = (least >= threshold * (total[:, None] + total[None, :] - least)) & (root[:, None] != root[None, :])
    i, j = np.nonzero(np.triu(alike, 1))
    x, y = np.minimum(root[i], root[j]).astype(np.int64), np.maximum(root[i], root[j]).astype(np.int64)
    _, first = np.unique((x << 32) | y, return_index=True)
    return list(zip(i[first].tolist(), j[first].tolist(), strict=True))


def _add(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.minimum(np.add.reduceat(values.astype(np.int64), begin), (1 << 32) - 1).astype(np.uint32) if len(values) else values


class NearDuplicates:
    """The stages over one table; each is a method, so that they can be tested one by one."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, spread: float = SPREAD):
        self.id_col, self.text_col, self.size, self.threshold, self.bands, self.rows, self.spread = id_col, text_col, size, threshold, bands, rows, spread
        self.docs, self.n_batches = B.in_batches(docs, text_col, id_col)
        self.narrow = self.docs.select(B.BATCH, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.n_docs = docs.count()
        self.folder = B.shared_folder(docs.sparkSession, "near-duplicates")
        self.exchange = B.Exchange(self.n_batches, np.dtype(np.uint32), _add, lambda _, total: np.minimum(255, np.round(8 * np.log2(total))))

    def document_frequencies(self) -> DataFrame:
        """For each batch and bucket, a code of the document frequency of each of its shingles: 8 log2(df)."""
        size, exchange = self.size, self.exchange

        def count(batch: int, table: pa.Table) -> pa.Table:
            h, _, _ = shingles(words(B.column(table, "text")), size)
            keys, inverse, edges = exchange.split(h)
            return exchange.pack(batch, keys, np.bincount(inverse, minlength=len(keys)), edges)

        return exchange.answers(B.by_batch(self.narrow, count))

    def _vectors(self):
        size, exchange, n_docs, spread = self.size, self.exchange, self.n_docs, self.spread

        def vectors(table: pa.Table, answer: list[bytes]):
            h, doc, tf = shingles(words(B.column(table, "text")), size)
            _, inverse, _ = exchange.split(h)
            df = np.exp2(np.concatenate([B.inflate(x, np.uint8) for x in answer]) / 8.0)[inverse] if answer else np.ones(len(h))
            return h, doc, (1 + np.log(tf)) * (1 + spread * np.log((n_docs + 1) / (df + 1)) / np.log(n_docs + 1))

        return vectors

    def signatures(self, frequencies: DataFrame) -> DataFrame:
        vectors, bands, rows = self._vectors(), self.bands, self.rows

        def sign(batch: int, table: pa.Table, answers: pa.Table) -> pa.Table:
            h, doc, weight = vectors(table, B.column(answers, B.PAYLOAD))
            present = np.unique(doc)
            value = samples(h, weight, np.searchsorted(doc, present), bands * rows)
            key = np.zeros((len(present), bands), np.uint64)
            for k in range(rows):
                key = mix(key + value[:, k::rows])
            n = table.num_rows
            ids, digests = B.column(table, "id"), [_digest(t) for t in B.column(table, "text")]
            seen: dict = {}
            copy = [seen.__setitem__(x, seen.get(x, -1) + 1) or seen[x] for x in zip(ids, digests, strict=True)]
            out_bands, sketch = [[] for _ in range(n)], [b""] * n
            total = np.bincount(doc, weight, n)
            for i, d in enumerate(present.tolist()):
                out_bands[d] = key[i].view(np.int64).tolist()
                sketch[d] = total[d].astype(np.float32).tobytes() + value[i].astype(np.uint16).tobytes()
            vector_bytes = 12 * np.bincount(doc, minlength=n) + 200
            return pa.table({"id": pa.array(ids, pa.int64()), "digest": pa.array(digests, pa.binary()), "batch": pa.array([batch] * n, pa.int32()), "copy": pa.array(copy, pa.int32()), "bands": pa.array(out_bands, pa.list_(pa.int64())), "sketch": pa.array(sketch, pa.binary()), "size": pa.array(np.minimum(vector_bytes, 1 << 30), pa.int32())})

        return B.with_answers(self.narrow, frequencies, sign, SIGNATURES)

    def sent_vectors(self, requests: DataFrame, frequencies: DataFrame) -> DataFrame:
        """`requests`: (batch, task, part, digest, root).  The weight vector of each wanted text beside what was asked."""
        vectors = self._vectors()
        none = [F.lit(None).cast(kind).alias(k) for k, kind in (("task", "binary"), ("part", "int"), ("digest", "binary"), ("root", "binary"))]
        asked = frequencies.select(B.BUCKET, B.BATCH, B.PAYLOAD, *none).union(requests.select(F.lit(-1).alias(B.BUCKET), F.col("batch").alias(B.BATCH), F.lit(None).cast("binary").alias(B.PAYLOAD), "task", "part", "digest", "root"))

        def send(_, table: pa.Table, answers: pa.Table) -> pa.Table:
            asked = answers.filter(pa.compute.is_valid(answers["digest"]))
            if not asked.num_rows:
                return empty
            h, doc, weight = vectors(table, [x for x in B.column(answers, B.PAYLOAD) if x is not None])
            where = {_digest(t): i for i, t in enumerate(B.column(table, "text"))}
            edge = np.searchsorted(doc, np.arange(table.num_rows + 1))
            wanted, packed = B.column(asked, "digest"), {}
            for d in wanted:
                if d not in packed:
                    x, y = edge[where[d]], edge[where[d] + 1]
                    packed[d] = h[x:y].tobytes() + weight[x:y].astype(np.float32).tobytes()
            return asked.select(["task", "part", "digest", "root"]).append_column("vector", pa.array([packed[d] for d in wanted], pa.binary()))

        empty = pa.schema([("task", pa.binary()), ("part", pa.int32()), ("digest", pa.binary()), ("root", pa.binary()), ("vector", pa.binary())]).empty_table()
        return B.with_answers(self.narrow, asked, send, "task binary, part int, digest binary, root binary, vector binary")

    def verified(self, pairs: DataFrame, frequencies: DataFrame) -> DataFrame:
        """`pairs`: (a, a_batch, b, b_batch, parts); the texts compared with `a` are dealt to as many tasks.  Those of at least the threshold, as (a, b)."""
        threshold = self.threshold
        none = F.lit(None).cast("binary").alias("root")
        placed = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        leaders = placed.select(F.col("a_batch").alias("batch"), F.col("a").alias("task"), "part", F.col("a").alias("digest"), none).distinct()
        requests = placed.select(F.col("b_batch").alias("batch"), F.col("a").alias("task"), "part", F.col("b").alias("digest"), none).union(leaders)

        def compare(table: pa.Table) -> pa.Table:
            a = table["task"][0].as_py()
            digests, packed = B.column(table, "digest"), B.column(table, "vector")
            leader = _unpacked(packed[digests.index(a)])
            found = [d for d, v in zip(digests, packed, strict=True) if d != a and similarity(*leader, *_unpacked(v)) >= threshold]
            return pa.table({"a": pa.array([a] * len(found), pa.binary()), "b": pa.array(found, pa.binary())})

        return self.sent_vectors(requests, frequencies).groupBy("task", "part").applyInArrow(compare, "a binary, b binary")

    def in_tiles(self, members: DataFrame, sketches: DataFrame, mixed: DataFrame) -> DataFrame:
        """The texts of buckets with several classes that may reach the threshold with one of another class, by their sketches: (task, digest, batch, size, root).

        A bucket's texts are dealt to blocks of about TILE_BYTES of vectors; each two
        blocks are a tile, and some tiles are a task.  A pair counts in the first band
        that brings it together only.
        """
        half, threshold, bands, rows = self.bands * self.rows / 2, self.threshold, self.bands, self.rows
        width = bands * rows
        n_tasks = max(1, -(-(mixed.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0) // TASK_ROWS))
        inside = members.join(mixed.drop("n"), ["band", "key"])  # both are plain tables, so that Spark splits a hot bucket
        inside = inside.withColumn("block", F.pmod(F.xxhash64("digest", F.lit(5)), F.col("blocks")).cast("int"))
        tiled = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("tile", F.xxhash64("band", "key", F.least("block", "other"), F.greatest("block", "other")))
        tiled = tiled.select(F.pmod("tile", F.lit(n_tasks)).alias("task"), "tile", "band", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "digest", "batch", "size", "root").join(sketches, "digest")

        def alike(table: pa.Table) -> pa.Table:
            table = table.sort_by([(k, "ascending") for k in ("band", "key", "low", "high")]).combine_chunks()
            n = table.num_rows
            band, key, low, high, block = (table[k].to_numpy() for k in ("band", "key", "low", "high", "block"))
            root = table["root"].combine_chunks().dictionary_encode().indices.to_numpy()
            sketch = np.frombuffer(b"".join(B.column(table, "sketch")), np.uint8).reshape(n, 4 + 2 * width)
            total, sample = sketch[:, :4].copy().view(np.float32)[:, 0], sketch[:, 4:].copy().view(np.uint16)
            keys = np.array(B.column(table, "bands"), np.int64).reshape(n, bands)
            starts = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
            wanted, x, d = np.zeros(n, bool), np.arange(n), 1
            while len(x := x[x + d < end[x]]):  # each row with the d-th after it
                y = x + d
                u = np.flatnonzero((root[x] != root[y]) & ((low[x] == high[x]) | (block[x] != block[y])) & (np.minimum(total[x], total[y]) >= (threshold - 1e-4) * np.maximum(total[x], total[y])))
                u = u[(sample[x[u]] == sample[y[u]]).sum(axis=1) >= half]
                if len(u):
                    first = (keys[x[u]] == keys[y[u]]).argmax(axis=1)
                    u = u[first == band[x[u]]]
                    wanted[x[u]] = wanted[y[u]] = True
                d += 1
            task = [b"".join(t) for t in zip(*([v.to_bytes(8, "little", signed=True) for v in table[k].filter(pa.array(wanted)).to_pylist()] for k in ("band", "key", "low", "high")), strict=True)]
            return table.filter(pa.array(wanted)).select(["digest", "batch", "size", "root"]).append_column("task", pa.array(task, pa.binary())).select(["task", "digest", "batch", "size", "root"])

        return tiled.groupBy("task").applyInArrow(alike, "task binary, digest binary, batch int, size int, root binary")

    def linked_in_tiles(self, wanted: DataFrame, frequencies: DataFrame) -> DataFrame:
        """Exact links between texts of a tile that are in different classes, as (a, b) of these classes."""
        threshold = self.threshold
        n_groups = max(1, -(-(wanted.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0) // TASK_BYTES))
        vectors = self.sent_vectors(wanted.select("batch", "task", F.lit(0).alias("part"), "digest", "root"), frequencies)
        rooted = vectors.withColumn("group", F.pmod(F.xxhash64("task"), F.lit(n_groups)).cast("int"))

        def link(table: pa.Table) -> pa.Table:
            table = table.sort_by([("task", "ascending"), ("digest", "ascending")]).combine_chunks()
            tasks, names, packed = B.column(table, "task"), B.column(table, "root"), B.column(table, "vector")
            root = table["root"].combine_chunks().dictionary_encode().indices.to_numpy()
            edge = [i for i in range(len(tasks) + 1) if i in (0, len(tasks)) or tasks[i] != tasks[i - 1]]
            found = [(names[x + i], names[x + j]) for x, y in zip(edge[:-1], edge[1:], strict=True) for i, j in links([_unpacked(v) for v in packed[x:y]], root[x:y], threshold)]
            return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

        return rooted.groupBy("group").applyInArrow(link, "a binary, b binary")

    def classes(self) -> DataFrame:
        """(id, digest, batch, copy, root): one row for each document; root is its class. The tables behind it are removed."""
        rows = B.checkpoint(self._classes())
        B.remove_folder(rows.sparkSession, self.folder)
        return rows

    def keep(self, df: DataFrame) -> DataFrame:
        return B.checkpoint(df, self.folder)

    def _classes(self) -> DataFrame:
        frequencies = self.keep(self.document_frequencies())
        signed = self.keep(self.signatures(frequencies))
        texts = signed.groupBy("digest").agg(F.min(F.struct("batch", "bands", "size")).alias("s")).select("digest", "s.*")
        members = self.keep(texts.select("digest", "batch", "size", F.posexplode("bands").alias("band", "key")))
        chosen = F.min(F.struct(F.xxhash64("digest", "band").alias("h"), "digest", "batch")).alias("l")
        chunk = F.floor(F.col("batch") / LEADER_BATCHES).cast("int").alias("chunk")
        leaders = members.groupBy("band", "key", chunk).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long")).alias("bytes"), chosen)
        leaders = self.keep(leaders.select("band", "key", "chunk", "n", "bytes", "l"))
        buckets = leaders.groupBy("band", "key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("l").alias("first"), F.count(F.lit(1)).alias("chunks")).where("n > 1")
        buckets = self.keep(buckets)
        parts = F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")
        ahead = leaders.where("n > 1").select("band", "key", F.col("chunk").alias("c"), F.col("l.digest").alias("a"), F.col("l.batch").alias("a_batch"), parts)
        placed = self.keep(members.join(buckets.select("band", "key"), ["band", "key"]).withColumn("c", F.floor(F.col("batch") / LEADER_BATCHES).cast("int")))
        pairs = placed.join(ahead, ["band", "key", "c"]).where("digest <> a").select("a", "a_batch", F.col("digest").alias("b"), F.col("batch").alias("b_batch"), "parts")
        tops = buckets.where("chunks > 1").select("band", "key", F.col("first.digest").alias("a"), F.col("first.batch").alias("a_batch"), F.ceil(F.col("chunks") / BLOCK).cast("int").alias("parts"))
        between = leaders.join(tops, ["band", "key"]).where("l.digest <> a").select("a", "a_batch", F.col("l.digest").alias("b"), F.col("l.batch").alias("b_batch"), "parts")
        pairs = pairs.union(between).groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.struct("a", "a_batch", "b", "b_batch", "parts")).alias("p")).select("p.*")
        near = self.keep(self.verified(pairs, frequencies))
        found = components(self.folder, near)
        inside = self.keep(placed.join(found, F.col("digest") == F.col("node"), "left").select("band", "key", "digest", "batch", "size", F.coalesce("root", "digest").alias("root")))
        mixed = inside.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long")).alias("bytes"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
        mixed = self.keep(mixed.select("band", "key", "n", F.ceil(F.greatest(F.col("bytes") / TILE_BYTES, F.col("n") / TILE)).cast("int").alias("blocks")))
        sketches = signed.where("sketch <> X''").groupBy("digest").agg(F.min(F.struct("sketch", "bands")).alias("s")).select("digest", "s.*")
        wanted = self.keep(self.in_tiles(inside, sketches, mixed))
        rows = B.spread_join(signed, found.withColumnRenamed("node", "digest"), ["digest"], F.col("batch"), "left").select("id", "digest", "batch", "copy", F.coalesce("root", "digest").alias("root"))
        if wanted.isEmpty():
            return rows
        merged = components(self.folder, self.linked_in_tiles(wanted, frequencies)).select(F.col("node").alias("root"), F.col("root").alias("last"))
        return B.spread_join(rows, merged, ["root"], F.col("batch"), "left").select("id", "digest", "batch", "copy", F.coalesce("last", "root").alias("root"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of `docs`: its id, class_id (the least id of its class) and class_size (the class's rows).

    Equal texts are one class; null and empty texts are equal.  Texts of fewer words
    than a shingle are one shingle, so they join equal word sequences only.  A null id
    takes part like any other; the class_id of a class without any id is null.  Other
    columns are left out, whatever their names.  An empty table gives an empty table.
    """
    rows = NearDuplicates(docs, id_col, text_col, **options).classes()
    sizes = rows.groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return B.spread_join(rows, sizes, ["root"], F.col("batch")).select(F.col("id").alias(id_col), "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row with the least id of each class, and all its columns, whatever their names.

    Rows with an id go before those without; of rows equal in id and text one stays.
    Null and empty texts are one class.  An empty table gives an empty table.
    """
    plain, (key, text) = B.numbered(docs, id_col, text_col)
    work = NearDuplicates(plain, key, text, **options)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "copy", "batch")).alias("s")
    keepers = work.classes().groupBy("root").agg(first).select(F.col("s.batch").alias(B.BATCH), F.lit(0).alias(B.BUCKET), F.col("s.id").alias("id"), F.col("s.digest").alias("digest"))

    def keep(_, table: pa.Table, answers: pa.Table) -> pa.Table:
        wanted = set(zip(B.column(answers, "id"), B.column(answers, "digest"), strict=True))
        rows = []
        for i, (d, t) in enumerate(zip(B.column(table, key), B.column(table, text), strict=True)):
            if (found := (d, _digest(t))) in wanted:
                wanted.remove(found)
                rows.append(i)
        return table.drop_columns([B.BATCH]).take(pa.array(rows, pa.int64()))

    return B.with_answers(work.docs, keepers, keep, plain.schema).toDF(*docs.columns)
