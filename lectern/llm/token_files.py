"""Files of token ids with a minimal perfect hash index.

`write_token_files` sorts the documents by id and writes one shard for each range of
ids: a file of raw little-endian ids (two bytes each where the vocabulary allows, else
four) and an index file.  The index maps each document id of the shard to its place by
a minimal perfect hash (hash and displace): a seed for each bucket of keys, and for
each slot a 64-bit fingerprint of its key and where its tokens are.  A lookup reads one
seed, one slot and the tokens by their offsets, whatever the shard's size; an id that
is not there is told by its fingerprint.

Tasks write under names of their own and report them; only reported files count, so a
task that is lost or runs twice leaves an unused file and no wrong data.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm import batches as B
from lectern.llm.tokens import encoder
from lectern.llm.words import mix

MAGIC = b"LECTERN1"
MANIFEST = "shard int, ids_path string, index_path string, n_docs bigint, n_ids bigint, first_id bigint, last_id bigint"
_STEP = np.uint64(0xA0761D6478BD642F)
#: Of text in one shard, and shards that a task of `lookup` holds open.
SHARD_BYTES, OPEN_SHARDS = 128 << 20, 64


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class MinimalPerfectHash:
    """`slots(keys)`: a place from 0 to n - 1 for each of the n distinct keys it was built on, each its own."""

    def __init__(self, n: int, seeds: np.ndarray):
        self.n, self.seeds = n, seeds

    @staticmethod
    def build(keys: np.ndarray) -> MinimalPerfectHash:
        n = len(keys)
        m = max(1, -(-n // 4))
        h = mix(keys.astype(np.uint64) + np.uint64(1))
        order = np.argsort(h % np.uint64(m), kind="stable")
        edge = np.searchsorted((h % np.uint64(m))[order], np.arange(m + 1, dtype=np.uint64))
        seeds, taken = np.zeros(m, np.uint32), np.zeros(n, bool)
        sizes = np.diff(edge)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[sizes[by_size] > 1].tolist():
            own = h[order[edge[b] : edge[b + 1]]]
            low = 0
            while True:
                tried = np.arange(low, low + 16, dtype=np.uint64)
                slots = np.sort(mix(own[None, :] + (tried[:, None] + np.uint64(1)) * _STEP) % np.uint64(n), axis=1)
                fits = np.flatnonzero(~taken[slots].any(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1))
                if len(fits):
                    seeds[b] = low + fits[0]
                    taken[slots[fits[0]]] = True
                    break
                low += 16
        single = np.flatnonzero(sizes == 1)
        seeds[single] = np.uint32(1 << 31) | np.flatnonzero(~taken)[: len(single)].astype(np.uint32)  # the slot itself
        return MinimalPerfectHash(n, seeds)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        h = mix(keys.astype(np.uint64) + np.uint64(1))
        seed = self.seeds[(h % np.uint64(len(self.seeds))).astype(np.int64)]
        return self.placed(h, seed, self.n)

    @staticmethod
    def placed(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
        hashed = mix(h + (seed.astype(np.uint64) + np.uint64(1)) * _STEP) % np.uint64(n)
        return np.where(seed >> 31, seed & np.uint32(0x7FFFFFFF), hashed).astype(np.int64)


SLOT = np.dtype([("print", "<u8"), ("row", "<i8"), ("count", "<i8"), ("begin", "<i8"), ("end", "<i8")])
_HEAD = 40


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """64 bits, different for different keys."""
    return mix(keys.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))


def index_bytes(ids: np.ndarray, lengths: np.ndarray, n_null: int) -> bytes:
    """The index of a shard whose documents have these ids, ascending, and as many tokens; null ids come first and have no key.

    A head, the seeds, the slots (fingerprint of the key, its first row, how many rows
    have it, where their tokens begin and end), and all rows' edges and ids, which only
    a reader of the whole shard needs.
    """
    edge = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    keys, first, count = np.unique(ids[n_null:], return_index=True, return_counts=True)
    table = MinimalPerfectHash.build(keys)
    slots = np.zeros(len(keys), SLOT)
    at = table.slots(keys)
    slots["print"][at], slots["row"][at], slots["count"][at] = fingerprints(keys), first + n_null, count
    slots["begin"][at], slots["end"][at] = edge[first + n_null], edge[first + n_null + count]
    head = np.array([len(ids), n_null, len(keys), len(table.seeds)], "<i8")
    return MAGIC + b"".join(x.tobytes() for x in (head, table.seeds.astype("<u4"), slots, edge, ids.astype("<i8")))


class Shard:
    """A shard's two files, read by offsets: a lookup reads one seed, one slot and the tokens, however large the shard is."""

    def __init__(self, ids_path: str, index_path: str):
        system, path = open_folder(ids_path)
        self.tokens, self.index = system.open_input_file(path), system.open_input_file(open_folder(index_path)[1])
        self.kind = np.dtype("<" + ids_path.rsplit(".", 1)[1])
        if self.index.read_at(8, 0) != MAGIC:
            raise ValueError("not an index file")
        self.n, self.n_null, self.n_keys, self.n_seeds = (int(x) for x in np.frombuffer(self.index.read_at(32, 8), "<i8"))
        self.slots_at = _HEAD + 4 * self.n_seeds
        self.edges_at = self.slots_at + SLOT.itemsize * self.n_keys

    def close(self) -> None:
        self.tokens.close()
        self.index.close()

    def read(self, begin: int, end: int) -> bytes:
        """Tokens as little-endian unsigned 32-bit integers."""
        wide = self.kind.itemsize
        return np.frombuffer(self.tokens.read_at((end - begin) * wide, begin * wide), self.kind).astype("<u4").tobytes()

    def lookup(self, key: int) -> list[bytes]:
        """The tokens of each document of that id."""
        if not self.n_keys:
            return []
        one = np.array([key], np.int64)
        h = mix(one.astype(np.uint64) + np.uint64(1))
        seed = np.frombuffer(self.index.read_at(4, _HEAD + 4 * int(h[0] % np.uint64(self.n_seeds))), "<u4")
        at = int(MinimalPerfectHash.placed(h, seed, self.n_keys)[0])
        slot = np.frombuffer(self.index.read_at(SLOT.itemsize, self.slots_at + SLOT.itemsize * at), SLOT)[0]
        if slot["print"] != fingerprints(one)[0]:
            return []
        if slot["count"] == 1:
            return [self.read(int(slot["begin"]), int(slot["end"]))]
        edge = np.frombuffer(self.index.read_at(8 * (int(slot["count"]) + 1), self.edges_at + 8 * int(slot["row"])), "<i8").tolist()
        return [self.read(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the edges of their tokens."""
        data = self.index.read_at(8 * (2 * self.n + 1), self.edges_at)
        return np.frombuffer(data, "<i8", self.n, 8 * (self.n + 1)), np.frombuffer(data, "<i8", self.n + 1)


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Writes the shards and gives the manifest: one row for each shard, in the order of `shard`.

    A document is its ids and `end_id`; a null text is empty.  Rows with a null id come
    first and have no key; repeated ids lie side by side, in the order of a hash of their
    texts.  Texts are encoded whole, whatever their length.  Other columns are left out.
    An empty table gives an empty manifest.
    """
    end = int(end_id).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, ids, lengths, n_null = None, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            code = encoder(tokenizer)
            if stream is None:
                shard, name = batch["shard"][0].as_py(), uuid.uuid4().hex
                system, root = open_folder(folder)
                system.create_dir(root, recursive=True)
                kind = "<u2" if len(code.packed) <= 1 << 16 else "<u4"
                ids_path, index_path = (f"{folder}/{shard:06d}-{name}.{kind[1:]}", f"{folder}/{shard:06d}-{name}.index")
                stream = system.open_output_stream(ids_path.replace(folder, root))
            for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = np.frombuffer(code.encode(text or "") + end, "<u4")
                stream.write(own.astype(kind).tobytes())
                ids.append(0 if key is None else key)
                n_null += key is None
                lengths.append(len(own))
        if stream is not None:
            stream.close()
            with system.open_output_stream(index_path.replace(folder, root)) as f:
                f.write(index_bytes(np.array(ids, np.int64), np.array(lengths, np.int64), n_null))
            keys = ids[n_null:] or [None]
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "ids_path": [ids_path], "index_path": [index_path], "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([sum(lengths)], pa.int64()), "first_id": pa.array(keys[:1], pa.int64()), "last_id": pa.array(keys[-1:], pa.int64())})

    ordered = B.by_ranges(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", SHARD_BYTES)
    return B.checkpoint(ordered.withColumn("shard", F.spark_partition_id()).mapInArrow(write, MANIFEST))


def read_token_files(manifest: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Every document from the files, each found by its key: id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = manifest.select("shard", before.alias("before"))
    schema = f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, given = Shard(row["ids_path"], row["index_path"]), 0
                ids, edge = shard.rows()
                found: list[bytes] = []
                for r in range(shard.n):
                    if r < shard.n_null:
                        found.append(shard.read(int(edge[r]), int(edge[r + 1])))
                    elif r == shard.n_null or ids[r] != ids[r - 1]:
                        found += shard.lookup(int(ids[r]))
                    if len(found) >= 500 or r == shard.n - 1:
                        done, part = found, range(given, given + len(found))
                        given, found = given + len(done), []
                        out = {id_col: pa.array([None if i < shard.n_null else int(ids[i]) for i in part], pa.int64()), "start": pa.array([row["before"] + int(edge[i]) for i in part], pa.int64()), "n_tokens": pa.array([len(x) // 4 for x in done], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in done], pa.int64())}
                        if with_ids:
                            out["ids"] = pa.array(done, pa.binary())
                        yield pa.RecordBatch.from_pydict(out)
                shard.close()

    shards = manifest.join(starts, "shard").select("ids_path", "index_path", "before").repartition(max(1, manifest.rdd.getNumPartitions()), "ids_path")
    return shards.mapInArrow(read, schema)


def lookup(manifest: DataFrame, keys: DataFrame, key_col: str) -> DataFrame:
    """(key, ids) for each row of `keys` that the files hold, once for each document of that id; null keys are not found.

    Each task finds its keys' shards by bisection of their ranges of ids: all tasks get
    the names and ranges of the shards, some 200 bytes for each SHARD_BYTES of text, and
    no key is shuffled.
    """
    rows = [tuple(r) for r in manifest.where("first_id is not null").orderBy("first_id", "last_id").select("first_id", "last_id", "ids_path", "index_path").toLocalIterator()]
    sent = keys.sparkSession.sparkContext.broadcast(rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = sent.value
        first, last = np.array([r[0] for r in ranges], np.int64), np.array([r[1] for r in ranges], np.int64)
        held: dict[int, Shard] = {}
        for batch in batches:
            out_keys, out = [], []
            for key in batch["key"].to_pylist():
                for k in range(np.searchsorted(last, key, "left"), np.searchsorted(first, key, "right")):
                    if k not in held:
                        while len(held) >= OPEN_SHARDS:
                            held.pop(next(iter(held))).close()
                        held[k] = Shard(*ranges[k][2:])
                    own = held[k].lookup(key)
                    out_keys += [key] * len(own)
                    out += own
            yield pa.RecordBatch.from_arrays([pa.array(out_keys, pa.int64()), pa.array(out, pa.binary())], names=[key_col, "ids"])

    return keys.select(F.col(f"`{key_col}`").cast("long").alias("key")).where("key is not null").mapInArrow(read, f"`{key_col}` bigint, ids binary")
