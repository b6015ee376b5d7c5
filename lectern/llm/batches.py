"""Documents in batches of bounded size, and exchanges of packed arrays between batches and hash buckets.

A batch packs what it asks about (sorted distinct keys, a small value for each) into
one binary value for each bucket of the key space; the bucket answers every batch by
one small code for each key, in the order in which they came.  So one row carries
many keys, no key is repeated within a batch, and a key that a third of all documents
share costs a bucket one entry for each batch, not one for each document.

A batch has at most FAN rows, however many batches there are, so rows grow with the
input.  Where FAN buckets would become too large for a task, each is split by a second
exchange: CHUNK batches' entries of a bucket are merged and dealt to inner buckets.
"""

from __future__ import annotations

import gc
import math
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, BUCKET, PAYLOAD = "__batch", "__bucket", "__payload"
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4000
#: Buckets of a level; batches whose entries fill a bucket, and whose entries are merged for the second level.
FAN, CHUNK = 1024, 3072
PACKED = f"{BUCKET} int, {BATCH} int, {PAYLOAD} binary"
SALTS = 256


def checkpoint_ready(spark: SparkSession) -> None:
    """Use the session's spark.checkpoint.dir. Only a local session without one, as in tests, gets a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not folder:
            import tempfile

            folder = tempfile.mkdtemp(prefix="lectern-")
        context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors share."""
    checkpoint_ready(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame, within: str | None = None) -> DataFrame:
    """The rows, written to a table in the shared folder and read again: later jobs neither repeat the work nor plan it.

    `within`: a folder of tables that go together, by `remove_folder`.

    The shuffles behind them are needed no more, but Spark removes their files only
    when the driver next collects its garbage; that is asked for here, so that the
    shuffles of one stage after another don't pile up on the disks.
    """
    spark, schema = df.sparkSession, df.schema
    folder = f"{within}/{uuid.uuid4().hex}" if within else shared_folder(spark, "table")
    df.write.option("compression", "zstd").parquet(folder)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files that nothing refers to any more.

    Spark's queues hold on to the end of the last job, and with it to its shuffles, until
    another has ended; so a job of one row comes first.
    """
    spark.range(1).collect()
    gc.collect()
    spark._jvm.System.gc()


def spread_join(df: DataFrame, table: DataFrame, keys: list[str], by: Column, how: str = "inner") -> DataFrame:
    """`df` joined with `table`, which has each key once, without bringing a hot key's rows to one task.

    A key's rows are dealt by the hash of `by` to SALTS groups; `table` is joined with
    the distinct keys of each group, and only then with the rows.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    known = salted.select("__salt", *keys).distinct().join(table, keys)
    return salted.join(known, ["__salt", *keys], how).drop("__salt")


def fresh(name: str, taken: list[str]) -> str:
    """`name`, lengthened until no column has it."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def numbered(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """The rows under the names c0, c1 ..., which clash with nothing, and what `columns` are called there."""
    lower = [c.lower() for c in docs.columns]
    return docs.toDF(*[f"c{i}" for i in range(len(lower))]), [f"c{lower.index(c.lower())}" for c in columns]


def in_batches(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, int]:
    """The documents with a batch number, and the number of batches: about BATCH_BYTES of text in each.

    The number depends on a row's id and text alone, so that every pass deals the rows
    alike; rows equal in both are in one batch.
    """
    total = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n = max(1, math.ceil((total["b"] or 0) / BATCH_BYTES + total["n"] / (4 * BATCH_ROWS)))
    return docs.withColumn(BATCH, F.pmod(F.xxhash64(key, text, F.lit(7)), F.lit(n)).cast("int")), n


def by_ranges(rows: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> DataFrame:
    """The rows in ranges of ascending id, each of about `shard_bytes` of text or less, sorted.

    Null ids come first; equal ids go by a hash of their text and may fill several ranges.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    tie = fresh("tie", rows.columns)
    tied = rows.withColumn(tie, F.xxhash64(text_col))
    return tied.repartitionByRange(n, id_col, tie).sortWithinPartitions(id_col, tie, text_col).drop(tie)


def column(table: pa.Table, name: str) -> list:
    return table[name].to_pylist()


def packed_rows(batch: int, payloads: dict[int, bytes]) -> pa.Table:
    return pa.table({BUCKET: pa.array(list(payloads), pa.int32()), BATCH: pa.array([batch] * len(payloads), pa.int32()), PAYLOAD: pa.array(list(payloads.values()), pa.binary())})


def deflate(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def inflate(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def grouped(ids: np.ndarray, stable: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts ids (numbers, or records by their fields), and where in it each run of equal ids begins."""
    if ids.dtype.names:
        order = np.lexsort([ids[f] for f in reversed(ids.dtype.names)])
    else:
        order = np.argsort(ids, kind="stable" if stable else None)
    ordered = ids[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ids) else np.empty(0, np.int64)


def repeats(begin: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(begin, n))


@dataclass(frozen=True)
class Exchange:
    """Entries (a key and a value) of batches meet in buckets.

    `combine(values, begin)` merges the values of the runs that begin at `begin` to one
    value each, of the same kind; merging merged values must give the same.
    `code(values, totals)` gives the answer to each entry from its own value and the
    merged one, as uint8.
    """

    n_batches: int
    value: np.dtype
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray]
    code: Callable[[np.ndarray, np.ndarray], np.ndarray]
    record: np.dtype | None = None

    @property
    def buckets(self) -> int:
        return max(4, min(FAN, self.n_batches // 3))

    @property
    def inner(self) -> int:
        """Inner buckets of each bucket; 1 where one level is enough."""
        return max(1, -(-self.n_batches // CHUNK))

    @property
    def key(self) -> np.dtype:
        return np.dtype(self.record or (np.uint32 if self.inner == 1 else np.uint64))

    def split(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys of 64-bit hashes, sorted by bucket and distinct; each hash's place among them; the bucket edges."""
        n, ends = np.uint64(self.buckets), np.arange(self.buckets + 1, dtype=np.uint64)
        if self.inner == 1:
            joint = ((hashes % n) << np.uint64(32)) | (hashes >> np.uint64(32))
            distinct, inverse = np.unique(joint, return_inverse=True)
            return (distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32), inverse, np.searchsorted(distinct, ends << np.uint64(32))
        distinct, inverse = np.unique(hashes, return_inverse=True)
        order = np.argsort(distinct % n, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return distinct[order], place[inverse], np.searchsorted((distinct % n)[order], ends)

    def pack(self, batch: int, keys: np.ndarray, values: np.ndarray, edges: np.ndarray) -> pa.Table:
        return packed_rows(batch, {b: self._payload(keys[x:y], values[x:y]) for b, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if y > x})

    def _payload(self, keys: np.ndarray, values: np.ndarray) -> bytes:
        return keys.astype(self.key).tobytes() + values.astype(self.value).tobytes()

    def _unpack(self, payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        wide = self.key.itemsize
        sizes = [len(p) // (wide + self.value.itemsize) for p in payloads]
        keys = [np.frombuffer(p, self.key, n) for p, n in zip(payloads, sizes, strict=True)]
        values = [np.frombuffer(p, self.value, n, wide * n) for p, n in zip(payloads, sizes, strict=True)]
        return np.concatenate(keys), np.concatenate(values), sizes

    def _totals(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The merged value of each entry's key."""
        order, begin = grouped(keys)
        out = np.empty(len(keys), self.value)
        out[order] = np.repeat(self.combine(values[order], begin).astype(self.value), repeats(begin, len(keys)))
        return out

    def _answers(self, values: np.ndarray, totals: np.ndarray, sizes: list[int]) -> pa.Array:
        codes = self.code(values, totals).astype(np.uint8)
        return pa.array([deflate(x) for x in np.split(codes, np.cumsum(sizes)[:-1])], pa.binary())

    def answers(self, rows: DataFrame) -> DataFrame:
        """A code for each entry of `rows`, which come from `pack`; rows of negative buckets come back as they are."""
        if self.inner == 1:

            def answer(table: pa.Table) -> pa.Table:
                if table[BUCKET][0].as_py() < 0:
                    return table.select([BUCKET, BATCH, PAYLOAD])
                keys, values, sizes = self._unpack(column(table, PAYLOAD))
                return pa.table({BUCKET: table[BUCKET], BATCH: table[BATCH], PAYLOAD: self._answers(values, self._totals(keys, values), sizes)})

            return rows.groupBy(BUCKET).applyInArrow(answer, PACKED)
        inner, of_chunk = self.inner, f"{BUCKET} int, chunk int, inner int, {PAYLOAD} binary"
        rows = rows.withColumn("chunk", F.floor(F.col(BATCH) / CHUNK).cast("int"))

        def merge(table: pa.Table) -> pa.Table:
            keys, values, _ = self._unpack(column(table, PAYLOAD))
            order, begin = grouped(keys)
            merged, own = self.combine(values[order], begin), keys[order][begin]
            part = own[self.key.names[0]] % np.uint64(inner) if self.key.names else own // np.uint64(self.buckets) % np.uint64(inner)
            by = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[by], np.arange(inner + 1, dtype=np.uint64))
            filled = np.flatnonzero(edge[1:] > edge[:-1]).tolist()
            payloads = [self._payload(own[by[edge[i] : edge[i + 1]]], merged[by[edge[i] : edge[i + 1]]]) for i in filled]
            n = len(filled)
            return pa.table({BUCKET: table[BUCKET].slice(0, 1).take(pa.array([0] * n, pa.int64())), "chunk": table["chunk"].slice(0, 1).take(pa.array([0] * n, pa.int64())), "inner": pa.array(filled, pa.int32()), PAYLOAD: pa.array(payloads, pa.binary())})

        def total(table: pa.Table) -> pa.Table:
            keys, values, sizes = self._unpack(column(table, PAYLOAD))
            totals, cut = self._totals(keys, values), np.cumsum(sizes)[:-1]
            payloads = [self._payload(k, t) for k, t in zip(np.split(keys, cut), np.split(totals, cut), strict=True)]
            return table.select([BUCKET, "chunk", "inner"]).append_column(PAYLOAD, pa.array(payloads, pa.binary()))

        def back(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows:
                return left.select([BUCKET, BATCH, PAYLOAD])
            known, totals, _ = self._unpack(column(right, PAYLOAD))
            keys, values, sizes = self._unpack(column(left, PAYLOAD))
            both = np.concatenate([known, keys])
            order, begin = grouped(both)
            run = np.repeat(np.arange(len(begin)), repeats(begin, len(both)))
            of_run, where = np.empty(len(begin), self.value), np.empty(len(both), np.int64)
            where[order] = run
            of_run[where[: len(known)]] = totals
            return pa.table({BUCKET: left[BUCKET], BATCH: left[BATCH], PAYLOAD: self._answers(values, of_run[where[len(known) :]], sizes)})

        merged = rows.where(F.col(BUCKET) >= 0).groupBy(BUCKET, "chunk").applyInArrow(merge, of_chunk)
        totals = merged.groupBy(BUCKET, "inner").applyInArrow(total, of_chunk)
        return rows.groupBy(BUCKET, "chunk").cogroup(totals.groupBy(BUCKET, "chunk")).applyInArrow(back, PACKED)


def by_batch(docs: DataFrame, function: Callable[[int, pa.Table], pa.Table], schema: str = PACKED) -> DataFrame:
    def apply(table: pa.Table) -> pa.Table:
        return function(table[BATCH][0].as_py(), table)

    return docs.groupBy(BATCH).applyInArrow(apply, schema)


def with_answers(docs: DataFrame, answers: DataFrame, function: Callable[[int, pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """`function` gets each batch with the answers to it, by ascending bucket."""

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        return function(left[BATCH][0].as_py(), left, right.sort_by(BUCKET))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).empty_table()
    return docs.groupBy(BATCH).cogroup(answers.groupBy(BATCH)).applyInArrow(apply, schema)
