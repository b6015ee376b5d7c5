"""Document fingerprints by content-defined chunking.

A gear hash of the last 16 bytes is taken at every byte at once.  A chunk ends at the
first place, at least `least` bytes after its start, whose hash has the strict mask's
bits clear, or after `usual` bytes those of the looser mask (normalised chunking), or
at `most` bytes.  So cuts depend on what stands around them: an insertion moves the
chunks beside it and no others.  A fingerprint is the set of the chunks' digests with
their lengths, and likeness the share of a text's bytes in chunks the other has too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm import batches as B
from lectern.llm.batches import shared_folder

LEAST, USUAL, MOST = 16, 40, 160
_WINDOW_STEPS = 4  # doublings: 16 bytes
_STRICT, _LOOSE = np.uint32(0b1111111 << 20), np.uint32(0b11111 << 20)
_GEAR = np.random.Generator(np.random.PCG64(99)).integers(0, 1 << 32, 256, dtype=np.uint32)
_BATCH_BYTES = 2 << 20
#: Of text in one sorted range.
RANGE_BYTES = 128 << 20
RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def gear(buffer: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gear values of the last 16 bytes, each shifted by its distance."""
    h = _GEAR[buffer]
    for k in range(_WINDOW_STEPS):
        step = 1 << k
        h[step:] += h[:-step] << np.uint32(step)
    return h


def cuts(parts: list[bytes]) -> list[np.ndarray]:
    """The chunk ends of each text, counted from its start; all texts are cut at the same time, chunk by chunk."""
    size = np.array([len(p) for p in parts], np.int64)
    offset = np.concatenate([[0], np.cumsum(size)])
    h = gear(np.frombuffer(b"".join(parts), np.uint8).copy()) if offset[-1] else np.empty(0, np.uint32)
    strict, loose = np.flatnonzero(h & _STRICT == 0) + 1, np.flatnonzero(h & _LOOSE == 0) + 1  # ends of chunks
    strict, loose = np.append(strict, offset[-1] + MOST), np.append(loose, offset[-1] + MOST)
    at, doc, found, owner = offset[:-1][size > 0].copy(), np.flatnonzero(size), [], []
    end = offset[1:][size > 0]
    while len(at):
        early = strict[np.searchsorted(strict, at + LEAST)]
        late = loose[np.searchsorted(loose, at + USUAL)]
        cut = np.minimum(np.where(early < at + USUAL, early, np.minimum(late, at + MOST)), end)
        found.append(cut - offset[doc])
        owner.append(doc)
        going = cut < end
        at, doc, end = cut[going], doc[going], end[going]
    if not found:
        return [np.empty(0, np.int64)] * len(parts)
    ends, owners = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return np.split(ends[order], np.searchsorted(owners[order], np.arange(1, len(parts))))


def chunk_sets(parts: list[bytes]) -> list[dict[int, int]]:
    """For each text the 40-bit digests of its distinct chunks, and their lengths."""
    digest = xxhash.xxh3_64_intdigest
    out = []
    for part, ends in zip(parts, cuts(parts), strict=True):
        low, found = 0, {}
        for high in ends.tolist():
            found[digest(part[low:high]) >> 24] = high - low
            low = high
        out.append(found)
    return out


def written(chunks: dict[int, int]) -> str:
    """Ten hex digits of digest and two of length for each chunk, in the order of the digests."""
    return "".join(["%010x%02x" % (d, chunks[d]) for d in sorted(chunks)])


def read(fingerprint: str) -> dict[int, int]:
    return {int(fingerprint[i : i + 10], 16): int(fingerprint[i + 10 : i + 12], 16) for i in range(0, len(fingerprint), 12)}


def containment(one: dict[int, int], other: dict[int, int]) -> float:
    """Share of `one`'s distinct chunks, by length, that `other` has. Of two empty texts 1, of one 0."""
    if not one:
        return 0.0 if other else 1.0
    return sum(n for d, n in one.items() if d in other) / sum(one.values())


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of each row's whole text; null and empty texts have an empty one. Other columns are left out."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _slices(batch["text"].to_pylist()):
                texts = batch["text"][low : high].to_pylist()
                sets = chunk_sets([_bytes(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch["id"][low:high], pa.array(map(written, sets), pa.string())], names=[id_col, "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(apply, f"`{id_col}` bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    low, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > _BATCH_BYTES:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def _compared(ids: list, texts: list[str], following: list[str]) -> dict:
    """Columns of the result; `following[i]` is the text after `texts[i]`, most often `texts[i + 1]`."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    sets = chunk_sets([*map(_bytes, texts), *map(_bytes, changed), _bytes(following[-1])])
    n = len(texts)
    own, edit, after = sets[:n], sets[n : 2 * n], [*sets[1:n], sets[-1]]
    return {
        "id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(_bytes(c)).hexdigest() for c in changed],
        "fingerprint": [written(s) for s in own], "edited_fingerprint": [written(s) for s in edit],
        "near_edited": [containment(a, b) for a, b in zip(own, edit, strict=True)], "near_next": [containment(a, b) for a, b in zip(own, after, strict=True)],
    }


_KINDS = {"id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64(), "part": pa.int32(), "first": pa.bool_(), "last": pa.bool_()}


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (its last half replaced by the next document's start), and their likeness.

    Next is by ascending id, after the last the first; equal ids go by a hash of their
    text, null ids come first.  A null text is empty.  A single row is its own next.
    Texts are read whole, whatever their length.  Other columns are left out.  An empty
    table gives an empty table.  The texts are sorted by ranges of the id; only the last
    row of each range waits for the first row of the next.
    """
    schema = f"id bigint, {RESULT}, part int, first boolean, last boolean, text string"
    names = [x.strip().split()[0] for x in schema.split(",")]

    def batch_of(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), _KINDS.get(c, pa.string())) for c in names], names=names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, 0
        for batch in batches:
            all_ids, all_texts = batch["id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()]
            for low, high in _slices(all_texts):
                ids, texts = all_ids[low:high], all_texts[low:high]
                if held is None:
                    part = batch["part"][0].as_py()
                    yield batch_of({"id": ids[:1], "part": [part], "first": [True], "text": texts[:1]}, 1)
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = (ids[-1], texts[-1])
                if len(ids) > 1:
                    yield batch_of(_compared(ids[:-1], texts[:-1], texts[1:]), len(ids) - 1)
        if held is not None:
            yield batch_of({"id": [held[0]], "part": [part], "last": [True], "text": [held[1]]}, 1)

    ordered = B.by_ranges(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", RANGE_BYTES)
    folder = shared_folder(docs.sparkSession, "fingerprints")  # compressed there, unlike a checkpoint
    ordered.withColumn("part", F.spark_partition_id()).mapInArrow(apply, schema).write.option("compression", "zstd").parquet(folder)
    rows = docs.sparkSession.read.schema(schema).parquet(folder)
    heads, tails = rows.where("first").select("part", "text"), rows.where("last").select("id", "part", "text")
    order = Window.orderBy("part")
    parts = heads.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("after"))  # one small row for each range
    waiting = tails.join(parts, "part").join(heads.select(F.col("part").alias("after"), F.col("text").alias("following")), "after").select("id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, f in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), batch["following"].to_pylist(), strict=True):
                yield batch_of(_compared([i], [t], [f]), 1)

    result = ["id", *names[1:7]]
    done = rows.where("first is null and last is null").select(result).union(waiting.mapInArrow(finish, schema).select(result))
    return done.withColumnRenamed("id", id_col)
