"""Bounded-space online packing of encoded documents into windows of a fixed number of tokens.

Each partition keeps at most `open_windows` windows.  A document's full windows are
emitted at once; its remainder goes to the open window that it fills best; where none
has room and no further window may be opened, the fullest is emitted.  The windows
that are still open at a partition's end are merged, best fit first, among groups of
neighbouring partitions: a group's size does not depend on the table's.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import batches as B
from lectern.llm.tokens import encoder

WINDOW, OPEN_WINDOWS, END = 2048, 64, 1
#: Partitions whose open windows are merged together.
MERGED_PARTITIONS = 16
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class OpenWindows:
    """At most `limit` windows of `size` tokens; `place` gives the piece's window and offset there."""

    def __init__(self, size: int, limit: int, first_id: int):
        self.size, self.limit, self.next_id = size, limit, first_id
        self.room: list[tuple[int, int]] = []  # (free tokens, window), sorted

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, length: int) -> tuple[int, int]:
        at = bisect.bisect_left(self.room, (length, -1))
        if at == len(self.room):
            if len(self.room) == self.limit:
                self.room.pop(0)  # the fullest is done
            free, window = self.size, self.new_id()
        else:
            free, window = self.room.pop(at)
        if free > length:
            bisect.insort(self.room, (free - length, window))
        return window, self.size - free


def merge_windows(used: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """Best fit, longest first: each window's new window and the offset of its tokens there."""
    room: list[tuple[int, int]] = []
    out = {}
    for window, length in sorted(used.items(), key=lambda x: (-x[1], x[0])):
        at = bisect.bisect_left(room, (length, -1))
        free, target = room.pop(at) if at < len(room) else (size, window)
        out[window] = (target, size - free)
        if free > length:
            bisect.insort(room, (free - length, target))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", window: int = WINDOW, end_id: int = END, open_windows: int = OPEN_WINDOWS, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: id, start (its document's tokens before it), length, ids_crc32, doc_tokens, sequence_id, offset.

    `with_ids` adds the piece's ids as little-endian unsigned 32-bit integers: to build
    the sequences, join the ids of equal sequence_id by ascending offset and pad.
    A document is its ids and `end_id`; a null text is empty.  Rows with a null or a
    repeated id are documents of their own.  Other columns are left out, whatever
    their names.  An empty table gives an empty table.
    """
    schema = f"`{id_col}` bigint, {PIECES}, part int, still_open boolean" + ", ids binary" * with_ids
    end = int(end_id).to_bytes(4, "little")

    def place(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        windows = None
        held: list[tuple] = []  # pieces of windows that may still be open

        def rows(pieces: list[tuple]) -> pa.Table:
            still = {w for _, w in windows.room}
            columns = list(zip(*pieces, strict=True)) if pieces else [()] * (8 + with_ids)
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part"]
            out = {n: pa.array(c, pa.int32() if n == "part" else pa.int64()) for n, c in zip(names, columns, strict=False)}
            out["still_open"] = pa.array([s in still for s in columns[5]], pa.bool_())
            if with_ids:
                out["ids"] = pa.array(columns[8], pa.binary())
            return pa.table(out)

        for table in tables:
            if not table.num_rows:
                continue
            part = table["part"][0].as_py()
            windows = windows or OpenWindows(window, open_windows, part << 32)
            encode = encoder(tokenizer).encode
            for doc, text in zip(table[id_col].to_pylist(), table[text_col].to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    sequence, offset = (windows.new_id(), 0) if length == window else windows.place(length)
                    own = ids[4 * start : 4 * (start + length)]
                    held.append((doc, start, length, zlib.crc32(own), n, sequence, offset, part, *([own] if with_ids else [])))
            still = {w for _, w in windows.room}
            done = [p for p in held if p[5] not in still]
            held = [p for p in held if p[5] in still]
            yield rows(done)
        if windows:
            yield rows(held)

    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col), F.spark_partition_id().alias("part"))
    placed = B.checkpoint(source.mapInArrow(_tables(place), schema))
    columns = [c for c in placed.columns if c not in ("part", "still_open")]

    def merge(table: pa.Table) -> pa.Table:
        sequence = np.array(table["sequence_id"].to_pylist(), np.int64)
        length = np.array(table["length"].to_pylist(), np.int64)
        distinct, inverse = np.unique(sequence, return_inverse=True)
        used = np.zeros(len(distinct), np.int64)
        np.add.at(used, inverse, length)
        moved = merge_windows(dict(zip(distinct.tolist(), used.tolist(), strict=True)), window)
        target = [moved[s] for s in sequence.tolist()]
        offset = [o + t[1] for o, t in zip(table["offset"].to_pylist(), target, strict=True)]
        out = table.set_column(table.schema.get_field_index("sequence_id"), "sequence_id", pa.array([t[0] for t in target], pa.int64()))
        return out.set_column(out.schema.get_field_index("offset"), "offset", pa.array(offset, pa.int64())).select(columns)

    left = placed.where("still_open").groupBy(F.floor(F.col("part") / MERGED_PARTITIONS).alias("__group")).applyInArrow(merge, placed.select(columns).schema)
    return placed.where("not still_open").select(columns).union(left)


def _tables(function):
    """For mapInArrow: tables in, record batches out."""

    def apply(batches):
        for table in function(pa.Table.from_batches([b]) for b in batches):
            yield from table.to_batches()

    return apply
