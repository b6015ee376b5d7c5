"""Best-fit packing of whole documents by swap-based local search.

Documents longer than a window are cut at its multiples; what is shorter than a window
is never cut.  Each task gathers items until they fill about `group` windows, places
them best fit, longest first, and then improves the bins: the least filled bin gives
items away by moves, exchanges of one for one, of two for one and of one for two, each of which
increases the sum of squared fills, until it is empty.  Bins that stay underfull are
carried to the task's next group, and those left at its end are searched again with
those of neighbouring tasks.  A group's size depends on no table's size.
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

WINDOW, END = 2048, 0
#: Windows' worth of tokens that are searched together; underfull bins that go on to the next group; tasks whose last bins are searched together.
GROUP, CARRIED, MERGED_PARTITIONS = 512, 64, 16
#: Bins in a row that nothing improves, after which a search ends.
STUCK = 16
PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def best_fit(length: np.ndarray, size: int) -> np.ndarray:
    """Each item's bin, longest first, in the bin that it fills best."""
    where = np.empty(len(length), np.int64)
    room: list[tuple[int, int]] = []
    n = 0
    for i in np.argsort(-length, kind="stable").tolist():
        own = int(length[i])
        at = bisect.bisect_left(room, (own, -1))
        if at == len(room):
            free, target, n = size, n, n + 1
        else:
            free, target = room.pop(at)
        where[i] = target
        if free > own:
            bisect.insort(room, (free - own, target))
    return where


def least_bins(length: np.ndarray, size: int) -> int:
    """No packing has fewer bins: by all tokens, and by items above size - k, which share with none of k or more."""
    ordered = np.sort(length)
    sums = np.concatenate([[0], np.cumsum(ordered)])
    out = -(-int(sums[-1]) // size)
    half = int(np.searchsorted(ordered, size // 2, side="right"))  # from here on items are above a half
    for k in np.unique(ordered[:half]).tolist():
        large = int(np.searchsorted(ordered, size - k, side="right"))
        low = int(np.searchsorted(ordered, k))
        middle, free = int(sums[half] - sums[low]), (large - half) * size - int(sums[large] - sums[half])
        out = max(out, len(ordered) - half + max(0, -(-(middle - free) // size)))
    return max(out, len(ordered) - half)


class LocalSearch:
    """Items of `length` in bins `where`; `run` empties bins."""

    def __init__(self, length: np.ndarray, where: np.ndarray, size: int):
        self.length, self.where, self.size = length, where.copy(), size
        self.fill = np.bincount(where, weights=length).astype(np.int64)

    @property
    def bins(self) -> int:
        return int((self.fill > 0).sum())

    def _item(self, b: int, length: int, but: tuple[int, ...] = ()) -> int:
        found = np.flatnonzero((self.where == b) & (self.length == length))
        return next(i for i in found.tolist() if i not in but)

    def _put(self, item: int, b: int) -> None:
        own = int(self.length[item])
        self.fill[self.where[item]] -= own
        self.fill[b] += own
        self.where[item] = b

    def _move(self, donor: int, own: np.ndarray, targets: np.ndarray) -> bool:
        """The longest item that has room elsewhere goes where it fits best."""
        room = self.size - self.fill[targets]
        for x in own[::-1].tolist():
            fits = targets[room >= x]
            if len(fits):
                self._put(self._item(donor, x), int(fits[np.argmax(self.fill[fits])]))
                return True
        return False

    def _exchange(self, donor: int, given: np.ndarray, items: np.ndarray) -> tuple[int, int] | None:
        """Of the amounts `given`, the first, longest first, that an item elsewhere may be exchanged for: (amount, that item)."""
        at, taken = self.where[items], self.length[items]
        room, above = self.size - self.fill[at], self.fill[at] - self.fill[donor]
        for x in given[::-1].tolist():
            d = x - taken
            gain = np.where((d > 0) & (d <= room), d * (above + d), 0)
            best = int(np.argmax(gain))
            if gain[best] > 0:
                return x, int(items[best])
        return None

    def _one_for_one(self, donor: int, own: np.ndarray, items: np.ndarray) -> bool:
        found = self._exchange(donor, own, items)
        if found:
            target = int(self.where[found[1]])
            self._put(self._item(donor, found[0]), target)
            self._put(found[1], donor)
        return found is not None

    def _two_for_one(self, donor: int, own: np.ndarray, many: np.ndarray, items: np.ndarray) -> bool:
        pairs = _pair_sums(own, many)
        found = self._exchange(donor, np.array(sorted(pairs), np.int64), items)
        if found:
            x, y = pairs[found[0]]
            first, target = self._item(donor, x), int(self.where[found[1]])
            second = self._item(donor, y, (first,))
            for item, b in ((first, target), (second, target), (found[1], donor)):
                self._put(item, b)
        return found is not None

    def _one_for_two(self, donor: int, own: np.ndarray, targets: np.ndarray) -> bool:
        for b in targets[np.argsort(self.fill[targets])].tolist():
            lengths, many = np.unique(self.length[self.where == b], return_counts=True)
            pairs = _pair_sums(lengths, many)
            if not pairs:
                continue
            sums = np.array(sorted(pairs), np.int64)
            d = own[:, None] - sums[None, :]
            gain = np.where((d > 0) & (d <= self.size - self.fill[b]), d * (self.fill[b] - self.fill[donor] + d), 0)
            best = int(np.argmax(gain))
            if gain.flat[best] > 0:
                x, y = pairs[int(sums[best % len(sums)])]
                item, first = self._item(donor, int(own[best // len(sums)])), self._item(b, x)
                second = self._item(b, y, (first,))
                for i, to in ((first, donor), (second, donor), (item, b)):
                    self._put(i, to)
                return True
        return False

    def drain(self, donor: int) -> bool:
        """Gives away from the bin while a step increases the squared fill; True if it is empty then."""
        while self.fill[donor]:
            own, many = np.unique(self.length[self.where == donor], return_counts=True)
            open_bins = (self.fill < self.size) & (self.fill >= self.fill[donor])
            open_bins[donor] = False
            targets = np.flatnonzero(open_bins)
            items = np.flatnonzero(open_bins[self.where])
            if not (len(targets) and (self._move(donor, own, targets) or self._one_for_one(donor, own, items) or self._two_for_one(donor, own, many, items) or self._one_for_two(donor, own, targets))):
                return False
        return True

    def run(self) -> np.ndarray:
        """Drains the least filled bins, one after another, until their number is the least possible or STUCK bins in a row aren't emptied."""
        least, stuck, tried = least_bins(self.length, self.size), 0, set()
        while stuck < STUCK and (stuck == 0 or self.bins > least):
            open_bins = [b for b in np.flatnonzero((self.fill > 0) & (self.fill < self.size)).tolist() if b not in tried]
            if not open_bins:
                break
            donor = min(open_bins, key=lambda b: (self.fill[b], b))
            if self.drain(donor):
                stuck, tried = 0, set()
            else:
                stuck += 1
                tried.add(donor)
        return self.where


def _pair_sums(lengths: np.ndarray, many: np.ndarray) -> dict[int, tuple[int, int]]:
    """A pair of lengths for each sum that two of a bin's items have."""
    out = {}
    for i, x in enumerate(lengths.tolist()):
        for y in lengths[i if many[i] > 1 else i + 1 :].tolist():
            out.setdefault(x + y, (x, y))
    return out


def search(length: np.ndarray, size: int = WINDOW, present: np.ndarray | None = None) -> np.ndarray:
    """Each item's bin, from the best fit or, if that has fewer bins, from the `present` ones."""
    where = best_fit(length, size) if len(length) else np.empty(0, np.int64)
    if present is not None and len(np.unique(present)) < len(np.unique(where)):
        where = present
    return LocalSearch(length, where, size).run() if len(length) else where


def _laid_out(length: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Each item's offset in its bin, in the order of items."""
    order = np.argsort(where, kind="stable")
    ends = np.cumsum(length[order])
    starts = ends - length[order]
    first = np.concatenate([[True], where[order][1:] != where[order][:-1]]) if len(order) else np.empty(0, bool)
    out = np.empty(len(length), np.int64)
    out[order] = starts - np.maximum.accumulate(np.where(first, starts, 0)) if len(order) else starts
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, end_id: int = END, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start (its document's tokens before it), length, ids_crc32, sequence_id and offset there.

    A document is its ids and `end_id`; a null or empty text is that alone.  Documents
    of at most `window` tokens are one piece; longer ones are cut at multiples of it,
    so a very long text is many full windows and one rest.  Rows with null, equal or
    repeated ids are documents of their own.  Other columns are left out, whatever
    their names.  An empty table gives an empty table.  Ties: of equally filled bins
    the first takes the item, of equally long items the first is placed first.
    `with_ids` adds the piece's ids as little-endian unsigned 32-bit integers.
    """
    schema = f"`{id_col}` bigint, {PIECES}, part int, still_open boolean" + ", ids binary" * with_ids
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    end = int(end_id).to_bytes(4, "little")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, next_id = encoder(tokenizer).encode, None, 0
        pool: list[tuple] = []
        full: list[tuple] = []
        tokens = 0

        def rows(items: list[tuple], sequence: np.ndarray, offset: np.ndarray, still: np.ndarray) -> pa.RecordBatch:
            columns = list(zip(*items, strict=True)) if items else [()] * (5 + with_ids)
            out = {n: pa.array(c, k) for n, k, c in zip(names, kinds, columns, strict=False)}
            out |= {"sequence_id": pa.array(sequence + (part << 32), pa.int64()), "offset": pa.array(offset, pa.int64()), "part": pa.array([part] * len(items), pa.int32()), "still_open": pa.array(still, pa.bool_())}
            if with_ids:
                out["ids"] = pa.array(columns[5], pa.binary())
            return pa.RecordBatch.from_pydict(out)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pool, full, tokens, next_id
            if full:
                yield rows(full, np.arange(next_id, next_id + len(full)), np.zeros(len(full), np.int64), np.zeros(len(full), bool))
                next_id, full = next_id + len(full), []
            if not pool:
                return
            length = np.array([x[3] for x in pool], np.int64)
            where = search(length, window)
            fill = np.bincount(where, weights=length)
            under = np.flatnonzero((fill > 0) & (fill < window))
            kept = np.zeros(len(fill), bool)
            kept[under[np.argsort(fill[under], kind="stable")][:CARRIED]] = True
            number = np.cumsum(fill > 0) - 1 + next_id
            next_id += int((fill > 0).sum())
            still = kept[where]
            offset = _laid_out(length, where)
            if last:
                yield rows(pool, number[where], offset, still)
            else:
                done = np.flatnonzero(~still)
                yield rows([pool[i] for i in done.tolist()], number[where][done], offset[done], still[done])
                pool = [pool[i] for i in np.flatnonzero(still).tolist()]
                tokens = sum(x[3] for x in pool)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch["part"][0].as_py()
            for doc, text in zip(batch[id_col].to_pylist(), batch[text_col].to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, window)):
                    length = min(window, n - start)
                    own = ids[4 * start : 4 * (start + length)]
                    item = (doc, k, start, length, zlib.crc32(own), *([own] if with_ids else []))
                    if length == window:
                        full.append(item)
                    else:
                        pool.append(item)
                        tokens += length
                if tokens >= (group + CARRIED) * window or len(full) >= group:
                    yield from flush(False)
        if part is not None:
            yield from flush(True)

    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col), F.spark_partition_id().alias("part"))
    placed = B.checkpoint(source.mapInArrow(place, schema))
    columns = [c for c in placed.columns if c not in ("part", "still_open")]

    def again(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        length = table["length"].to_numpy()
        own, present = np.unique(table["sequence_id"].to_numpy(), return_inverse=True)
        where = search(length, window, present)
        # a bin is called by a number that no other bin of any group has: one of those that its group's bins had
        names_of = np.empty(where.max() + 1, np.int64)
        used = np.flatnonzero(np.bincount(where) > 0)
        names_of[used] = own[: len(used)]
        out = table.set_column(table.schema.get_field_index("sequence_id"), "sequence_id", pa.array(names_of[where], pa.int64()))
        return out.set_column(out.schema.get_field_index("offset"), "offset", pa.array(_laid_out(length, where), pa.int64())).select(columns)

    left = placed.where("still_open").groupBy(F.floor(F.col("part") / MERGED_PARTITIONS).alias("__group")).applyInArrow(again, placed.select(columns).schema)
    return placed.where("not still_open").select(columns).union(left)
