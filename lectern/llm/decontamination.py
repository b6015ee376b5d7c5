"""Benchmark decontamination by pigeonhole edit matching over words.

An item of n words may differ from a passage by k = floor(max_errors * n) inserted,
dropped or changed words.  It is cut into k + 1 pieces, so that one of them stays
unchanged in any such passage: exact hits of pieces are candidates, and Myers'
bit-parallel algorithm gives the least distance between the whole item and any passage
around a hit.  Words are lower-cased runs of
letters and digits; in scripts without spaces each letter is a word.

The items are a stated query set: they are taken in blocks of bounded size, each of
which is sent to all tasks and held against all documents where these lie:
one scan of the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.words import NOT_ALNUM, spaced, words

#: Items of fewer words than STAGE_WORDS are phrases of everyday speech; `drop_contaminated` leaves documents that hold one.
MAX_ERRORS, MIN_WORDS, STAGE_WORDS = 0.1, 1, 5
#: Of items sent to every task at once.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
_BITS = 22
_BATCH_BYTES = 2 << 20


def least_distance(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of `item` to any part of `text`, and where the first such part ends (Myers, 1999)."""
    n = len(item)
    place: dict[int, int] = {}
    for i, w in enumerate(item):
        place[w] = place.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    positive, negative, score, best, end = full, 0, n, n, 0
    for j, w in enumerate(text):
        equal = place.get(w, 0)
        vertical = equal | negative
        horizontal = (((equal & positive) + positive) ^ positive) | equal
        plus = negative | (full & ~(horizontal | positive))
        minus = positive & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        positive = minus | (full & ~(vertical | plus))
        negative = plus & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """The pieces of a block of items, by length."""

    def __init__(self, rows: list[tuple[int, str]], max_errors: float, min_words: int):
        self.ids = [r[0] for r in rows]
        found = words([spaced((r[1] or "").lower()) for r in rows], NOT_ALNUM)
        self.words, self.errors, self.pieces = [], [], {}
        longest = 0
        for i in range(len(rows)):
            x, y = int(found.first[i]), int(found.first[i + 1])
            n, own = y - x, found.hash[x:y]
            errors = int(max_errors * n + 1e-9)
            self.words.append(own.tolist())
            self.errors.append(errors)
            if n < min_words:
                continue
            for p in range(errors + 1):
                a, b = p * n // (errors + 1), (p + 1) * n // (errors + 1)
                self.pieces.setdefault(b - a, []).append((x + a, i, a))
                longest = max(longest, b - a)
        self.by_hash: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.filter: dict[int, np.ndarray] = {}
        for size, pieces in self.pieces.items():
            hashes = _windows(found, size)
            table: dict[int, list[tuple[int, int]]] = {}
            for at, i, a in pieces:
                table.setdefault(int(hashes[at]), []).append((i, a))
            keys = np.array(list(table), np.uint64)
            self.by_hash[size] = table
            self.filter[size] = np.zeros(1 << _BITS, bool)
            self.filter[size][keys >> np.uint64(64 - _BITS)] = True

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text, item, errors, word after the passage) of each text and item that match, at its first best place."""
        found = words([spaced((t or "").lower()) for t in texts], NOT_ALNUM)
        left, hits = found.left(), {}
        for size, table in self.by_hash.items():
            hashes = _windows(found, size)
            at = np.flatnonzero(self.filter[size][hashes >> np.uint64(64 - _BITS)] & (left >= size))
            for p, h in zip(at.tolist(), hashes[at].tolist(), strict=True):
                for item, a in table.get(h, ()):
                    hits.setdefault((int(found.doc[p]), item), set()).add(p - a)
        out = []
        for (d, item), starts in sorted(hits.items()):
            own, k = self.words[item], self.errors[item]
            x, y = int(found.first[d]), int(found.first[d + 1])
            best, until = (k + 1, 0), -1
            low = None
            for s in [*sorted(starts), None]:  # overlapping places are searched at once
                if low is not None and (s is None or s - k > until):
                    e, end = least_distance(own, found.hash[low:until].tolist())
                    best = min(best, (e, low - x + end))
                    low = None
                if s is not None:
                    low = max(x, s - k) if low is None else low
                    until = min(y, max(until, s + len(own) + k))
            if best[0] <= k:
                out.append((d, item, *best))
        return out


def _windows(found, size: int) -> np.ndarray:
    """Hashes of `size` words; sizes beyond the table of multipliers are built from two halves."""
    if size <= 32:
        return found.windows(size, salt=1)
    from lectern.llm.words import mix

    half = _windows(found, size // 2)
    rest = _windows(found, size - size // 2)
    out = np.zeros_like(half)
    n = max(0, len(half) - size // 2)
    out[:n] = mix(half[:n] * np.uint64(3) + rest[size // 2 : size // 2 + n])
    return out


_built: list = [None, None]


def _items(sent: Broadcast, max_errors: float, min_words: int) -> Items:
    """Built once a worker for each block."""
    if _built[0] is not sent.value:
        _built[:] = sent.value, Items(sent.value, max_errors, min_words)
    return _built[1]


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Broadcast]:
    """The items in blocks of at most about BLOCK_ITEMS rows and BLOCK_BYTES bytes."""
    items = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n = -(-total["n"] // BLOCK_ITEMS) + (total["b"] or 0) // BLOCK_BYTES
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        rows = sorted(((r["id"], r["text"]) for r in block.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            yield items.sparkSession.sparkContext.broadcast(rows)


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    low, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > _BATCH_BYTES:
            yield low, i + 1
            low, size = i + 1, 0
    yield low, len(texts)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_errors: float = MAX_ERRORS, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each document and item that match: id, item id, n_errors (least distance in words), end_word (the word after the passage).

    Items with a null text or without a word match nothing, those of fewer than ten
    words match exactly or not at all; a null or empty document matches nothing.  Rows
    and items with a null id are taken like any other; repeated rows or items give
    repeated results.  Whole texts of any length are searched.  Other columns are left
    out, whatever their names.  Without documents or without items there is no row.
    """
    schema = f"`{id_col}` bigint, `{item_id}` bigint, n_errors int, end_word bigint"
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for sent in blocks(items, item_id, item_text):

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts, block = batch["__id"].to_pylist(), batch["__text"].to_pylist(), _items(sent, max_errors, min_words)
                rows = [(ids[low + d], block.ids[i], e, end) for low, high in _parts(texts) for d, i, e, end in block.matches(texts[low:high])]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(columns)], names=[id_col, item_id, "n_errors", "end_word"])

        out = out.union(source.mapInArrow(find, schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_errors: float = MAX_ERRORS, min_words: int = STAGE_WORDS) -> DataFrame:
    """The rows of `docs` that match no item of at least `min_words` words, with all their columns, whatever their names.

    Rows with null ids, null or empty texts stay, and so do repeated rows that match
    nothing.  Without items all rows stay; an empty table gives an empty table.
    """
    for sent in blocks(items, item_id, item_text):

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, block = batch[text_col].to_pylist(), _items(sent, max_errors, min_words)
                flag = np.ones(len(texts), bool)
                for low, high in _parts(texts):
                    flag[[low + m[0] for m in block.matches(texts[low:high])]] = False
                yield batch.filter(pa.array(flag))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
