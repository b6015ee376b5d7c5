"""Removal of passages that an earlier document has, by fixed-block anchors.

Every document is a reference: its words are cut into non-overlapping blocks of
`block` words, which are indexed by their hash.  Every rolling window of `block`
words of every document probes the index.  `window` words (13) always hold a whole
block of 7 of the reference, whatever the block's offset, so no shared window is missed.

An anchor is a rolling window that hits a block of another document which may come
earlier, or a document's own block that another document probes which may come later
(the order of ids is known to the index in 63 steps).  Anchors are extended, word by
word, while the rolling windows that follow are shared too, to runs of at least
`window` words: the candidates of maximal exact repeats.  Windows without an anchor
are out.  The windows in these runs are then settled by 96-bit digests of all their
words: each gets the smallest doc_id that holds it, and a document loses the words of
windows which a smaller doc_id holds.

Hits never become pairs of documents: buckets answer with one code for each key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import batches as B
from lectern.llm.words import Words, any_of, words

BLOCK, WINDOW = 7, 13
OUTPUT = {"n_words": T.LongType(), "n_removed": T.LongType(), "removed": T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])), "kept_text": T.StringType()}
STATE = -1
DIGEST = np.dtype([("one", "<u8"), ("low", "<u4")])


def _ids(table: pa.Table, key: str) -> np.ndarray:
    """Documents without an id stand outside: they neither lose words nor cost others any."""
    return np.array([np.iinfo(np.int64).max if x is None else x for x in B.column(table, key)], np.int64)


#: A key's value: whether a block has it, whether several documents have it, whether blocks of several have it, whether several
#: documents are at its last step; then its last step, and the first step of its blocks (63: none).
BLOCK_BIT, SEVERAL, BLOCKS, LAST_TWICE, NO_BLOCK = 1, 2, 4, 8, 63
#: Answers: shared, hits another document's block, own block that another document probes.
SHARED, HIT, PROBED = 1, 2, 4


def _value(flags: np.ndarray, last: np.ndarray, first_block: np.ndarray) -> np.ndarray:
    return (flags | last << 4 | first_block << 10).astype(np.uint16)


def _any(flag: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(flag.astype(np.int64), begin)


def _merged(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The value of the documents of several entries together."""
    if not len(values):
        return values
    v, count = values.astype(np.int64), B.repeats(begin, len(values))
    step = v >> 4 & 63
    last = np.maximum.reduceat(step, begin)
    at_last = step == np.repeat(last, count)
    twice = (np.add.reduceat(at_last.astype(np.int64), begin) > 1) | (_any(at_last & (v & LAST_TWICE > 0), begin) > 0)
    n_blocks = np.add.reduceat(v & BLOCK_BIT, begin)
    blocks = (n_blocks > 1) | (_any(v & BLOCKS > 0, begin) > 0)
    several = (count > 1) | (_any(v & SEVERAL > 0, begin) > 0)
    return _value((n_blocks > 0) * BLOCK_BIT | several * SEVERAL | blocks * BLOCKS | twice * LAST_TWICE, last, np.minimum.reduceat(v >> 10, begin))


def _answer(own: np.ndarray, total: np.ndarray) -> np.ndarray:
    own, total = own.astype(np.int64), total.astype(np.int64)
    shared, block = total & SEVERAL > 0, own & BLOCK_BIT > 0
    others = np.where(block & (own & SEVERAL == 0), total & BLOCKS > 0, total & BLOCK_BIT > 0)  # a batch's one document is no anchor for itself
    hit = shared & others & (total >> 10 <= (own >> 4 & 63))
    last = total >> 4 & 63
    probed = shared & block & ((last > own >> 10) | (last == own >> 10) & (total & LAST_TWICE > 0))
    return (shared * SHARED | hit * HIT | probed * PROBED).astype(np.uint8)


def _values(inverse: np.ndarray, doc: np.ndarray, step: np.ndarray, aligned: np.ndarray) -> np.ndarray:
    """Each distinct key's value, from all its places: the document, its step and whether it is a block there. Documents ascend."""
    order, begin = B.grouped(inverse, stable=True)
    if not len(order):
        return np.empty(0, np.uint16)
    doc, step, aligned = doc[order], step[order], aligned[order]
    count = B.repeats(begin, len(order))
    new = np.ones(len(order), bool)
    new[1:] = doc[1:] != doc[:-1]
    new[begin] = True
    last = np.maximum.reduceat(step, begin)
    twice = np.add.reduceat((new & (step == np.repeat(last, count))).astype(np.int64), begin) > 1
    none = np.iinfo(np.int64).max
    low, high = np.minimum.reduceat(np.where(aligned, doc, none), begin), np.maximum.reduceat(np.where(aligned, doc, -1), begin)
    several = np.add.reduceat(new.astype(np.int64), begin) > 1
    first_block = np.minimum.reduceat(np.where(aligned, step, NO_BLOCK), begin)
    return _value((high >= 0) * BLOCK_BIT | several * SEVERAL | (high > low) * BLOCKS | twice * LAST_TWICE, last, first_block)


def _candidates(found: Words, at: np.ndarray, n_buckets: int, window: int):
    """Distinct digests of the windows that begin at `at`: bucket edges, the digests, and each window's place among them."""
    one, two = found.windows(window)[at], found.windows(window, salt=24)[at]
    bucket = (two >> np.uint64(32)) % np.uint64(n_buckets)
    low = two & np.uint64(0xFFFFFFFF)
    order = np.lexsort((low, one, bucket))
    b, o, w = bucket[order], one[order], low[order]
    new = np.concatenate([[True], (b[1:] != b[:-1]) | (o[1:] != o[:-1]) | (w[1:] != w[:-1])]) if len(at) else np.empty(0, bool)
    inverse = np.empty(len(at), np.int64)
    inverse[order] = np.cumsum(new) - 1
    edges = np.searchsorted(b[new], np.arange(n_buckets + 1, dtype=np.uint64))
    digests = np.empty(int(new.sum()), DIGEST)
    digests["one"], digests["low"] = o[new], w[new]
    return edges, digests, inverse


def _least(values: np.ndarray, inverse: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, inverse, values)
    return out


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row for each row of `docs`: its columns, and n_words, n_removed, removed (spans of word indexes), kept_text.

    Words are maximal runs of anything but ASCII white space, unchanged.  A null or
    blank text has no words and an empty kept_text.  Rows with a null id lose
    nothing.  Equal texts under the same id don't cost each other words; equal texts
    under different ids leave them to the smallest.  Texts are read whole, whatever
    their length.  Columns of `docs` that have the name of a new column are replaced;
    any other name is free.  An empty table gives an empty table.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block at any offset: window >= 2 * block - 1")
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in OUTPUT])
    plain, (key, text) = B.numbered(docs, id_col, text_col)
    kept_fields = list(plain.schema.fields)
    batched, n = B.in_batches(plain, text, key)
    ends = plain.agg(F.min(F.col(key).cast("double")).alias("low"), F.max(F.col(key).cast("double")).alias("high")).first()
    low_id, spread = ends["low"] or 0.0, (ends["high"] or 0.0) - (ends["low"] or 0.0) + 1.0
    anchors = B.Exchange(n, np.dtype(np.uint16), _merged, _answer)
    least_ids = B.Exchange(n, np.dtype(np.int64), lambda v, begin: np.minimum.reduceat(v, begin) if len(v) else v, lambda own, total: total < own, DIGEST)
    nowhere = np.iinfo(np.int64).max

    def ordered(table: pa.Table) -> pa.Table:
        """A shuffle may hand over a batch's rows in another order each time; the runs are kept by place."""
        return table.sort_by([(key, "ascending"), (text, "ascending")])

    def probes(table: pa.Table):
        """The words, the ids, the places of the rolling windows, and each one's place among the batch's distinct keys."""
        ids, found = _ids(table, key), words(B.column(table, text))
        at = np.flatnonzero((found.left() >= block) & (ids < nowhere)[found.doc])
        return (ids, found, at, *anchors.split(found.windows(block)[at]))

    def index_and_probe(batch: int, table: pa.Table) -> pa.Table:
        ids, found, at, keys, inverse, edges = probes(ordered(table))
        step = np.clip((ids.astype(np.float64) - low_id) / spread * 63, 0, 62).astype(np.int64)
        doc = found.doc[at]
        return anchors.pack(batch, keys, _values(inverse, doc, step[doc], found.place()[at] % block == 0), edges)

    def extend(batch: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, found, at, _, inverse, _ = probes(ordered(table))
        code = np.zeros(len(found.hash), np.uint8)
        answer = [B.inflate(x, np.uint8) for x in B.column(answers, B.PAYLOAD)]
        if answer:
            code[at] = np.concatenate(answer)[inverse]
        anchor = (code & HIT > 0) | (code & PROBED > 0) & (found.place() % block == 0)
        span = window - block + 1
        run = (any_of(code & SHARED > 0, span) == span) & (any_of(anchor, span) > 0) & (found.left() >= window)
        where = np.flatnonzero(run)
        edges, digests, inverse = _candidates(found, where, least_ids.buckets, window)
        least = _least(ids[found.doc[where]], inverse, len(digests))
        return pa.concat_tables([least_ids.pack(batch, digests, least, edges), B.packed_rows(batch, {STATE - batch % least_ids.buckets: B.deflate(np.packbits(run))})])

    def remove(_, table: pa.Table, answers: pa.Table) -> pa.Table:
        table = ordered(table)
        ids = _ids(table, key)
        found = words(B.column(table, text))
        payloads = B.column(answers, B.PAYLOAD)  # the runs come first
        run = np.unpackbits(B.inflate(payloads[0], np.uint8), count=len(found.hash)).astype(bool)
        where = np.flatnonzero(run)
        _, digests, inverse = _candidates(found, where, least_ids.buckets, window)
        least = _least(ids[found.doc[where]], inverse, len(digests))
        answer = [B.inflate(v, np.uint8) for v in payloads[1:]]
        earlier = np.concatenate(answer).astype(bool) if answer else np.empty(0, bool)
        where = where[earlier[inverse] | (least[inverse] < ids[found.doc[where]])]
        change = np.zeros(len(found.hash) + 1, np.int64)
        np.add.at(change, where, 1)
        np.add.at(change, where + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        removed_before = np.concatenate([[0], np.cumsum(gone)])
        n_removed = removed_before[found.first[1:]] - removed_before[found.first[:-1]]
        data, start, end = found.data, found.start, found.end
        texts, spans = [], []
        for d in range(table.num_rows):
            x, y = int(found.first[d]), int(found.first[d + 1])
            if n_removed[d]:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[x:y].astype(np.int8), [0]])))
                spans.append([{"begin": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                keep = np.flatnonzero(~gone[x:y]) + x
                texts.append(b" ".join([data[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist(), strict=True)]))
            else:
                spans.append([])
                texts.append(b" ".join(data[int(start[x]) : int(end[y - 1])].split()) if y > x else b"")
        new = {"n_words": np.diff(found.first), "n_removed": n_removed, "removed": spans, "kept_text": [t.decode("utf-8", "surrogatepass") for t in texts]}
        out = table.select([f.name for f in kept_fields])
        for name, kind in (("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())):
            out = out.append_column(name, pa.array(new[name], kind))
        return out

    answered = anchors.answers(B.by_batch(batched, index_and_probe))
    settled = least_ids.answers(B.with_answers(batched, answered, extend, B.PACKED))
    out = B.with_answers(batched, settled, remove, T.StructType([*kept_fields, *(T.StructField(k, v) for k, v in OUTPUT.items())]))
    return out.toDF(*docs.columns, *OUTPUT)
