"""Collocations by Toivonen's sampling: frequent phrases from one full pass, with further passes only where the sample failed.

A quarter of the documents, dealt by a hash, is mined at a lowered support, one length
after another.  What it finds (S) goes to every task as a Bloom filter of bounded
size.  The full pass counts each phrase whose two parts without the last and the first
word are in S: those are S itself and its negative border, and all words.  Where a phrase
of the border (one not in S) turns out frequent, phrases over it haven't been counted:
a further pass counts just these, and so on until a pass finds no new frequent phrase
that longer ones could stand on.  The hashes tell the failures of the first border
before anything is spelt, so the pass that spells counts what stands on these, too.  A
false hit of a filter means that a phrase more is counted; every phrase is counted in
one pass, whole, so counts are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm import batches as B

LEAST, LONGEST, COVERED, TOP = 10, 3, 50, 2000
#: The sample: one document of so many; its support is `LOWERED` of the expected one.
SAMPLED, LOWERED = 4, 0.8
#: Bits for each phrase of a filter, and for a filter at most; a filter that is too full counts more phrases, it loses none.
BITS_EACH, MOST_BITS, SEGMENTS, PROBES = 12, 1 << 27, 64, 3
#: Bytes of text that a task counts at once.
CHUNK_BYTES = 3 << 20
#: Buckets of hashes, and chunks that a bucket's task merges at most before inner buckets are made.
BUCKETS, MERGED_CHUNKS = 128, 1024
#: The best of each language are found among the best of so many parts.
SALTS = (32, 2)
COUNTS = "lang string, m int, phrase string, n bigint"

_LETTERS = bytes(range(256))
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _LETTERS = _LETTERS[:_c] + b"\n" + _LETTERS[_c + 1 :]
_LETTERS = (_LETTERS[:9] + b" " + _LETTERS[10:]).replace(bytes(range(65, 91)), bytes(range(97, 123)))

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: The first so many bytes of eight; blocks of eight bytes of a word that are hashed for all words at once.
_MASKS, BLOCKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64), 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def _joined(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all its words but the last, and the last one's."""
    return _mixed(left * _A + word)


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _edges(x: pa.LargeBinaryArray) -> np.ndarray:
    """Where each value begins in the buffer of values, and the end."""
    return np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]


def _word_hashes(words: pa.LargeBinaryArray, seed: np.uint64 | np.ndarray) -> np.ndarray:
    """A hash of each word and the seed, or its own seed: by eight bytes at a time up to BLOCKS times, longer words one by one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    edge = _edges(words)
    first, size = edge[:-1] - edge[0], np.diff(edge)
    raw = bytes(memoryview(words.buffers()[2])[edge[0] : edge[-1]]) + bytes(8)
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    out = size.astype(np.uint64) + seed
    left = np.arange(len(words))
    for k in range(BLOCKS):
        out[left] = _joined(out[left], eight[first[left] + 8 * k] & _MASKS[np.minimum(size[left] - 8 * k, 8)])
        left = left[size[left] > 8 * (k + 1)]
    for i in left.tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[first[i] : first[i] + size[i]], int(out[i]))
    return _mixed(out)


class Filter:
    """A Bloom filter of SEGMENTS parts: a phrase's hash chooses the part and PROBES bits of it."""

    def __init__(self, parts: np.ndarray):
        self.parts = parts  # SEGMENTS x bytes

    @staticmethod
    def places(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
        return ((h & np.uint64(0xFFFFFFFF)) + np.uint64(probe) * (_mixed(h) | np.uint64(1))) % np.uint64(bits)

    def holds(self, h: np.ndarray) -> np.ndarray:
        left, out = np.arange(len(h)), np.zeros(len(h), bool)
        for k in range(PROBES):  # most of what isn't held fails the first probe
            at = self.places(h[left], 8 * self.parts.shape[1], k)
            hit = (self.parts[(h[left] >> np.uint64(58)).astype(np.int64), (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            left = left[hit]
        out[left] = True
        return out


#: filters[m]: for phrases of m words the sample's filter, and one for each pass after, or None where it found nothing new.
Filters = dict[int, list[Filter | None]]


def _codes(filters: Filters, m: int, h: np.ndarray) -> np.ndarray:
    """The first of the filters that holds each phrase, or -1."""
    out = np.full(len(h), -1, np.int64)
    left = np.arange(len(h))
    for k, f in enumerate(filters.get(m, [])):
        if f is not None and len(left):
            hit = f.holds(h[left])
            out[left[hit]] = k
            left = left[~hit]
    return out


def _phrase_hashes(phrases: pa.Array, langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    seeds = np.array([_seed(x) for x in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
    split = pc.split_pattern(phrases.cast(pa.binary()).cast(pa.large_binary()), " ")
    size = pc.list_value_length(split).to_numpy().astype(np.int64)
    word = _word_hashes(split.flatten(), np.repeat(seeds, size))
    first = np.cumsum(size) - size
    out, left = word[first], np.flatnonzero(size > 1)
    for k in range(1, int(size.max(initial=1))):
        out[left] = _joined(out[left], word[first[left] + k])
        left = left[size[left] > k + 1]
    return out


def _words(texts: list[bytes]) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """The number of each word in order, and the distinct words. Number 0 is the end of a piece."""
    text = b"\n" + b"\n".join(texts)
    raw, data = np.frombuffer(text.translate(_LETTERS), np.uint8), text.translate(_LETTERS, b" \t")
    end, gap = raw == 10, raw == 32
    begins = ~gap
    begins[1:] &= end[1:] | end[:-1] | gap[:-1]
    place = np.flatnonzero(begins)
    edge = np.append(place - np.cumsum(gap, dtype=np.uint32)[place], len(data))
    coded = _strings(edge, data).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _strings(edge: np.ndarray, data: bytes | np.ndarray) -> pa.LargeBinaryArray:
    """What lies in `data` between the edges."""
    return pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(data)])


def _spelt(names: pa.LargeBinaryArray, words: list[np.ndarray]) -> pa.LargeBinaryArray:
    """Phrases from the numbers of their first, second ... words."""
    own = [names.take(pa.array(w)) for w in words]
    return own[0] if len(own) == 1 else pc.binary_join_element_wise(*own, pa.scalar(b" ", pa.large_binary()))


def _count(texts: list[bytes], lang: str, filters: Filters, rounds: range, lengths: range) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Callable[[np.ndarray], pa.LargeBinaryArray]]]:
    """(round, m, hashes, counts, spell) of the distinct phrases of `lengths` words that these rounds count: all words in round 0, and else those of whose two parts the later one came by the round's filter. `spell` gives the phrases at some places."""
    ids, names = _words(texts)
    hashes = word_hash = _word_hashes(names, _seed(lang))
    if 1 in lengths and 0 in rounds:
        n = np.bincount(ids, minlength=len(names))
        n[0] = 0
        own = np.flatnonzero(n)
        yield 0, 1, word_hash[own], n[own], lambda at, own=own: _spelt(names, [own[at]])
    if lengths[-1] < 2:
        return
    code = _codes(filters, 1, word_hash)
    code[0] = -1
    # at[i]: which distinct phrase of m - 1 words begins at i, or -1; built: what each phrase of a length is made of
    at, built = ids, []

    def words_of(m: int, which: np.ndarray) -> list[np.ndarray]:
        if m == 1:
            return [which]
        first, end = built[m - 2]
        return [*words_of(m - 1, first[which]), end[which]]

    for k in rounds:
        if k:
            yield from _count_late(ids, names, word_hash, code, filters, k, lengths)
    for m in range(2, lengths[-1] + 1 if 0 in rounds else 2):
        left, right = at[:-1], at[1:]
        both = np.flatnonzero((left >= 0) & (right >= 0))
        both = both[(code[left[both]] == 0) & (code[right[both]] == 0)]
        key, inverse, n = np.unique(left[both] * len(names) + ids[both + m - 1], return_inverse=True, return_counts=True)
        first, end = key // len(names), key % len(names)
        hashes = _joined(hashes[first], word_hash[end])
        built.append((first, end))
        if m in lengths:
            yield 0, m, hashes, n, lambda at, m=m: _spelt(names, words_of(m, at))
        if m < lengths[-1]:
            code = _codes({m: filters[m][:1]}, m, hashes)
            at = np.full(max(0, len(ids) - m + 1), -1, np.int64)  # a language's texts may be shorter than the phrases
            at[both] = inverse


def _count_late(ids: np.ndarray, names: pa.LargeBinaryArray, word_hash: np.ndarray, word_code: np.ndarray, filters: Filters, round_: int, lengths: range) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Callable[[np.ndarray], pa.LargeBinaryArray]]]:
    """`_count` of later rounds, by places in the text: of m words, where one part of m - 1 words came by this round's filter and the other by this or an earlier one."""
    hashes, code = word_hash[ids], word_code[ids]  # of the m - 1 words from each place on
    for m in range(2, lengths[-1] + 1):
        late = (code[:-1] == round_) | (code[1:] == round_)
        own = np.flatnonzero(late & (code[:-1] >= 0) & (code[1:] >= 0))
        if m in lengths and len(own):
            key = ids[own]
            for j in range(1, m):
                _, first, key, n = np.unique(key * len(names) + ids[own + j], return_index=True, return_inverse=True, return_counts=True)
            begin = own[first]
            yield round_, m, _joined(hashes[begin], word_hash[ids[begin + m - 1]]), n, lambda at, m=m, begin=begin: _spelt(names, [ids[begin[at] + j] for j in range(m)])
        if m < lengths[-1]:
            inside, of_parts = (code[:-1] >= 0) & (code[1:] >= 0), np.maximum(code[:-1], code[1:])
            hashes, code = _joined(hashes[:-1], word_hash[ids[m - 1 :]]), np.full(len(inside), -1)
            places = np.flatnonzero(inside)
            if m == lengths[-1] - 1 and len(places):  # the last codes matter only where a phrase of this round begins, and beside it
                own_filter = filters[m][round_]
                late = of_parts == round_
                if own_filter is not None:
                    late[places] |= own_filter.holds(hashes[places])
                near = late.copy()
                near[1:] |= late[:-1]
                near[:-1] |= late[1:]
                places = np.flatnonzero(inside & near)
            found = _codes(filters, m, hashes[places])
            code[places] = np.where(found < 0, found, np.maximum(found, of_parts[places]))  # a false hit of an earlier filter makes no phrase older than its parts


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """About CHUNK_BYTES of texts by language, or one longer text."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, raw in zip(batch["lang"].to_pylist(), batch["raw"].to_pylist(), strict=True):
            held.setdefault(lang, []).append(raw)
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield held
                held, size = {}, 0
    if held:
        yield held


def _pack(phrases: pa.LargeBinaryArray, counts: np.ndarray, edges: np.ndarray) -> bytes:
    """Phrases with counts, in parts between the edges, as one value."""
    edge = _edges(phrases)
    head = [edges.astype(np.uint32), counts.astype(np.uint32), np.diff(edge).astype(np.uint32)]
    return b"".join([*(x.tobytes() for x in head), memoryview(phrases.buffers()[2])[edge[0] : edge[-1]] if edge[-1] > edge[0] else b""])


def _merge_packed(payloads: list[bytes], parts: int, part: int) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The distinct phrases of one part of such values, and their summed counts."""
    counts, sizes, data = [], [], []
    for p in payloads:
        edges = np.frombuffer(p, np.uint32, parts + 1).astype(np.int64)
        n, x, y = edges[-1], edges[part], edges[part + 1]
        size = np.frombuffer(p, np.uint32, n, 4 * (parts + 1 + n)).astype(np.int64)
        begin = 4 * (parts + 1 + 2 * n) + size[:x].sum()
        counts.append(np.frombuffer(p, np.uint32, n, 4 * (parts + 1))[x:y])
        sizes.append(size[x:y])
        data.append(memoryview(p)[begin : begin + size[x:y].sum()])
    coded = _strings(np.cumsum(np.concatenate([[0], *sizes])), b"".join(data)).dictionary_encode()
    total = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(total, coded.indices.to_numpy(), np.concatenate(counts).astype(np.int64))
    return coded.dictionary, total


def count_phrases(docs: DataFrame, filters: Filters, rounds: range, lengths: range, least: int, text_bytes: int, hot: Filter | None = None) -> DataFrame:
    """(lang, m, phrase, n), one row for each phrase that occurs `least` times or more; those of round 0 if `hot` holds them, and the number of words of each language as m = 0. `docs`: lang, raw (the text's UTF-8).

    Phrases are dealt packed, like the hashes of `frequent_hashes`, and become rows once they are counted.
    """
    shared = docs.sparkSession.sparkContext.broadcast((filters, hot))
    inner = -(-text_bytes // (CHUNK_BYTES * MERGED_CHUNKS))
    kind = "bucket int, inner int, lang string, payload binary"

    def rows(bucket: list[int], inside: list[int], lang: list[str], payload: list[bytes]) -> pa.Table:
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "inner": pa.array(inside, pa.int32()), "lang": pa.array(lang, pa.string()), "payload": pa.array(payload, pa.binary())})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, most = shared.value
        for held in _chunks(batches):
            group = None
            for lang, texts in held.items():
                found = []
                for k, m, hashes, n, spell in _count(texts, lang, known, rounds, lengths):
                    own = np.arange(len(n)) if k or most is None else np.flatnonzero(most.holds(hashes))
                    found.append((hashes[own], n[own], spell(own)))
                    if m == 1:  # the number of words, as an empty phrase
                        found.append((np.zeros(1, np.uint64), n.sum(keepdims=True), pa.array([b""], pa.large_binary())))
                if not any(len(n) for _, n, _ in found):
                    continue
                hashes = np.concatenate([h for h, _, _ in found])
                place = ((hashes % np.uint64(BUCKETS)) * np.uint64(inner) + hashes // np.uint64(BUCKETS) % np.uint64(inner)).astype(np.uint16 if BUCKETS * inner < 1 << 16 else np.int64)
                order = np.argsort(place, kind="stable")
                edge = np.searchsorted(place[order], np.arange(BUCKETS * inner + 1))
                counts, spelt = np.concatenate([n for _, n, _ in found])[order], pa.concat_arrays([x for _, _, x in found]).take(pa.array(order))
                group = zlib.crc32(hashes[:64].tobytes()) % inner if group is None else group
                filled = [b for b in range(BUCKETS) if edge[(b + 1) * inner] > edge[b * inner]]
                payload = [_pack(spelt[e[0] : e[-1]], counts[e[0] : e[-1]], e - e[0]) for e in (edge[b * inner : (b + 1) * inner + 1] for b in filled)]
                yield from rows(filled, [group] * len(filled), [lang] * len(filled), payload).to_batches()

    def by_lang(table: pa.Table) -> dict[str, list[bytes]]:
        out: dict[str, list[bytes]] = {}
        for lang, payload in zip(table["lang"].to_pylist(), table["payload"].to_pylist(), strict=True):
            out.setdefault(lang, []).append(payload)
        return out

    def merge(table: pa.Table) -> pa.Table:
        out = []
        for lang, payloads in by_lang(table).items():
            for part in range(inner):
                phrases, n = _merge_packed(payloads, inner, part)
                if len(n):
                    out.append((part, lang, _pack(phrases, n, np.array([0, len(n)]))))
        return rows([table["bucket"][0].as_py()] * len(out), *([x[k] for x in out] for k in range(3)))

    def frequent(table: pa.Table) -> pa.Table:
        out = []
        for lang, payloads in by_lang(table).items():
            phrases, n = _merge_packed(payloads, 1, 0)
            own = np.flatnonzero((n >= least) | (pc.binary_length(phrases).to_numpy() == 0))
            spelt = phrases.take(pa.array(own))
            m = np.where(pc.binary_length(spelt).to_numpy() > 0, pc.count_substring(spelt, b" ").to_numpy() + 1, 0)
            out.append(pa.table({"lang": pa.array([lang] * len(own), pa.string()), "m": pa.array(m, pa.int32()), "phrase": spelt.cast(pa.large_string()).cast(pa.string()), "n": pa.array(n[own], pa.int64())}))
        return pa.concat_tables(out)

    dealt = docs.mapInArrow(deal, kind)
    if inner > 1:
        dealt = dealt.groupBy("bucket", "inner").applyInArrow(merge, kind)
    return dealt.groupBy("bucket", "inner").applyInArrow(frequent, COUNTS)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, begin = B.grouped(keys)
    return keys[order][begin], np.minimum(np.add.reduceat(counts[order].astype(np.int64), begin), 255) if len(begin) else counts


def frequent_hashes(docs: DataFrame, filters: Filters, lengths: range, least: int, text_bytes: int) -> Filter | None:
    """A filter of the phrases of round 0 whose hashes occur `least` times or more: those that are frequent, and few others.

    Tasks count hashes for each chunk and deal them, packed, to BUCKETS buckets; so
    the many phrases that are rare never become rows of text.  Where buckets would
    grow beyond a task, groups of chunks are merged and dealt to inner buckets.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    inner = -(-text_bytes // (CHUNK_BYTES * MERGED_CHUNKS))
    kind, buckets = "bucket int, inner int, payload binary", np.uint64(BUCKETS)

    def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
        return keys.tobytes() + counts.astype(np.uint8).tobytes()

    def summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        rows = table["payload"].to_pylist()
        sizes = [len(r) // 9 for r in rows]
        keys = np.concatenate([np.frombuffer(r, np.uint64, n) for r, n in zip(rows, sizes, strict=True)])
        return _summed(keys, np.concatenate([np.frombuffer(r, np.uint8, n, 8 * n) for r, n in zip(rows, sizes, strict=True)]))

    def rows(bucket: list[int], inside: list[int], payload: list[bytes]) -> pa.Table:
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "inner": pa.array(inside, pa.int32()), "payload": pa.array(payload, pa.binary())})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, held in enumerate(_chunks(batches)):
            found = [(h, n) for lang, texts in held.items() for _, _, h, n, _ in _count(texts, lang, shared.value, range(1), lengths)]
            keys, counts = np.concatenate([h for h, _ in found]), np.minimum(np.concatenate([n for _, n in found]), 255)
            own = (keys % buckets).astype(np.uint8)  # sorted by counting
            order = np.argsort(own, kind="stable")
            keys, counts = keys[order], counts[order]
            edge = np.searchsorted(own[order], np.arange(BUCKETS + 1)).tolist()
            filled = [b for b in range(BUCKETS) if edge[b + 1] > edge[b]]
            group = zlib.crc32(keys[:64].tobytes()) % inner
            yield from rows(filled, [group] * len(filled), [packed(keys[edge[b] : edge[b + 1]], counts[edge[b] : edge[b + 1]]) for b in filled]).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = summed(table)
        part = keys // buckets % np.uint64(inner)
        own = [np.flatnonzero(part == i) for i in np.unique(part)]
        return rows([table["bucket"][0].as_py()] * len(own), np.unique(part).tolist(), [packed(keys[i], counts[i]) for i in own])

    def frequent(table: pa.Table) -> pa.Table:
        keys, counts = summed(table)
        keys = keys[counts >= min(least, 255)]
        return pa.table({"h": pa.array(keys.view(np.int64), pa.int64())})

    dealt = docs.mapInArrow(deal, kind)
    if inner > 1:
        dealt = dealt.groupBy("bucket", "inner").applyInArrow(merge, kind)
    return _build(B.checkpoint(dealt.groupBy("bucket", "inner").applyInArrow(frequent, "h bigint")))


def _build(phrases: DataFrame) -> Filter | None:
    """A filter of the phrases (lang, phrase) or hashes (h), whose parts are made by as many tasks; its size is bounded by MOST_BITS."""
    n = phrases.count()
    if not n:
        return None
    bits = 8 * max(8, min(MOST_BITS, n * BITS_EACH) // SEGMENTS // 8)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch["h"].to_numpy().view(np.uint64) if "h" in batch.schema.names else _phrase_hashes(batch["phrase"], batch["lang"])
            segment = (h >> np.uint64(58)).astype(np.int32)
            at = np.stack([Filter.places(h, bits, k) for k in range(PROBES)]).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            edge = np.searchsorted(segment[order], np.arange(SEGMENTS + 1))
            for s in range(SEGMENTS):
                if edge[s + 1] > edge[s]:
                    own = np.zeros(bits, bool)
                    own[at[:, order[edge[s] : edge[s + 1]]].ravel()] = True
                    yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "part": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    def merged(table: pa.Table) -> pa.Table:
        part = np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in table["part"].to_pylist()])
        return pa.table({"segment": table["segment"].slice(0, 1), "part": pa.array([part.tobytes()], pa.binary())})

    kind = "segment int, part binary"
    parts = np.zeros((SEGMENTS, bits // 8), np.uint8)
    for row in phrases.select("h" if "h" in phrases.columns else F.struct("lang", "phrase").alias("p")).select("h" if "h" in phrases.columns else "p.*").mapInArrow(hashed, kind).groupBy("segment").applyInArrow(merged, kind).collect():
        parts[row.segment] = np.frombuffer(row.part, np.uint8)
    return Filter(parts)


def _unknown(phrases: DataFrame, filters: Filters, longest: int) -> DataFrame:
    """The phrases of less than `longest` words that no filter holds: on these longer ones couldn't be counted yet."""
    shared = phrases.sparkSession.sparkContext.broadcast(filters)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, m = _phrase_hashes(batch["phrase"], batch["lang"]), batch["m"].to_numpy()
            out = np.ones(len(h), bool)
            for k in np.unique(m).tolist():
                out[m == k] = _codes(shared.value, k, h[m == k]) < 0
            yield batch.filter(pa.array(out))

    return phrases.where(F.col("m") < longest).mapInArrow(left, phrases.schema)


def frequent_phrases(docs: DataFrame, folder: str, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, sampled: int = SAMPLED) -> tuple[DataFrame, DataFrame, list[int]]:
    """All phrases of at most `longest` words that occur `least` times or more in their language: (lang, m, phrase, n); the number of words of each language; and how many phrases each pass found unknown to the sample.

    A null text is empty, a null language is `und`.  Tables are written to `folder`.
    """
    plain, (lang, text) = B.numbered(docs, lang_col, text_col)
    dealt = [F.col(c) for c, kind in plain.dtypes if kind in ("bigint", "int", "string")]
    plain = plain.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"), (F.pmod(F.xxhash64(*dealt), F.lit(sampled)) == 0).alias("in_sample"))
    text_bytes = plain.agg(F.sum(F.octet_length("raw"))).first()[0] or 1
    sample = plain.where("in_sample").select("lang", "raw")
    plain = plain.select("lang", "raw")
    lowered = least if sampled == 1 else max(1, int(LOWERED * least / sampled))
    filters: Filters = {m: [] for m in range(1, longest)}
    for m in range(1, longest):
        filters[m] = [frequent_hashes(sample, filters, range(m, m + 1), lowered, text_bytes)]
    hot = frequent_hashes(plain, filters, range(1, longest + 1), least, text_bytes)
    sample_only = {m: list(f) for m, f in filters.items()}
    for known in filters.values():  # what is frequent and not in S is in this one: the pass that spells the hot phrases counts what stands on it, too
        known.append(hot)
    counted = B.checkpoint(count_phrases(plain, filters, range(2), range(1, longest + 1), least, text_bytes, hot), folder)
    words = counted.where("m = 0").select("lang", F.col("n").alias("words"))
    tables, round_ = [counted.where("m > 0")], 2
    failed = [_unknown(tables[0], sample_only, longest).count()]
    while failed[-1]:
        new = B.checkpoint(_unknown(tables[-1], filters, longest), folder)
        fresh = {m: _build(new.where(F.col("m") == m)) for m in range(1, longest)}
        failed.append(new.count())
        if failed[-1]:
            for m, f in fresh.items():
                filters[m].append(f)
            tables.append(B.checkpoint(count_phrases(plain, filters, range(round_, round_ + 1), range(1, longest + 1), least, text_bytes), folder))
            round_ += 1
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out, words, failed


def _part(begin: Column, length: Column) -> Column:
    return F.array_join(F.slice("w", begin, length), " ")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP, sampled: int = SAMPLED) -> DataFrame:
    """The `top` phrases of each language by their weakest cut: lang, rank, phrase, a, l, r, n, score.

    Letters A-Z are lowered, texts are cut at `.,;:!?` and line ends; phrases have two
    words or more and `least` occurrences.  Left out are phrases in a longer frequent
    one that has at least `covered` percent of their occurrences.  Equal scores go by
    occurrences, then by the phrase's bytes.  A null text is empty, a null language is
    `und`; repeated rows count each; ids may be null; other columns don't matter; a
    very long text is counted whole, in one piece; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = B.shared_folder(spark, "phrases")
    found, words, _ = frequent_phrases(docs, folder, lang_col, text_col, least, longest, sampled)
    known = found.select("lang", "phrase", "n")
    rows = found.where("m > 1").select("lang", "m", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    inner = rows.where("m > 2").select("lang", "m", "a", "w", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("k"))
    inner = inner.select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("k") + 1)).alias("i"))
    longer = inner.select("lang", "a", _part(F.col("i"), F.col("k")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    cut = rows.join(longer, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * covered))
    cut = cut.select("lang", "m", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("m") - F.col("k")).alias("tail"))
    for side, name in (("head", "l"), ("tail", "r")):
        cut = cut.join(known.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])  # `known` has each key once; Spark splits what is skewed
    wide = "decimal(19,0)"
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * (cast(a as {wide}) * cast(a as {wide}))) div (cast(l as {wide}) * cast(r as {wide}))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    best = best.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for salts in SALTS:
        best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
    done = B.checkpoint(out)
    B.remove_folder(spark, folder)
    return done
