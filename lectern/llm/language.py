"""Language identification by a linear-chain conditional random field over words.

Each word's score for each language is a sum of learned weights: of its byte n-grams,
of its affixes (n-grams that hold the word's beginning or end) and of its membership
in lexicons; learned transitions tie neighbouring words.  Forward-backward gives every
word's probabilities, also where a text changes its language; a document's language is
the one with the largest share.

The field is fitted on the driver, on a bounded sample: about `per_language` documents
of each of the `max_languages` most frequent languages, and at most `chars` characters
of each of them.  Chains of `chain_words` words are joined from pieces of several
documents, one for each two of the sample, so that transitions are seen.  A step of the
fit takes as many chains as make up `_CELLS` words times languages: all of them for few
languages; for many, each chain is taken once at least.  Prediction reads every text
whole, and long ones by sections, so that memory depends neither on a text's length nor
on the square of the number of languages for each of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.words import NOT_ALNUM, Words, words

UNKNOWN = "und"
PER_LANGUAGE, MAX_LANGUAGES, CHARS, CHAIN_WORDS = 1200, 100, 4000, 100
SIZES, DIMENSIONS = (2, 3, 4), 1 << 16
BLOCK = 64
_BATCH_BYTES, _CELLS, _WORDS = 1 << 20, 1 << 20, 50_000
_WORD_SIGN = re.compile(r"[^\W\d_]")
SEGMENTS = "array<struct<begin: bigint, end: bigint, lang: string>>"


def has_letter(text: str | None) -> bool:
    """Fractions, superscripts and the like are signs of words to `re`, but no letters."""
    found = _WORD_SIGN.search(text or "")
    return found is not None and (found[0].isalpha() or any(c.isalpha() for c in text))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # of hashed n-grams and affixes, by language
    lexicon: np.ndarray  # sorted word hashes
    lexicon_language: np.ndarray
    lexicon_weights: np.ndarray  # of membership, by language of the lexicon and language
    transitions: np.ndarray


def n_grams(found: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the marked words `which`, and where each word's begin. The marks make affixes of those at the edges."""
    data, start, end = found.data, found.start[which].tolist(), found.end[which].tolist()
    joined = b"".join([b"\x02" + data[a:b] + b"\x03" for a, b in zip(start, end, strict=True)])
    buffer = np.frombuffer(joined, np.uint8).astype(np.uint32)
    length = found.end[which] - found.start[which] + 2
    first = np.cumsum(length) - length
    ends = np.repeat(first + length, length)
    at = np.arange(len(buffer))
    value, ids, owner = np.zeros(len(buffer), np.uint32), [], []
    rank = np.repeat(np.arange(len(which)), length)
    for k in range(max(SIZES)):
        fits = at + k < ends
        value = np.where(fits, value * np.uint32(257) + buffer[np.minimum(at + k, max(len(buffer) - 1, 0))], value)
        if k + 1 in SIZES:
            ids.append(((value[fits] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % DIMENSIONS)
            owner.append(rank[fits])
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(len(which)))


def letters(found: Words, which: np.ndarray) -> np.ndarray:
    """Whether a word holds anything but digits."""
    data = found.data
    return np.array([not data[a:b].isdigit() for a, b in zip(found.start[which].tolist(), found.end[which].tolist(), strict=True)], bool)


def lexicon_of(hashes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Each word's place in the lexicon, or -1."""
    if not len(lexicon):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where(lexicon[at] == hashes, at, -1)


def emissions(model: Model, found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all words by language, and whether they have letters; each distinct word is scored once."""
    _, which, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
    if not len(which):
        return np.zeros((0, len(model.languages)), np.float32), np.zeros(0, bool)
    ids, first = n_grams(found, which)
    score = np.add.reduceat(model.weights[ids], first, axis=0)
    known = lexicon_of(found.hash[which], model.lexicon)
    score[known >= 0] += model.lexicon_weights[model.lexicon_language[known[known >= 0]]]
    has = letters(found, which)
    score[~has] = 0
    return score[inverse].astype(np.float32), has[inverse]


def messages(score: np.ndarray, first: np.ndarray, transitions: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: each word's probabilities. Texts begin at `first` (its last entry is the number of words).

    A text may be a section of a longer one: `before` and `after` are the messages that
    come in at its ends; those that go out, of each text's last and to its first word, are returned too.
    Exact for texts of any length: texts are cut into blocks whose transfer matrices
    are formed side by side; these carry both messages from block to block, and then
    all blocks are filled at once.
    """
    k = score.shape[1]
    if not len(score):
        return score, np.ones((len(first) - 1, k), np.float32), np.ones((len(first) - 1, k), np.float32)
    step = np.exp(transitions - transitions.max()).astype(np.float32)
    x = np.maximum(np.exp(score - score.max(axis=1, keepdims=True)), 1e-6).astype(np.float32)
    length = np.diff(first)
    n_blocks = -(-length // BLOCK)
    edge = np.concatenate([[0], np.cumsum(n_blocks)])
    total = edge[-1]
    doc = np.repeat(np.arange(len(length)), n_blocks)
    begin = first[doc] + (np.arange(total) - edge[doc]) * BLOCK
    place = begin[:, None] + np.arange(BLOCK)
    valid = place < first[doc + 1][:, None]
    x = x[np.minimum(place, len(score) - 1)]
    x[~valid] = 1

    def scaled(a: np.ndarray, axes) -> np.ndarray:
        return a / a.max(axis=axes, keepdims=True)

    transfer = np.tile(np.eye(k, dtype=np.float32), (total, 1, 1))
    for t in range(BLOCK):
        moved = scaled((transfer @ step) * x[:, t, None, :], (1, 2))
        transfer = np.where(valid[:, t, None, None], moved, transfer)
    alpha_in, beta_out = np.ones((total, k), np.float32), np.ones((total, k), np.float32)
    filled = n_blocks > 0
    head, tail = edge[:-1][filled], edge[1:][filled] - 1
    alpha_in[head] = 1 if before is None else before
    beta_out[tail] = 1 if after is None else after
    rounds = int(n_blocks.max())
    for r in range(1, rounds):
        b = edge[:-1][n_blocks > r] + r
        alpha_in[b] = scaled(np.einsum("bi,bij->bj", alpha_in[b - 1], transfer[b - 1]), 1)
        e = edge[1:][n_blocks > r] - 1 - r
        beta_out[e] = scaled(np.einsum("bij,bj->bi", transfer[e + 1], beta_out[e + 1]), 1)
    alpha, a = np.empty_like(x), alpha_in
    for t in range(BLOCK):
        a = scaled((a @ step) * x[:, t], 1)
        alpha[:, t] = a
    b = beta_out
    for t in range(BLOCK - 1, -1, -1):
        alpha[:, t] *= b
        b = np.where(valid[:, t, None], scaled((x[:, t] * b) @ step.T, 1), b)
    out = alpha[valid]
    ends, begins = np.ones((len(length), k), np.float32), np.ones((len(length), k), np.float32)
    ends[filled] = scaled(np.einsum("bi,bij->bj", alpha_in[tail], transfer[tail]), 1)
    begins[filled] = scaled(np.einsum("bij,bj->bi", transfer[head], beta_out[head]), 1)
    return out / out.sum(axis=1, keepdims=True), ends, begins


def marginals(score: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Each word's probabilities."""
    return messages(score, first, transitions)[0]


def expectations(score: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chains of equal length, `score` by chain, word and language: each word's probabilities, and the expected number of each transition."""
    n, length, k = score.shape
    step = np.exp(transitions - transitions.max())
    x = np.maximum(np.exp(score - score.max(axis=2, keepdims=True)), 1e-12)
    alpha, beta = np.empty_like(x), np.ones_like(x)
    alpha[:, 0] = x[:, 0] / x[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        a = (alpha[:, t - 1] @ step) * x[:, t]
        alpha[:, t] = a / a.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = (x[:, t + 1] * beta[:, t + 1]) @ step.T
        beta[:, t] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    ahead = x[:, 1:] * beta[:, 1:]
    total = ((alpha[:, :-1] @ step) * ahead).sum(2, keepdims=True)
    pairs = step * ((alpha[:, :-1] / total).reshape(-1, k).T @ ahead.reshape(-1, k))
    return p / p.sum(2, keepdims=True), pairs


def _pieces(texts: list[str], doc: np.ndarray, at: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, dict[int, bytes]]:
    """The hashes of the pieces' words in the order of the pieces, and how words are spelt. Texts are split by slices."""
    place = np.cumsum(taken) - taken
    hashes, spelled = np.empty(int(taken.sum()), np.uint64), {}
    order = np.argsort(doc, kind="stable")
    for low, high in _slices(texts, _BATCH_BYTES):
        mine = order[np.searchsorted(doc[order], low) : np.searchsorted(doc[order], high)]
        if not len(mine):
            continue
        found = words([t.lower() for t in texts[low:high]], NOT_ALNUM)
        n = taken[mine]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        source = np.repeat(found.first[doc[mine] - low] + at[mine], n) + inner
        hashes[np.repeat(place[mine], n) + inner] = found.hash[source]
        fresh, which = np.unique(found.hash[source], return_index=True)
        for h, i in zip(fresh.tolist(), source[which].tolist(), strict=True):
            spelled.setdefault(h, found.data[found.start[i] : found.end[i]])
    return hashes, spelled


def _features(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of all words, how many each has, and whether it holds anything but digits."""
    ids, counts, has = [], [], []
    for low in range(0, len(spelled), _WORDS):
        part = spelled[low : low + _WORDS]
        end = np.cumsum([len(w) for w in part])
        found = Words(b"".join(part), end - [len(w) for w in part], end, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        grams, begin = n_grams(found, np.arange(len(part)))
        ids.append(grams.astype(np.uint16))
        counts.append(np.diff(np.append(begin, len(grams))))
        has.append(letters(found, np.arange(len(part))))
    return np.concatenate(ids), np.concatenate(counts), np.concatenate(has)


def _owners(word: np.ndarray, lang: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word's most frequent language (the first of several), and whether it belongs to that one's lexicon: seen five times, four of five times in it."""
    key, n = np.unique(word * k + lang, return_counts=True)
    of, its = key // k, key % k
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    total, most = np.add.reduceat(n, first), np.maximum.reduceat(n, first)
    top = np.flatnonzero(n == most[of])
    best = its[top[np.append(True, of[top][1:] != of[top][:-1])]]
    return best, (total >= 5) & (most >= 0.8 * total)


def fit(texts: list[str], langs: list[str], chain_words: int = CHAIN_WORDS, chains: int | None = None, rounds: int = 30, seed: int = 5) -> Model:
    """A field fitted to labelled texts by gradient steps on the likelihood of joined chains: unless said otherwise, one for each two texts."""
    languages = sorted(set(langs))
    k = len(languages)
    rng = np.random.Generator(np.random.PCG64(seed))
    label = np.array([languages.index(x) for x in langs], np.int64)
    length = np.concatenate([np.zeros(0, np.int64), *(np.diff(words([t.lower() for t in texts[a:b]], NOT_ALNUM).first) for a, b in _slices(texts, _BATCH_BYTES))])
    usable = np.flatnonzero(length > 0)
    if not len(usable) or k == 0:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32), np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    chains = chains or max(1, len(usable) // 2)
    plan = []  # text, first word, words
    for _ in range(chains):
        room = chain_words
        while room > 0:
            d = int(rng.choice(usable))
            n = int(min(room, length[d], rng.integers(5, chain_words)))
            plan.append((d, int(rng.integers(0, length[d] - n + 1)), n))
            room -= n
    doc, at, taken = np.array(plan, np.int64).T
    hashes, spelled = _pieces(texts, doc, at, taken)
    truth = np.repeat(label[doc], taken)
    distinct, inverse = np.unique(hashes, return_inverse=True)
    ids, count, has = _features([spelled[h] for h in distinct.tolist()])
    begin = np.cumsum(count) - count
    lexicon_language, frequent = _owners(inverse, truth, k)
    lexicon = distinct[frequent]
    member = np.where(frequent, lexicon_language, k)
    lexicon_language = lexicon_language[frequent]
    weights, lexicon_weights, transitions = np.zeros((DIMENSIONS, k)), np.zeros((k + 1, k)), np.zeros((k, k))
    params = [weights, lexicon_weights, transitions]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    batch = max(1, _CELLS // (chain_words * k))
    starts = range(0, chains, batch)
    for r in range(1, max(rounds, len(starts)) + 1):
        low = starts[(r - 1) % len(starts)]
        n = min(batch, chains - low)
        mine = slice(low * chain_words, (low + n) * chain_words)
        which, local = np.unique(inverse[mine], return_inverse=True)
        own = count[which]
        edge = np.cumsum(own) - own
        grams = ids[np.repeat(begin[which] - edge, own) + np.arange(own.sum())]
        score = (np.add.reduceat(weights[grams], edge, axis=0) + lexicon_weights[member[which]]) * has[which, None]
        p, expected = expectations(score[local].reshape(n, chain_words, k), transitions)
        right = truth[mine]
        slope = p.reshape(-1, k)
        slope[np.arange(len(right)), right] -= 1
        by_word = np.stack([np.bincount(local, slope[:, j], len(which)) * has[which] for j in range(k)], 1)
        to_weights = np.stack([np.bincount(grams, np.repeat(by_word[:, j], own), DIMENSIONS) for j in range(k)], 1)
        to_lexicon = np.zeros((k + 1, k))
        np.add.at(to_lexicon, member[which], by_word)
        to_lexicon[k] = 0
        after = np.flatnonzero(np.arange(len(right)) % chain_words)
        observed = np.bincount(right[after - 1] * k + right[after], minlength=k * k).reshape(k, k)
        slopes = [to_weights / len(right) + 1e-6 * weights, to_lexicon / len(right) + 1e-6 * lexicon_weights, (expected - observed) / len(right) + 1e-4 * transitions]
        for p_, g, (m, v) in zip(params, slopes, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p_ -= 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Model(languages, weights.astype(np.float32), lexicon, lexicon_language, lexicon_weights[:k].astype(np.float32), transitions.astype(np.float32))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | str | None = None, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES, chars: int = CHARS) -> Model:
    """Fits a model on about `per_language` documents of each language (all, where there are fewer), chosen by a hash of id and text.

    Null texts and labels teach nothing; rows with null or repeated ids are taken like
    any other.  Of texts longer than `chars` a part of that length is read, from a place
    that depends on their hash.  An empty table gives a model without languages.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where).alias("ok")).where("ok and lang is not null")
    most = labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(max_languages)
    sizes = {r["lang"]: r["count"] for r in most.collect()}
    if not sizes:
        return fit([], [])
    parts = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("id", "text", F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    over = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    part = F.substring("text", (F.pmod(F.xxhash64("text"), over) + 1).cast("int"), F.lit(chars)).alias("text")
    rows = sorted((r["text"], r["lang"]) for r in labelled.where(draw < parts[F.col("lang")]).where("text is not null").select(part, "lang").toLocalIterator())
    return fit([t for t, _ in rows], [x for _, x in rows])


def _slices(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters in all; a longer text is a range of its own."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size + n > most and low < i:
            yield low, i
            low, size = i, 0
        size += n
    if low < len(texts):
        yield low, len(texts)


def slice_size(model: Model) -> int:
    """Characters that are labelled at once."""
    return _BATCH_BYTES * 4 // max(4, len(model.languages))


def _by_sections(model: Model, found: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one long text: the sum of its words' probabilities, which words have letters, and each word's language. Forward over its sections for the messages between them, then backward."""
    cuts = [*range(0, len(found.hash), size), len(found.hash)]

    def section(i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(cuts[i], cuts[i + 1])
        return emissions(model, Words(found.data, found.start[own], found.end[own], found.hash[own], found.doc[own], np.array([0, cuts[i + 1] - cuts[i]])))

    edge = [np.ones(len(model.languages), np.float32)]
    for i in range(len(cuts) - 2):
        edge.append(messages(section(i)[0], np.array([0, cuts[i + 1] - cuts[i]]), model.transitions, before=edge[-1])[1][0])
    total, has, own = np.zeros(len(model.languages)), np.empty(len(found.hash), bool), np.empty(len(found.hash), np.int32)
    after = np.ones(len(model.languages), np.float32)
    for i in range(len(cuts) - 2, -1, -1):
        score, marks = section(i)
        p, _, begins = messages(score, np.array([0, len(score)]), model.transitions, edge[i], after)
        after = begins[0]
        total += p[marks].sum(0, dtype=float)
        has[cuts[i] : cuts[i + 1]], own[cuts[i] : cuts[i + 1]] = marks, p.argmax(1)
    return total, has, own


def label(model: Model, texts: list[str | None], with_segments: bool = False) -> tuple[list[str], list[float], list[list[dict]]]:
    """Each text's language, its share of the words, and the runs of words of one language (word indexes)."""
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    found = words([(t or "").lower() for t in texts], NOT_ALNUM)
    size = max(BLOCK, slice_size(model) // 4 // BLOCK * BLOCK)
    if len(texts) == 1 and len(found.hash) > size:
        total, has, own = _by_sections(model, found, size)
        sums = np.stack([np.zeros_like(total), total])
    else:
        score, has = emissions(model, found)
        p = marginals(score, found.first, model.transitions)
        own = p.argmax(1) if with_segments else None
        sums = np.concatenate([np.zeros((1, len(model.languages))), np.cumsum(p * has[:, None], axis=0, dtype=float)])[found.first]
    names, shares, segments = [], [], []
    counts = np.concatenate([[0], np.cumsum(has)])[found.first]
    for d, t in enumerate(texts):
        n = counts[d + 1] - counts[d]
        if not n or not has_letter(t):
            names.append(UNKNOWN)
            shares.append(0.0)
        else:
            share = (sums[d + 1] - sums[d]) / n
            best = int(share.argmax())
            names.append(model.languages[best])
            shares.append(float(min(1.0, max(0.0, share[best]))))
        runs = []
        if with_segments and found.first[d + 1] > found.first[d]:
            mine = own[found.first[d] : found.first[d + 1]]
            edge = [0, *(np.flatnonzero(mine[1:] != mine[:-1]) + 1).tolist(), len(mine)]
            runs = [{"begin": a, "end": b, "lang": model.languages[mine[a]]} for a, b in zip(edge[:-1], edge[1:], strict=True)]
        segments.append(runs)
    return names, shares, segments


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_segments: bool = False) -> DataFrame:
    """id, lang_pred, score of each row, and if asked for the segments of words; `und` and 0 for a text without letters.

    A model without languages says `und` of every text.  Rows with null or repeated
    ids are labelled like any other; of equal shares the first language counts.  Texts
    are read whole, whatever their length.  Other columns are left out.  An empty table
    gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _slices(texts := batch["text"].to_pylist(), slice_size(sent.value)):
                names, shares, segments = label(sent.value, texts[low:high], with_segments)
                columns = [batch["id"][low:high], pa.array(names, pa.string()), pa.array(shares, pa.float64())]
                if with_segments:
                    columns.append(pa.array(segments, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "lang_pred", "score", "segments"][: len(columns)])

    schema = f"`{id_col}` bigint, lang_pred string, score double" + f", segments {SEGMENTS}" * with_segments
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(apply, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.4) -> DataFrame:
    """The rows whose text has a language with at least that share of its words; with a model without languages, those that have a letter.

    All columns stay, whatever their names.  Null texts and those without letters go;
    null ids and repeated rows are judged like any other.  An empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for low, high in _slices(texts := batch[text_col].to_pylist(), slice_size(sent.value)):
                names, shares, _ = label(sent.value, texts[low:high])
                keep += [has_letter(t) if not sent.value.languages else n != UNKNOWN and s >= least_score for t, n, s in zip(texts[low:high], names, shares, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)
