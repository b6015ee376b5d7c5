"""Words of a batch of texts as numpy arrays: places in one byte buffer and 64-bit hashes."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

#: ASCII white space: what `bytes.split()` splits at.
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: Anything that is neither an ASCII letter or digit nor part of a longer UTF-8 letter.
NOT_ALNUM = ~np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])

#: Scripts written without spaces: Thai to Myanmar, Khmer, kana and Han.
UNSPACED = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))

_SEGMENT = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Odd multipliers for sequences of words.
PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers


@dataclass
class Words:
    """`start`, `end`: byte places in `data`; `doc`: index of the text; `first`: index of each text's first word, and their number."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def place(self) -> np.ndarray:
        """Index of each word in its text."""
        return np.arange(len(self.start)) - self.first[self.doc]

    def left(self) -> np.ndarray:
        """How many words of the text begin here or later."""
        return self.first[self.doc + 1] - np.arange(len(self.start))

    def windows(self, size: int, salt: int = 0) -> np.ndarray:
        """Hash of the `size` words from each word on; meaningful only where left() >= size."""
        n = len(self.hash) - size + 1
        out = np.zeros(len(self.hash), np.uint64)
        if n > 0:
            total = self.hash[:n] * PLACES[salt]
            for k in range(1, size):
                total += self.hash[k : k + n] * PLACES[salt + k]
            out[:n] = mix(total)
        return out


def words(texts: list[str | None], gaps: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are not in `gaps`, text by text; a null text has none."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join([*parts, b""])
    offset = np.cumsum([0, *(len(p) + 1 for p in parts)])
    buffer = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = ~gaps[buffer]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # by segments that end at a word's end, so that no table is longer than a segment or a word
        until = max(at + 1, int(np.searchsorted(end, start[at] + _SEGMENT, "right")))
        low, high = start[at], end[until - 1]
        power, inverse = _power_tables(int(high - low) + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[buffer[low:high]] * power[: high - low], out=total[1:])
        s, e = start[at:until] - low, end[at:until] - low
        hashes[at:until] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = until
    first = np.searchsorted(start, offset)
    return Words(data, start, end, hashes, np.repeat(np.arange(len(parts)), np.diff(first)), first)


class _Spaced(dict):
    """Of each code point: itself in letters, digits and marks, between spaces in unspaced scripts, else a space."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if code < 128:
            out = c
        elif unicodedata.category(c)[0] not in "LNM":
            out = " "
        else:
            out = f" {c} " if any(a <= code <= b for a, b in UNSPACED) else c
        self[code] = out
        return out


_SPACED = _Spaced()


def spaced(text: str) -> str:
    """The text with spaces for all beyond ASCII that is no letter, digit or mark, and around each letter of unspaced scripts."""
    if text.isascii():
        return text
    other = [c for c in set(text) if _SPACED[ord(c)] != c]
    if len(other) > 20:
        return text.translate(_SPACED)
    for c in other:
        text = text.replace(c, _SPACED[ord(c)])
    return text


def any_of(flag: np.ndarray, size: int) -> np.ndarray:
    """For each place, how many of the `size` flags from it on are set."""
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    last = np.minimum(np.arange(len(flag)) + size, len(flag))
    return total[last] - total[:-1]
