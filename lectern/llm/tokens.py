"""Encoding of whole texts by the `tokenizers` library, with a memo of words.

Both vocabularies cut a text before every single space that stands between two
other characters, and merge nothing across such a cut.  The same
holds for single line ends.  So a text's ids are the ids of its chunks, one after
the other; each distinct chunk is
encoded once per worker.  Texts for which that cut is not certain (runs of
spaces, white space at a chunk's edge) are cut by the vocabulary's own pattern, and texts with letters beyond the
common European ones are handed to the library as they are.  So are texts that may
hold an added token, and all texts where a tokenizer has another layout than these two.
"""

from __future__ import annotations

import json
import os
from unicodedata import is_normalized

import numpy as np
import regex

MEMO_ENTRIES = 400_000
#: Letters beyond this one may differ between Unicode versions.
_KNOWN = "ɐ"
_CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
_PIECES = {
    "bytes": regex.compile(_CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"),
    "words": regex.compile(_CONTRACTIONS + r"|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"),
}


#: Marks that stand at the end of words; a run of them is one piece.
_TAIL = ".,!?;:*&$%#()[]\"-"


#: How the two layouts normalise and split, as their files say it.
_LAYOUTS = {
    "bytes": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    "words": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    ),
}


class _Whole(Exception):
    """The text cannot be cut at its spaces."""


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def vocabulary_path(name: str) -> str:
    """A path as it is, or the name of one of the installed public vocabularies."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memo(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, key):
        value = self.encode(key)
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[key] = value
        return value


class Encoder:
    """`encode(text)` gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(vocabulary_path(name))
        self.tokenize = self.library.model.tokenize
        known = json.loads(self.library.to_str())
        layout = (known.get("normalizer"), known.get("pre_tokenizer"))
        self.known = layout in _LAYOUTS.values() and known["model"]["type"] == "BPE"
        self.words = layout == _LAYOUTS["words"]
        #: How the added tokens begin; a text without any of these beginnings holds none.
        self.marks = sorted({t["content"][:2] for t in known.get("added_tokens", [])})
        self.known &= not any(c.isalpha() for m in self.marks for c in m)
        self.cut = _PIECES["words" if self.words else "bytes"].findall
        self.letters = byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.piece = _Memo(self._piece)
        self.first = _Memo(lambda chunk: self._chunk(chunk, "", self.first))
        self.later = self.first if self.words else _Memo(lambda chunk: self._chunk(chunk, " ", self.later))
        self.line_end = b"" if self.words else self._piece("\n")

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(letters)])

    def _pieces(self, text: str) -> bytes:
        if not text.isascii() and max(text) >= _KNOWN:
            return self.whole(text)
        if self.words:
            text = text.lower() if is_normalized("NFC", text) else self.library.normalizer.normalize_str(text)
        return b"".join(map(self.piece.__getitem__, self.cut(text)))

    def _chunk(self, chunk: str, before: str, memo: _Memo) -> bytes:
        if not self.words and (not chunk or chunk[0].isspace() or chunk[-1].isspace()):
            raise _Whole
        if chunk.isascii() or max(chunk) < _KNOWN and is_normalized("NFC", chunk):
            if self.words and (lower := chunk.lower()) != chunk:
                return memo[lower]
            if chunk.isalpha():
                return self._piece(before + chunk)
            core = chunk.rstrip(_TAIL)
            if core.isalpha():
                return memo[core] + self.piece[chunk[len(core) :]]
        return self._pieces(before + chunk)

    def encode(self, text: str) -> bytes:
        if not self.known or any(m in text for m in self.marks):
            return self.whole(text)
        first, later, parts = self.first, self.later, []
        try:
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                parts.append(first[head] + b"".join(map(later.__getitem__, rest)))
        except _Whole:
            return self._pieces(text)
        return self.line_end.join(parts)


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder a worker."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]
