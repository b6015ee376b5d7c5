import random

import numpy as np
import pytest
from tokenizers import Tokenizer, models, normalizers

from lectern.llm.tokens import Encoder, vocabulary_path

PARTS = ["The", "of", "don't", "I'll", "12", "3.5", "é", "straße", "ÉCOLE", "日本語", "ς", "Σ", "İ", "á", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "\n", "\t", "\xa0", "...", "$$$", "'", "x'ss", " ", "😀", "a_b", "ﬁ", "\x1c", "--", "½", "²"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_equals_the_library_on_whole_texts(name):
    encoder, rng = Encoder(name), random.Random(1)
    library = Tokenizer.from_file(vocabulary_path(name))  # as it is read from its file
    for _ in range(3000):
        n = rng.choice([0, 1, 2, 5, 30])
        text = "".join(rng.choice(PARTS) + rng.choice(["", " ", " ", " ", "  ", "\n", " \n", "\n ", "   "]) for _ in range(n))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_layouts_are_left_to_the_library(tmp_path):
    other = Tokenizer(models.BPE(vocab={"a": 0, "b": 1, " ": 2, "ab": 3}, merges=[("a", "b")]))
    other.normalizer = normalizers.Lowercase()
    other.save(str(tmp_path / "t.json"))
    assert np.frombuffer(Encoder(str(tmp_path / "t.json")).encode("AB ba"), "<u4").tolist() == other.encode("AB ba").ids == [3, 2, 1, 0]


def test_empty_text_has_no_ids():
    assert np.frombuffer(Encoder("byte_bpe_50k.json").encode(""), "<u4").size == 0
