"""Words that packing splits itself."""

import random

import numpy as np

from vellum.llm import packing
from vellum.llm.queries import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")


def test_simple_words_are_only_merged_by_the_library(monkeypatch):
    coder = packing.Words(PATH)
    reached, ids = [], coder._ids
    monkeypatch.setattr(coder, "_ids", lambda texts: reached.extend(texts) or ids(texts))
    texts = ["Some words, they've said: don't!\nIT'S 1984", "Été, größer; ÀÖØöøÿß_x", "plain 中文 words", "x" * 100]
    got = coder.encode(texts)
    assert reached == ["中文"]
    assert got == [x.tobytes() for x in ids(texts)]


def test_any_characters_give_the_library_s_ids():
    coder, choose = packing.Words(PATH), random.Random(7)
    pools = [
        [chr(i) for i in range(1, 128)], [chr(i) for i in range(1, 0x180)], list("aA'sStTrRvVeEmMlLdD '\n.,!_<>/w|09"), ["<|endoftext|>", "a", "</w>", " ", "é", "É", "'s", "'S"],
        [chr(i) for i in (0x345, 0x391, 0x3A3, 0x3C2, 0x130, 0x131, 0x1C5, 0xDF, 0x1E9E, 0x301, 65, 101, 32, 0x2028, 0x85, 0xA0, 0x1D, 0xB5, 0xAA, 0xB2, 0xBD, 0xD7, 0xF7, 0x663, 0xFF, 0xC0, 0x1F600, 0x4E2D)],
    ]
    texts = ["".join(choose.choice(pool) for _ in range(choose.randint(0, 120))) for pool in pools for _ in range(1000)]
    whole = [np.array(e.ids, "<u4").tobytes() for e in coder._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x for at in range(0, len(texts), 300) for x in coder.encode(texts[at : at + 300])] == whole


def test_another_vocabulary_splits_by_itself(tmp_path):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(PATH)
    other.normalizer = None
    other.save(path := str(tmp_path / "other.json"))
    coder = packing.Words(path)
    assert coder._merger is None
    texts = ["Some Words here", "été ÉTÉ"]
    assert coder.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in other.encode_batch_fast(texts, add_special_tokens=False)]
