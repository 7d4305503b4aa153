"""Words of any length encode whole, in time that doesn't grow with their square."""

import base64
import random
import time

import pytest

from loomwright.llm import encode, tokens


@pytest.fixture(scope="module")
def both():
    return encode.RecursiveBpe(), tokens._encoding(tokens.RANKS_PATH)


@pytest.mark.parametrize("kind", ["base64", "letters", "bases", "one", "two", "han"])
def test_long_words_are_the_tokenizers(both, kind):
    rng = random.Random(7)
    made = {
        "base64": lambda: base64.b64encode(rng.randbytes(30_000)).decode(), "letters": lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40_000)),
        "bases": lambda: "".join(rng.choices("ACGT", k=40_000)), "one": lambda: "a" * 3_001, "two": lambda: "ab" * 2_001, "han": lambda: "中文字符测试" * 3_000,
    }
    word = made[kind]()
    assert both[0].encode([word, None, ""]) == [both[1].encode_ordinary(word), [], []]


def test_a_megabyte_in_a_word(both):
    began = time.time()
    word = "".join(random.Random(8).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    ids = both[0].encode([word])[0]
    assert time.time() - began < 60 and both[1].decode(ids) == word
