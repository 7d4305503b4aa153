"""Very long texts end in time that grows with their length, in every operator on single texts."""

import time

import pytest

from loomwright.llm import mainbody, nearcopies, pii, sentences


@pytest.mark.parametrize(
    ("function", "text", "least"),
    [
        (sentences.sentences, 'He said so. "Stop. Go home." and left. ' * 25_000, 50_000),
        (sentences.sentences, "他说：“走吧。”但是我不走。" * 60_000, 100_000),
        (sentences.sentences, '"a. ' * 200_000, 1),
        (pii.find_items, "rows 123456 and 7890123 of 55. " * 30_000, 0),
        (pii.find_items, "a.b@c.example, " * 60_000, 60_000),
        (pii.find_items, "x" * 1_000_000 + " a@b.example", 1),
        (mainbody.boilerplate_lines, "News | About | Contact\n" * 20_000, 20_000),
    ],
)
def test_long_texts(function, text, least):
    began = time.time()
    assert len(function(text)) >= least and time.time() - began < 30


def test_a_long_text_has_a_fingerprint():
    words, codes = nearcopies.fingerprints(["ab" * 1_000_000, "short enough " * 50])
    assert words.shape == (2, 4) and codes.shape == (2, nearcopies.SEGMENTS)
