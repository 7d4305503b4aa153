"""Leakage search without a session: the inverted file, runs in foreign contexts, edited items, and what each step gives."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import leakage

HAN = [chr(c) for c in range(0x4E00, 0x5200)]


def _table():
    rng = np.random.default_rng(4)
    return (rng.standard_normal((leakage.TERMS, leakage.RANK)) / leakage.RANK**0.5).astype(np.float32), np.ones(leakage.TERMS)


def _words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n)]


def _made(rng):
    items = [(i, "en", " ".join(_words(rng, 40))) for i in range(40)] + [(100 + i, "zh", "".join(rng.choices(HAN, k=70))) for i in range(20)]
    return items, leakage.ItemIndex(items, *_table())


def _planted(rng, item, cut):
    """A document with the part of the item that ``cut`` makes of it."""
    _, lang, text = item
    if lang == "zh":
        return "".join(rng.choices(HAN, k=rng.randint(30, 90))) + cut(list(text), "") + "".join(rng.choices(HAN, k=50))
    return " ".join(_words(rng, rng.randint(30, 80))) + " " + cut(text.split(), " ") + " " + " ".join(_words(rng, 40))


def _kinds(index, items, docs):
    found = index.leaks(docs, _table()[0])
    return [found.get((i, item[0]), ("none",))[0] for i, item in enumerate(items)], found


def test_inverted_file_against_brute_force():
    rng = np.random.default_rng(1)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    centres = rng.standard_normal((60, 64))
    vectors = unit(np.repeat(centres, 20, axis=0) + 0.5 * rng.standard_normal((1200, 64)))
    queries = unit(vectors[rng.integers(0, 1200, 500)] + 0.12 * rng.standard_normal((500, 64)))
    q, v, c = leakage.InvertedFile(vectors).near(queries)
    brute = {(int(a), int(b)) for a, b in zip(*np.nonzero(queries @ vectors.T >= leakage.LEAST_COSINE))}
    got = set(zip(q.tolist(), v.tolist()))
    assert got <= brute and len(got) >= 0.95 * len(brute)


@pytest.mark.parametrize("length", [0, 1])
def test_runs_in_foreign_contexts(length):
    """Runs of the required length are found wherever they begin, runs one shorter are no exact leaks."""
    rng = random.Random(2)
    items, index = _made(rng)

    def cut(parts, between):
        run = (leakage.RUN_WORDS if between else leakage.RUN_LETTERS) - length
        at = rng.randrange(len(parts) - run + 1)
        return between.join(parts[at : at + run])

    kinds, found = _kinds(index, items * 3, [_planted(rng, item, cut) for item in items * 3])
    assert kinds.count("exact") == (0 if length else len(kinds))
    assert all(items[i % len(items)][0] == item for (i, item), how in found.items() if how[0] == "exact")


def test_edited_items_are_paraphrases():
    rng = random.Random(3)
    items, index = _made(rng)

    def cut(parts, between):
        step = 7 if between else 9
        return between.join((_words(rng, 1)[0] if between else rng.choice(HAN)) if i % step == step - 1 else w for i, w in enumerate(parts))

    kinds, _ = _kinds(index, items, [_planted(rng, item, cut) for item in items])
    assert kinds.count("paraphrase") >= 0.9 * len(kinds)
    noise = [" ".join(_words(rng, 120)) for _ in range(40)] + ["".join(rng.choices(HAN, k=200)) for _ in range(20)]
    assert not index.leaks(noise, _table()[0])


@pytest.mark.parametrize("step", ["common_subsequence", "near"])
def test_every_step_is_needed(monkeypatch, step):
    rng = random.Random(5)
    items, index = _made(rng)
    docs = [_planted(rng, item, lambda parts, between: between.join(parts)) for item in items]
    assert set(_kinds(index, items, docs)[0]) == {"exact"}
    if step == "near":
        monkeypatch.setattr(leakage.InvertedFile, "near", lambda self, q, *a: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)))
    else:
        monkeypatch.setattr(leakage, step, lambda a, b: 0)
    assert not index.leaks(docs, _table()[0])


def test_nothing():
    _, index = _made(random.Random(6))
    assert not index.leaks([None, "", " ", "one", "。"], _table()[0]) and not leakage.ItemIndex([(1, "en", "..."), (2, None, None)], *_table()).leaks(["some words"], _table()[0])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abzé0я_ -\n石堂カท²"), max_size=40), max_size=5))
def test_texts_are_cut_as_the_patterns_say(texts):
    """Words, letters, terms and passages against the patterns, text by text."""
    held = list(leakage.cut_up(texts, (4, 2), (6, 3)))
    names: dict[str, int] = {}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\W_]+", leakage.normal(text))
        stream = "".join(words)
        mine = {p.by_letters: p for k, p in held if k == i}
        assert (False in mine) == bool(words) and (True in mine) == (bool(stream) and bool(re.search("[㐀-鿿]", leakage.normal(text))))
        for by_letters, p in mine.items():
            whole = stream if by_letters else words
            assert p.stream == whole and p.n == len(whole) and [p.piece(a, b) for a, b in zip(p.starts, p.ends)] == [whole[a:b] for a, b in zip(p.starts, p.ends)]
            pieces = [(m.start(), m.group()) for m in re.finditer(r"[a-z0-9à-ɏа-ӿ]+|[^\W_]", stream)] if by_letters else list(enumerate(words))
            assert p.at.tolist() == [a for a, _ in pieces]
            terms = [t if not by_letters or len(t) > 1 or not k or len(pieces[k - 1][1]) > 1 else pieces[k - 1][1] + t for k, (_, t) in enumerate(pieces)]
            assert all(names.setdefault(t, h) == h for t, h in zip(terms, p.terms.tolist()))
