"""Recall of the near-copy keys near the threshold, and what the code and the pigeonhole give."""

import random
from functools import lru_cache

import numpy as np

from loomwright.llm import nearcopies


@lru_cache(maxsize=1)
def _pairs():
    """Minhashes of 1,000 pairs of texts with a similarity of 0.75 to 0.77."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    left, right = [], []
    while len(left) < 1_000:
        words = [word() for _ in range(rng.randint(100, 300))]
        edits = set(rng.sample(range(len(words)), int(len(words) * rng.uniform(0.05, 0.1))))
        a, b = " ".join(words), " ".join(word() if i in edits else w for i, w in enumerate(words))
        x, y = np.unique(nearcopies.shingle_hashes(a)), np.unique(nearcopies.shingle_hashes(b))
        common = len(np.intersect1d(x, y))
        if 0.75 <= common / (len(x) + len(y) - common) < 0.77:
            left.append(a)
            right.append(b)
    return nearcopies.minhashes(left), nearcopies.minhashes(right)


def _codes(decode):
    return [decode(nearcopies.segments_of(m)) for m in _pairs()]


def _shared(codes):
    a, b = (nearcopies.group_keys(c) for c in codes)
    return (a == b).any(axis=1)


def test_key_recall_near_the_threshold():
    assert _shared(_codes(nearcopies.nearest_codewords)).sum() >= 970


def test_the_code_finds_what_plain_segments_lose():
    coded, plain = (_codes(f) for f in (nearcopies.nearest_codewords, lambda s: s & 4095 ^ s >> 11))
    assert (coded[0] == coded[1]).sum() > 1.05 * (plain[0] == plain[1]).sum()
    assert (~_shared(coded)).sum() < (~_shared(plain)).sum()


def test_pigeonhole_over_spoiled_segments():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 4096, (300, nearcopies.SEGMENTS))
    for most in (1, nearcopies.GROUPS, 2 * nearcopies.GROUPS - 1):
        spoiled = codes.copy()
        for row in spoiled:
            row[rng.choice(nearcopies.SEGMENTS, most, replace=False)] ^= 1
        assert _shared((codes, spoiled)).all()  # fewer than two a group somewhere
    spoiled = codes.copy()
    spoiled[:, 0 :: nearcopies.IN_GROUP] ^= 1
    spoiled[:, 1 :: nearcopies.IN_GROUP] ^= 1
    assert not _shared((codes, spoiled)).any()


def test_segments_draw_from_disjoint_bins():
    places = nearcopies._places().reshape(-1)
    assert len(set(places.tolist())) == len(places) and sum(nearcopies.PARTS) == nearcopies.SEGMENT
