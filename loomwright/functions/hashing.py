"""Hashes, digests and the seeded generator behind deterministic samples."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Constants of the SplitMix64 generator and of the seeds derived from it.
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
RESERVOIR_SEED = 0x6A09E667F3BCC909


def _seed(seed: int, little: bool = False) -> Column:
    return F.unhex(F.lit((seed & MASK).to_bytes(8, "little" if little else "big").hex()))


def evaluation_score(seed: int, key: Column) -> Column:
    """SHA-256 of the big-endian seed and the key; the lowest scores are held out."""
    return F.sha2(F.concat(_seed(seed), F.encode(key, "UTF-8")), 256)


def calibration_score(seed: int, digest: Column) -> Column:
    """SHA-256 of the little-endian seed and a shard's digest."""
    return F.sha2(F.concat(_seed(seed, little=True), F.encode(digest, "UTF-8")), 256)


def ordered_digest(keys: Column, separator: str = "\n") -> Column:
    """Aggregate: SHA-256 over the sorted keys, each with the separator behind it; of nothing where there are none."""
    listed = F.array_sort(F.collect_list(F.concat(keys, F.lit(separator))))
    return F.sha2(F.encode(F.array_join(listed, ""), "UTF-8"), 256)


def split_mix(state: int) -> Iterator[int]:
    """Numbers of a SplitMix64 generator."""
    while True:
        state = (state + GOLDEN) & MASK
        z = state
        z = ((z ^ (z >> 30)) * MIX_A) & MASK
        z = ((z ^ (z >> 27)) * MIX_B) & MASK
        yield z ^ (z >> 31)
