"""Near-duplicate texts by Golay-code fuzzy hashing, with exact verification.

Every text becomes a fingerprint: one-permutation minhashes of its 5-character shingles. The low
bits of ``PARTS`` of them form a segment of 23 bits, and each segment is decoded to the nearest
codeword of the binary (23, 12) Golay code, so that a few differing bits of a segment still give
the same 12-bit index. Keys hold codeword indices and nothing else: segments stand in ``GROUPS``
groups of ``IN_GROUP``, and every choice of all but one segment of a group is a key of 36 bits,
which keeps the number of chance candidates small however many texts there are.

Pigeonhole: a spoiled segment (one whose index differs) takes part in all keys of its group but
one, so a pair of texts with fewer than two spoiled segments in any one group shares a key, and
one with fewer than ``2 * GROUPS`` spoiled segments in all has such a group. All segments draw
from disjoint bins. Candidates whose fingerprints are too far apart go, the rest is verified on
the shingle sets themselves.

Texts are lower-cased, white space is collapsed and trimmed. Exact copies form classes first;
only a class's smallest row id takes part in the search.

At the threshold a segment survives with probability 0.458 (0.426 without the code) and a group
gives a key with 0.252, so that all groups miss three pairs in a thousand; recall is measured in
``tests/llm/test_recall.py`` and told in the README.

Defined results: null texts, texts under the least length and rows without an id take no part; a row id counts once;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.runtime import cut, map_arrow, slices, spread, strings

SHINGLE = 5
LEAST_CHARS = 500
#: Similarity from which two texts count, in hundredths.
LEAST_SIMILARITY = 75

#: Groups of segments, segments of a group, minhashes of a segment and the bits that each gives.
GROUPS, IN_GROUP, SEGMENT = 20, 4, 23
PARTS = (8, 8, 7)
SEGMENTS = GROUPS * IN_GROUP
BINS = 290
#: Of 256 fingerprint bits, those in which candidates may differ: the expected 32 at 0.75 and 4 deviations.
#: A parameter; None verifies every candidate.
MOST_BITS = 54
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101


def codeword(message: int) -> int:
    """Systematic codeword of a 12-bit message."""
    rest = message << 11
    for bit in range(22, 10, -1):
        if rest >> bit & 1:
            rest ^= GENERATOR << (bit - 11)
    return message << 11 | rest


@lru_cache(maxsize=1)
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """Parity of every 12-bit message, and the lightest error pattern of every syndrome (three bits at most)."""
    words = np.array([codeword(m) for m in range(1 << 12)], np.int64)
    weight = np.array([bin(i).count("1") for i in range(1 << 12)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    for syndrome in range(1 << 11):
        coset = words ^ syndrome
        errors[syndrome] = coset[np.argmin(weight[coset & 4095] + weight[coset >> 12])]
    return words & 2047, errors


def nearest_codewords(segments: np.ndarray) -> np.ndarray:
    """12-bit indices of the codewords nearest to 23-bit vectors."""
    parity, errors = _decoder()
    syndrome = parity[segments >> 11] ^ (segments & 2047)
    return (segments ^ errors[syndrome]) >> 11


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def shingle_hashes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = max(len(codes) - SHINGLE + 1, 0)
    h = np.zeros(size, np.uint64)
    for i in range(SHINGLE):
        h = h * np.uint64(0x100000001B3) + codes[i : i + size]
    return _mix(h)


def minhashes(texts: list[str]) -> np.ndarray:
    """One-permutation minhashes (texts x BINS); an empty bin borrows from the next full one by fixed steps."""
    hashes = [shingle_hashes(t) for t in texts]
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(h) for h in hashes])
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    # a doc and bin in the upper 24 bits, so that batches hold at most 60,000 texts
    place = doc * np.uint64(BINS) + h % np.uint64(BINS)
    both = np.sort(place << np.uint64(40) | h >> np.uint64(24))
    place = (both >> np.uint64(40)).astype(np.int64)
    first = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, bool)
    out, full = np.zeros(len(texts) * BINS, np.uint64), np.zeros(len(texts) * BINS, bool)
    out[place[first]], full[place[first]] = both[first] & np.uint64((1 << 40) - 1), True
    out, full = out.reshape(-1, BINS), full.reshape(-1, BINS)
    base, known = out.copy(), full.copy()
    for step in range(1, BINS):
        if full.all():
            break
        take = ~full & np.roll(known, -37 * step, axis=1)
        out[take] = (np.roll(base, -37 * step, axis=1) + np.uint64(step * 0x9E3779B1))[take]
        full |= take
    return _mix(out + np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=1)
def _places() -> np.ndarray:
    """Bins of every segment (SEGMENTS x PARTS), no bin in two places."""
    return np.random.default_rng(23).permutation(BINS)[: SEGMENTS * len(PARTS)].reshape(SEGMENTS, len(PARTS))


def segments_of(m: np.ndarray) -> np.ndarray:
    """Segments (texts x SEGMENTS) of 23 bits from rows of minhashes."""
    out, at = np.zeros((len(m), SEGMENTS), np.int64), 0
    for k, bits in enumerate(PARTS):
        out |= (m[:, _places()[:, k]] & np.uint64((1 << bits) - 1)).astype(np.int64) << at
        at += bits
    return out


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """By text: 256 bits as four integers, and the codeword indices of its segments."""
    m = minhashes(texts)
    words = ((m[:, :256] >> np.uint64(20) & np.uint64(1)).reshape(-1, 4, 64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)
    return words, nearest_codewords(segments_of(m)).astype(np.uint16)


def group_keys(codes: np.ndarray) -> np.ndarray:
    """Keys of each text (texts x SEGMENTS): a group's indices without one of them, and which group and segment that is."""
    grouped = codes.astype(np.int64).reshape(-1, GROUPS, IN_GROUP)
    keys = np.empty_like(grouped)
    for left_out in range(IN_GROUP):
        key = np.full(grouped.shape[:2], left_out, np.int64) + np.arange(GROUPS) * IN_GROUP
        for k in range(IN_GROUP):
            if k != left_out:
                key = key << 12 | grouped[:, :, k]
        keys[:, :, left_out] = key
    return keys.reshape(len(codes), -1)


def _prints(rows: DataFrame, least: int) -> DataFrame:
    """(row_id, copy, bits, codes) of every row that takes part; copy is a 128-bit digest of the normal text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in slices(batch, 1, 1_000):
                texts = [normal(t) if t else "" for t in strings(part.column(1))]
                kept = [i for i, t in enumerate(texts) if len(t) >= least]
                texts = [texts[i] for i in kept]
                if not kept:
                    continue
                bits, codes = fingerprints(texts)
                digests = [xxhash.xxh3_128_digest(t.encode("utf-8", "replace")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept)), pa.array(digests, pa.binary()), pa.array(list(bits), pa.list_(pa.int64())), pa.array([c.tobytes() for c in codes], pa.binary())], names=["row_id", "copy", "bits", "codes"])

    schema = rows.select(F.col("row_id"), F.lit(b"").alias("copy"), F.array(F.lit(0).cast("bigint")).alias("bits"), F.lit(b"").alias("codes")).schema
    return map_arrow(spread(rows.filter("row_id IS NOT NULL").select("row_id", "text")), run, schema)


def _keys(classes: DataFrame) -> DataFrame:
    """(key, class_id): the keys of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SEGMENTS)
                keys = group_keys(codes)
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(ids)], names=["key", "class_id"])

    schema = classes.select(F.lit(0).cast("bigint").alias("key"), "class_id").schema
    return map_arrow(classes.select("class_id", "codes"), run, schema)


def _verified(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b, text_a, text_b) whose shingle sets are similar enough, with the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, np.ndarray] = {}
        for batch in batches:
            if len(memo) > 4_000:
                memo.clear()
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = strings(batch.column(2)), strings(batch.column(3))
            keep, similarity = [], []
            for i in range(len(a)):
                for key, text in ((a[i], ta[i]), (b[i], tb[i])):
                    if key not in memo:
                        memo[key] = np.unique(shingle_hashes(normal(text)))
                x, y = memo[a[i]], memo[b[i]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - common
                if common * 100 >= least * union:
                    keep.append(i)
                    similarity.append(common / union)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), pa.array(similarity, pa.float64())], names=["a", "b", "similarity"])

    schema = pairs.select("a", "b", F.lit(0.0).alias("similarity")).schema
    return map_arrow(pairs, run, schema)


class NearCopies:
    """Classes of exact copies and the similar pairs of their representatives."""

    def __init__(self, rows: DataFrame, least_chars: int = LEAST_CHARS, least_similarity: int = LEAST_SIMILARITY, most_bits: int | None = MOST_BITS):
        prints = cut(_prints(rows, least_chars))
        narrow = prints.groupBy("copy").agg(F.min("row_id").alias("class_id"), F.first("bits").alias("bits"), F.first("codes").alias("codes"), F.count_distinct("row_id").alias("n"))
        classes = cut(narrow)
        #: (class_id, row_id) of the rows that have exact copies.
        self.members = prints.select("copy", "row_id").join(classes.filter("n > 1").select("copy", "class_id"), "copy").select("class_id", "row_id").distinct()
        keys = _keys(classes)
        near = keys.withColumnRenamed("class_id", "a").join(keys.withColumnRenamed("class_id", "b"), "key").filter("a < b").select("a", "b").distinct()
        bits = classes.select("class_id", *[F.col("bits")[i].alias(f"w{i}") for i in range(4)])
        of = lambda side: bits.select(F.col("class_id").alias(side), *[F.col(f"w{i}").alias(f"{side}{i}") for i in range(4)])
        off = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(4)), F.lit(0))
        close = cut(near.join(of("a"), "a").join(of("b"), "b").filter(F.lit(True) if most_bits is None else off <= most_bits).select("a", "b"))
        wanted = close.select(F.explode(F.array("a", "b")).alias("row_id")).distinct()
        texts = rows.select("row_id", "text").join(wanted, "row_id", "left_semi").dropDuplicates(["row_id"])
        paired = close.join(texts.select(F.col("row_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("row_id").alias("b"), F.col("text").alias("text_b")), "b")
        #: (a, b, similarity) of different texts, by class id.
        self.pairs = cut(_verified(paired.select("a", "b", "text_a", "text_b"), least_similarity))

    def links(self) -> DataFrame:
        """(row_id_a, row_id_b): every link between different texts, and every copy.

        A class of copies is a star around its smallest row id. A link of two classes joins each
        row of one to the other's smallest row id, so no pairs are multiplied out within copies.
        """
        m = self.members
        rep = self.pairs.select("a", "b")
        left = rep.join(m.select(F.col("class_id").alias("a"), F.col("row_id").alias("x")), "a").select(F.col("x"), F.col("b").alias("y"))
        right = rep.join(m.select(F.col("class_id").alias("b"), F.col("row_id").alias("y")), "b").select(F.col("a").alias("x"), F.col("y"))
        star = m.filter("class_id <> row_id").select(F.col("class_id").alias("x"), F.col("row_id").alias("y"))
        every = rep.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(left).unionByName(right).unionByName(star)
        return every.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b")).distinct()

    def documents(self) -> DataFrame:
        """(row_id, class_id, links): the similar texts of each class that has any, by class."""
        ends = self.pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
        every = self.members.join(ends, "class_id", "left")
        alone = ends.join(self.members.select("class_id").distinct(), "class_id", "left_anti").select("class_id", F.col("class_id").alias("row_id"), "links")
        return every.select("class_id", "row_id", F.coalesce("links", F.lit(0)).alias("links")).unionByName(alone).select("row_id", "class_id", "links")
