"""Evaluation passages in training text by latent semantic retrieval, then sequence checks.

Texts are NFKC-normalised and lower-cased. Documents are cut into overlapping passages such that
every run of 13 words (26 letters or digits, for Chinese items) lies whole in one of them; items
into passages of that length. Passages become TF-IDF vectors over hashed terms, the document
frequencies counted over all documents, and are projected on a latent basis: the leading right
singular vectors of a passage matrix, found by randomised subspace iteration whose matrix
products run on the executors.

The item passages of a block stand in an inverted file: spherical k-means puts their latent vectors
into lists, a document passage meets the lists whose centre is near it, and of these the item
passages with a large enough cosine are its candidates. A candidate is verified by the longest
common subsequence of the document passage and the item: one as long as the required run lets the
check of the run itself decide (an exact leak); else the share of the item passage in common and
the presence of the item's rare terms (its answer) tell a paraphrase.

The basis, not the search, is fitted on a bounded sample: all item passages and about
``FIT_PASSAGES`` document passages, those of the documents whose hash lies under a threshold that
follows from the counted passages; of one document at most a hundredth of that, evenly spread.
Every document is searched. The query set (items, at most ``MOST_ITEMS``, else an error) is walked
in blocks of ``BLOCK`` passages.

Defined results: null, empty and short texts hold no passages and no leaks; repeated documents
are each reported; ties don't matter, since all candidates above the threshold are checked; extra
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.runtime import cut, map_arrow, ship, spread, strings

RUN_WORDS, RUN_LETTERS = 13, 26
TERMS = 1 << 14
RANK, OVERSAMPLE, ROUNDS = 128, 16, 2
FIT_PASSAGES = 20_000
ITEM_WEIGHT = 4.0
#: Steps between item passages, in words and in letters.
STRIDE_WORDS, STRIDE_LETTERS = 3, 4
#: Cosine from which an item passage is a candidate, and that of a list's centre from which its passages are looked at.
LEAST_COSINE, LIST_COSINE = 0.4, 0.1
PARAPHRASE_SHARE, PARAPHRASE_ANSWER = 0.6, 0.5
BLOCK = 20_000
#: Items of the query set that the driver holds; more is an error.
MOST_ITEMS = 200_000
#: Documents that a task searches at a time.
TOGETHER = 256
SEED = 9

_WORD = re.compile(r"[^\W_]+")
#: Factor of the polynomial hash of terms, odd, so that it has an inverse.
_FACTOR = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: letter or digit, of an alphabet (its letters make words in a stream of letters), Han."""
    every = np.frombuffer("".join(map(chr, range(0xD800))).encode("utf-32-le"), np.uint32)
    known = np.zeros(0x110000, bool)
    known[every] = [chr(c).isalnum() for c in range(0xD800)]
    known[0xE000:] = [chr(c).isalnum() for c in range(0xE000, 0x110000)]
    alphabet, han = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for lo, hi in ((0x30, 0x3A), (0x61, 0x7B), (0xE0, 0x250), (0x430, 0x500)):
        alphabet[lo:hi] = True
    han[0x3400:0xA000] = True
    return known, alphabet, han


_grown: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the factor and of its inverse, modulo 2 ** 64; a task keeps the longest it needed."""
    if not _grown or len(_grown[0][0]) < n:
        size = 1 << max(12, n.bit_length())
        up, down = np.full(size, _FACTOR, np.uint64), np.full(size, pow(_FACTOR, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _grown[:] = [(np.cumprod(up), np.cumprod(down))]
    return _grown[0]


def _term_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash buckets of the strings between positions of an array of characters, whatever stands around them."""
    up, down = _powers(len(codes) + 1)
    sums = np.append(np.uint64(0), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)]))
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) & (TERMS - 1)


def normal(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


class Passages:
    """Passages of one text: by words, or by letters, as (start, end) over a stream of them, with the terms that begin in it."""

    __slots__ = ("by_letters", "at", "terms", "starts", "ends", "n", "_codes", "_from", "_to", "_set")

    def __init__(self, by_letters: bool, codes: np.ndarray, begin: np.ndarray | None, end: np.ndarray | None, at: np.ndarray, terms: np.ndarray, n: int, size: int, stride: int):
        self.by_letters, self._codes, self._from, self._to = by_letters, codes, begin, end
        self.at, self.terms, self.n = at, terms, n
        self.starts = np.arange(0, max(1, n - size + stride), stride) if n else np.zeros(0, np.int64)
        self.ends = np.minimum(self.starts + size, n)
        self._set: frozenset | None = None

    def piece(self, lo: int = 0, hi: int | None = None) -> list[str] | str:
        """Words, or letters, of a part of the stream."""
        hi = self.n if hi is None else hi
        if self.by_letters:
            return self._codes[lo:hi].tobytes().decode("utf-32-le", "replace")
        if hi <= lo:
            return []
        first, last = int(self._from[lo]), int(self._to[hi - 1])
        return _WORD.findall(self._codes[first:last].tobytes().decode("utf-32-le", "replace"))

    @property
    def stream(self) -> list[str] | str:
        return self.piece()

    def term_set(self) -> frozenset:
        if self._set is None:
            self._set = frozenset(self.terms.tolist())
        return self._set

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Term positions of every passage."""
        return np.searchsorted(self.at, self.starts), np.searchsorted(self.at, self.ends)


#: Characters that are cut up at once; a text is never parted.
TOGETHER_CHARS = 1 << 20


def _groups(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Numbered normal texts in groups of bounded size; texts without anything are left out."""
    group: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        if text:
            t = normal(text)
            if group and size + len(t) > TOGETHER_CHARS:
                yield group
                group, size = [], 0
            group.append((i, t))
            size += len(t)
    if group:
        yield group


def cut_up(texts: list[str | None], words: tuple[int, int] | None, letters: tuple[int, int] | None, han_only: bool = True) -> Iterator[tuple[int, Passages]]:
    """(text number, passages) of texts by words and by letters, each given as (size, stride); by letters only texts that hold Han, unless told otherwise."""
    known, alphabet, han = _classes()
    for group in _groups(texts):
        raw = np.frombuffer("\n".join(t for _, t in group).encode("utf-32-le", "replace"), np.uint32)
        sizes = np.array([len(t) for _, t in group])
        begin = np.cumsum(sizes + 1) - sizes - 1
        end = begin + sizes
        inside = known[raw]
        if words:
            before = np.append(False, inside[:-1])
            starts = np.flatnonzero(inside & ~before)
            ends = np.flatnonzero(np.append(before[1:] & ~inside[1:], inside[-1:])) + 1 if len(raw) else starts
            terms = _term_hashes(raw, starts, ends)
            lo, hi = np.searchsorted(starts, begin), np.searchsorted(starts, end)
            for (i, _), a, b in zip(group, lo.tolist(), hi.tolist()):
                if b > a:
                    yield i, Passages(False, raw, starts[a:b], ends[a:b], np.arange(b - a), terms[a:b], b - a, *words)
        if letters:
            is_han = han[raw]
            taken = np.logical_or.reduceat(is_han, np.minimum(begin, len(raw) - 1)) & (sizes > 0) if han_only else sizes > 0
            if not taken.any():
                continue
            whole = np.flatnonzero(inside & np.repeat(taken, np.append(sizes[:-1] + 1, sizes[-1])))
            if not len(whole):
                continue
            stream = raw[whole]
            lo, hi = np.searchsorted(whole, begin), np.searchsorted(whole, end)
            first = np.zeros(len(stream), bool)
            first[lo[hi > lo]] = True
            word = alphabet[stream]
            # a term starts at its first letter: words of alphabets whole, other letters as pairs
            starts = np.flatnonzero(~word | first | ~np.append(False, word[:-1]))
            length = np.diff(np.append(starts, len(stream)))
            pair = (length == 1) & np.append(False, length[:-1] == 1) & ~first[starts]
            terms = _term_hashes(stream, starts - pair, starts + length)
            at_lo, at_hi = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
            for k, (i, _) in enumerate(group):
                if hi[k] > lo[k]:
                    yield i, Passages(True, stream[lo[k] : hi[k]], None, None, starts[at_lo[k] : at_hi[k]] - lo[k], terms[at_lo[k] : at_hi[k]], int(hi[k] - lo[k]), *letters)


def document_passages(texts: list[str | None]) -> Iterator[tuple[int, Passages]]:
    return cut_up(texts, (2 * RUN_WORDS, RUN_WORDS), (2 * RUN_LETTERS, RUN_LETTERS))


def item_passages(text: str | None, lang: str | None) -> Passages | None:
    by_letters = (lang or "").lower().startswith(("zh", "chinese", "zho"))
    held = cut_up([text], None, (RUN_LETTERS, STRIDE_LETTERS), False) if by_letters else cut_up([text], (RUN_WORDS, STRIDE_WORDS), None)
    return next((p for _, p in held), None)


def _vectors(p: Passages, table: np.ndarray) -> np.ndarray:
    """Sums of the terms' rows over every passage, by running sums."""
    if not len(p.terms):
        return np.zeros((len(p.starts), table.shape[1]), np.float32)
    total = np.zeros((len(p.terms) + 1, table.shape[1]), np.float32)
    np.cumsum(table[p.terms], axis=0, out=total[1:])
    lo, hi = p.spans()
    return total[hi] - total[lo]


class Windows:
    """All passages of several texts: their terms in one array, where each passage begins and ends, and whose it is."""

    def __init__(self, passages: list[Passages], stride: int):
        starts = [p.starts for p in passages]
        counts = np.array([len(x) for x in starts])
        self.owner = np.repeat(np.arange(len(passages)), counts)
        self.window = np.arange(len(self.owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        edges = [np.searchsorted(p.at, np.append(x, x[-1] + stride)) for p, x in zip(passages, starts)]
        sizes = np.array([len(p.terms) for p in passages])
        offsets = np.cumsum(sizes) - sizes
        self.terms = np.concatenate([p.terms for p in passages])
        self._from = np.concatenate([e + o for e, o in zip(edges, offsets)])
        self._to = np.concatenate([np.append(e[1:], n) + o for e, n, o in zip(edges, sizes, offsets)])
        # a passage is two neighbouring steps; each text has one step more than passages
        self._step = np.arange(len(self.owner)) + self.owner
        self.first, self.last = self._from[self._step], self._to[self._step + 1]

    def vectors(self, table: np.ndarray) -> np.ndarray:
        """Unit sums of the terms' rows over every passage, each step summed once."""
        steps = np.zeros((len(self._from), table.shape[1]), np.float32)
        for k in range(int((self._to - self._from).max())):
            at = self._from + k
            inside = at < self._to
            steps[inside] += table[self.terms[at[inside]]]
        return _unit(steps[self._step] + steps[self._step + 1])

    def wide(self, rows: np.ndarray, width: int, fill: int) -> np.ndarray:
        """Terms of some passages as rows of ``width``, short ones filled up."""
        at = self.first[rows][:, None] + np.arange(width)
        return np.where(at < self.last[rows][:, None], self.terms[np.minimum(at, len(self.terms) - 1)], fill)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


# ---- document frequencies and the latent basis ---------------------------------------------


def inverse_frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """IDF of every hashed term over all documents, and the number of passages; a fixed number of counts reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(TERMS + 2, np.int64)
        for batch in batches:
            df[TERMS] += batch.num_rows
            for at in range(0, batch.num_rows, TOGETHER):
                keys = []
                for i, p in document_passages(strings(batch.slice(at, TOGETHER).column(0))):
                    keys.append(p.terms + i * TERMS)
                    df[TERMS + 1] += len(p.starts)
                if keys:
                    df[:TERMS] += np.bincount(np.unique(np.concatenate(keys)) & (TERMS - 1), minlength=TERMS)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(df[hit])], names=["term", "n"])

    zero = F.lit(0).cast("bigint")
    counts = map_arrow(spread(documents.select("text")), run, documents.select(zero.alias("term"), zero.alias("n")).schema)
    rows = counts.groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most TERMS + 2 rows
    df = np.zeros(TERMS + 2)
    for r in rows:
        df[r.term] = r.n
    return np.log((1 + df[TERMS]) / (1 + df[:TERMS])) + 0.1, int(df[TERMS + 1])


def _products(passages: list, weights: list, basis: np.ndarray, idf: np.ndarray, out: np.ndarray) -> None:
    """Add A'(A basis) of some passages to ``out``, through the dense matrix over the terms that they have."""
    lengths = [len(t) for t in passages]
    if not sum(lengths):
        return
    terms, place = np.unique(np.concatenate([np.asarray(t, np.int64) for t in passages]), return_inverse=True)
    x = np.zeros((len(passages), len(terms)), np.float32)
    np.add.at(x, (np.repeat(np.arange(len(passages)), lengths), place), 1.0)
    x *= idf[terms].astype(np.float32)
    x *= (np.array(weights) / np.maximum(np.linalg.norm(x, axis=1), 1e-9))[:, None].astype(np.float32)
    out[terms] += x.T @ (x @ basis[terms])


def _gram(sample: DataFrame, basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A'(A basis) of the sampled passages; executors multiply and add, the driver gets one matrix."""
    blocks, width = 16, basis.shape[1]
    rows = TERMS // blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((TERMS, width), np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                _products(part.column(0).to_pylist(), part.column(1).to_pylist(), basis, idf, out)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([out[i * rows : (i + 1) * rows].astype(np.float32).tobytes() for i in range(blocks)], pa.binary())], names=["block", "part"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": part.block.iloc[:1], "part": [np.sum([np.frombuffer(b, np.float32) for b in part.part], axis=0, dtype=np.float64).astype(np.float32).tobytes()]})

    parts = map_arrow(sample, run, sample.select(F.lit(0).alias("block"), F.lit(b"").alias("part")).schema)
    summed = parts.groupBy("block").applyInPandas(add, "block int, part binary").collect()
    out = np.zeros((blocks, rows * width), np.float64)
    for r in summed:
        out[r.block] = np.frombuffer(bytes(r.part), np.float32)
    return out.reshape(TERMS, width)


def latent_basis(documents: DataFrame, items: list[tuple], idf: np.ndarray, n_passages: int, rank: int = RANK) -> np.ndarray:
    """TERMS x rank right singular vectors of the passage matrix, by randomised subspace iteration."""
    spark = documents.sparkSession
    held = []
    for _, lang, text in items:
        p = item_passages(text, lang)
        if p is not None:
            held += [(p.terms[a:b].tolist(), ITEM_WEIGHT) for a, b in zip(*p.spans()) if b > a]
    most = FIT_PASSAGES // 100

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in strings(batch.column(0)):
                spans = [(p.terms, a, b) for _, p in document_passages([s]) for a, b in zip(*p.spans()) if b > a]
                spans = spans[:: -(-len(spans) // most) or 1]
                yield pa.RecordBatch.from_arrays([pa.array([t[a:b].tolist() for t, a, b in spans], pa.list_(pa.int64())), pa.array([1.0] * len(spans), pa.float64())], names=["terms", "weight"])

    schema = documents.select(F.array(F.lit(0).cast("bigint")).alias("terms"), F.lit(1.0).alias("weight")).schema
    # a hash threshold: no text is sorted or moved to choose the sample
    share = min(1.0, FIT_PASSAGES / max(1, n_passages))
    few = documents.select("text").filter(F.length("text") > 0).filter(F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))
    corpus = map_arrow(few, sampled, schema)
    sample = corpus.unionByName(spark.createDataFrame(held, schema)) if held else corpus
    sample = cut(sample.repartition(8))
    rng = np.random.default_rng(SEED)
    basis = np.linalg.qr(rng.standard_normal((TERMS, rank + OVERSAMPLE)))[0].astype(np.float32)
    for _ in range(ROUNDS):
        basis = np.linalg.qr(_gram(sample, basis, idf))[0].astype(np.float32)
    small = basis.T @ _gram(sample, basis, idf)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (basis @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


# ---- search and checks ------------------------------------------------------------------------


def common_subsequence(a: list[str] | str, b: list[str] | str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        match = row & where.get(y, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


class InvertedFile:
    """Unit vectors in lists around the centres of a spherical k-means."""

    def __init__(self, vectors: np.ndarray, rounds: int = 8):
        n = len(vectors)
        centres = vectors[np.random.default_rng(SEED).choice(n, min(n, int(2 * n**0.5) + 1), replace=False)]
        for _ in range(rounds):
            sums = np.zeros_like(centres)
            np.add.at(sums, (vectors @ centres.T).argmax(axis=1), vectors)
            empty = ~sums.any(axis=1)
            sums[empty] = centres[empty]
            centres = _unit(sums)
        of = (vectors @ centres.T).argmax(axis=1)
        self.centres = np.ascontiguousarray(centres.T)
        self.lists = [np.flatnonzero(of == k) for k in range(len(centres))]
        self.vectors = [np.ascontiguousarray(vectors[ids].T) for ids in self.lists]

    def near(self, queries: np.ndarray, least: float = LEAST_COSINE, to_list: float = LIST_COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, cosine) of the pairs from ``least`` on, within the lists from ``to_list`` on."""
        met = queries @ self.centres >= to_list
        out: list[tuple] = []
        for k, ids in enumerate(self.lists):
            rows = np.flatnonzero(met[:, k])
            if len(rows) and len(ids):
                cosine = queries[rows] @ self.vectors[k]
                q, v = np.nonzero(cosine >= least)
                out.append((rows[q], ids[v], cosine[q, v]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        return tuple(np.concatenate(part) for part in zip(*out))


class ItemIndex:
    """Latent vectors of a block of item passages in inverted files, and what the checks need of their items."""

    def __init__(self, items: list[tuple], table: np.ndarray, idf: np.ndarray):
        grouped: dict[bool, list] = {False: [], True: []}
        of: dict[bool, list] = {False: [], True: []}
        #: By item: the terms of its passages, by their number in the file.
        self.passages: list[dict] = []
        self.ids, self.streams, self.rare, self.grams, self.pairs = [], [], [], [], []
        self.has = np.zeros((len(items), TERMS + 1), bool)
        for item, lang, text in items:
            p = item_passages(text, lang)
            if p is None or not len(p.terms):
                continue
            at, run = len(self.ids), RUN_LETTERS if p.by_letters else RUN_WORDS
            self.ids.append(item)
            grouped[p.by_letters].append(_vectors(p, table))
            stream = p.stream
            self.streams.append(stream)
            order = np.argsort(-idf[p.terms], kind="stable")[: max(3, len(p.terms) // 5)]
            self.rare.append(set(p.terms[order].tolist()))
            self.grams.append({tuple(stream[k : k + run]) for k in range(len(stream) - run + 1)})
            run_of = p.terms.tolist()
            self.pairs.append(frozenset(zip(stream, stream[1:])) if p.by_letters else frozenset(zip(run_of, run_of[1:])))
            self.passages.append({len(of[p.by_letters]) + k: p.terms[a:b].tolist() for k, (a, b) in enumerate(zip(*p.spans()))})
            of[p.by_letters] += [at] * len(p.starts)
            self.has[at, p.terms] = True
        self.least = PARAPHRASE_SHARE * np.array([min(RUN_WORDS, len(x)) for x in self.streams])
        self.kinds: dict[bool, tuple] = {}
        for kind, held in grouped.items():
            if held:
                self.kinds[kind] = (InvertedFile(_unit(np.vstack(held))), np.array(of[kind]))

    def candidates(self, passages: list[Passages], table: np.ndarray, kind: bool) -> Iterator[tuple[int, int, int, int, float]]:
        """(passages, window, item, item passage, cosine): each window's items above the cosine, with their best passage."""
        index, item_of = self.kinds[kind]
        every = Windows(passages, RUN_LETTERS if kind else RUN_WORDS)
        query, vector, cosine = index.near(every.vectors(table))
        item = item_of[vector]
        order = np.lexsort((vector, -cosine, item, query))
        query, vector, cosine, item = query[order], vector[order], cosine[order], item[order]
        first = np.append(True, (query[1:] != query[:-1]) | (item[1:] != item[:-1])) if len(query) else np.zeros(0, bool)
        query, vector, cosine, item = query[first], vector[first], cosine[first], item[first]
        if not kind and len(query):
            # a common subsequence holds no more words than the passage has of the item's
            enough = self.has[item[:, None], every.wide(query, 2 * RUN_WORDS, TERMS)].sum(axis=1) >= self.least[item]
            query, vector, cosine, item = query[enough], vector[enough], cosine[enough], item[enough]
        yield from zip(every.owner[query].tolist(), every.window[query].tolist(), item.tolist(), vector.tolist(), cosine.tolist())

    def check(self, p: Passages, window: int, item: int, vector: int) -> tuple[str, float, float] | None:
        """(kind, share of the item passage in common, share of its rare terms) of a candidate that is a leak.

        Subsequences are looked for only where enough neighbouring words or letters (terms, for a
        paraphrase) agree for one.
        """
        run = RUN_LETTERS if p.by_letters else RUN_WORDS
        first, last, stream = int(p.starts[window]), int(p.ends[window]), self.streams[item]
        near = p.piece(first, last) if p.by_letters else p.terms[first:last].tolist()
        agree = sum(map(self.pairs[item].__contains__, zip(near, near[1:]))) + 1
        piece = p.piece(first, last) if agree >= run else ()
        if agree >= run and common_subsequence(stream, piece) >= run and any(tuple(piece[k : k + run]) in self.grams[item] for k in range(len(piece) - run + 1)):
            return "exact", 1.0, 1.0
        answer = len(self.rare[item] & p.term_set()) / len(self.rare[item])
        if answer < PARAPHRASE_ANSWER:
            return None
        lo, hi = np.searchsorted(p.at, (p.starts[window], p.ends[window]))
        mine, asked = p.terms[lo:hi].tolist(), self.passages[item][vector]
        least = PARAPHRASE_SHARE * len(asked)
        if sum(map(frozenset(mine).__contains__, asked)) < least:
            return None
        share = common_subsequence(asked, mine) / max(1, len(asked))
        return ("paraphrase", share, answer) if share >= PARAPHRASE_SHARE else None

    def leaks(self, texts: list[str | None], table: np.ndarray) -> dict:
        """(text number, item) -> (kind, cosine, share, answer), the surest finding of each."""
        out: dict = {}
        held: dict[bool, list] = {kind: [] for kind in self.kinds}
        for i, p in document_passages(texts):
            if p.by_letters in held and len(p.terms):
                held[p.by_letters].append((i, p))
        for kind, each in held.items():
            if not each:
                continue
            passages = [p for _, p in each]
            for o, window, item, vector, cosine in self.candidates(passages, table, kind):
                key = (each[o][0], self.ids[item])
                if out.get(key, ("",))[0] == "exact" and out[key][1] >= cosine:
                    continue
                found = self.check(passages[o], window, item, vector)
                if found and (found[0] == "exact", cosine) > (out.get(key, ("",))[0] == "exact", out.get(key, ("", 0.0))[1]):
                    out[key] = (found[0], cosine, *found[1:])
        return out


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, kind, cosine, shared, answer) of every document and leaked item.

    The items are the query set: they are read to the driver (a held-out benchmark, thousands of
    rows) and walked in blocks; each block is one pass over the documents.
    """
    ship(documents.sparkSession)
    held = [(r.item_id, r.lang, r.text) for r in items.select("item_id", "lang", "text").filter(F.length("text") > 0).dropDuplicates(["item_id"]).limit(MOST_ITEMS + 1).collect()]
    if len(held) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items; divide the query set")
    held.sort(key=lambda r: (r[0] is None, r[0]))
    zero = F.lit(0.0)
    schema = documents.select("doc_id").join(items.select("item_id"), F.lit(True)).select("doc_id", "item_id", F.lit("").alias("kind"), zero.alias("cosine"), zero.alias("shared"), zero.alias("answer")).schema
    if not held:
        return documents.sparkSession.createDataFrame([], schema)
    idf, n_passages = inverse_frequencies(documents)
    table = (latent_basis(documents, held, idf, n_passages) * idf[:, None]).astype(np.float32)
    kinds = {f.name: pa.int64() if f.dataType.simpleString() == "bigint" else None for f in schema}

    def search(block: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(block, table, idf)
            for batch in batches:
                for start in range(0, batch.num_rows, TOGETHER):
                    part = batch.slice(start, TOGETHER)
                    found = index.leaks(strings(part.column(1)), table)
                    at, rows = [i for i, _ in found], [(item, *how) for (_, item), how in found.items()]
                    columns = [[f[k] for f in rows] for k in range(5)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], kinds["item_id"]), pa.array(columns[1], pa.string()), *[pa.array(c, pa.float64()) for c in columns[2:]]], names=[f.name for f in schema])

        return map_arrow(spread(documents.select("doc_id", "text")), run, schema)

    out, block, size = None, [], 0
    for row in [*held, None]:
        if row is None or size > BLOCK:
            part = search(block)
            out = part if out is None else out.unionByName(part)
            block, size = [], 0
        if row is not None:
            block.append(row)
            size += max(1, len(row[2]) // 8)
    return out
