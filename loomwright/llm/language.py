"""Language of documents and of their segments by rank-order n-gram profiles.

A profile is a language's most frequent character n-grams (1 to 3) in order of frequency. A
segment's n-grams are ranked the same way; its out-of-place distance to a profile is the sum of
the rank differences, an absent n-gram costing the whole profile length. Segments are sentences
(terminators, line feeds, and spaces between spaceless letters). Where a segment holds letters
of a non-Latin script, its Latin letters (names, codes) don't vote. A document's language is the
one of the smallest total distance; a segment departs from it only by a clear margin, so that
short or name-heavy segments follow their document.

The whole of it runs as numpy over batches: dense tables map characters to n-gram ids, one
bincount and one sort rank a block of segments.

Defined results: null, empty and letterless texts have no language and score 0; repeated row
ids are reported once; extra columns are ignored. Profiles are fitted on at most
``MAX_SAMPLES`` labelled rows of each label; without any, nothing has a language.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.runtime import map_arrow, slices, spread, strings

#: Samples that profiles are fitted on, of each label, and labels.
MAX_SAMPLES, MAX_LABELS = 200, 200
#: N-grams of a profile.
PROFILE = 400
#: Letters that a row needs to be judged.
LEAST_LETTERS = 12
#: A language counts in a text from this share of the letters on, in hundredths.
LEAST_SHARE = 10
#: Segments ranked at once.
BLOCK = 400
#: By so much a segment's mean distance must be smaller to leave its document's language, times its n-grams.
MARGIN = 6.0

#: Names and ISO 639 codes of the ten languages.
LANGUAGE_NAMES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german", "deutsch"), "fr": ("fra", "fre", "french", "français"), "es": ("spa", "spanish", "español", "castilian"),
    "pt": ("por", "portuguese", "português"), "ru": ("rus", "russian", "русский"), "zh": ("zho", "chi", "cmn", "chinese", "mandarin", "中文"),
    "ja": ("jpn", "japanese", "日本語"), "hi": ("hin", "hindi", "हिन्दी"), "th": ("tha", "thai", "ไทย"),
}
_BY_NAME = {n: code for code, names in LANGUAGE_NAMES.items() for n in (code, *names)}
_NO_LABEL = {"", "und", "unknown", "none", "null", "n/a"}


def normal_label(label: str | None) -> str | None:
    """ISO 639-1 code of a label, None without one, the label itself where it names another language."""
    s = (label or "").strip().lower()
    if s in _NO_LABEL:
        return None
    return _BY_NAME.get(s) or _BY_NAME.get(s.replace("_", "-").split("-")[0]) or s


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: class bits, lower case, script."""
    size = 0x110000
    kind, lower, script = np.zeros(size, np.uint8), np.arange(size, dtype=np.uint32), np.zeros(size, np.uint8)
    for c in range(0x30000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        category = unicodedata.category(ch)
        if category[0] == "L":
            kind[c] = 3  # letter, part of a word
            if category == "Lu":
                kind[c] |= 4
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
        elif category[0] == "M":
            kind[c] = 2  # mark, part of a word
        if c < 0x250 or 0x1E00 <= c < 0x1F00:
            script[c] = 1
        elif 0x370 <= c < 0x530:
            script[c] = 2
        elif 0x900 <= c < 0x980:
            script[c] = 3
        elif 0xE00 <= c < 0xE80:
            script[c] = 4
        elif 0x3040 <= c < 0x3100 or 0x3400 <= c < 0xA000 or 0x20000 <= c:
            script[c] = 5
        elif category[0] in "LM":
            script[c] = 6
    for c in ".!?…":
        kind[ord(c)] |= 8  # ends a sentence before a space
    for c in "。！？।॥\n":
        kind[ord(c)] |= 16  # ends a sentence
    for c in range(0x3001):
        if chr(c).isspace() and c != 10:
            kind[c] |= 32
    return kind, lower, script


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


class Segments:
    """A batch of texts as one array of characters, cut into segments."""

    def __init__(self, texts: list[str | None]):
        kind_of, lower_of, script_of = _characters()
        raw = _codes("\n".join((t or "").replace("\n", " ") for t in texts) + "\n")
        document_end = raw == 10
        raw = np.where(raw == 0x2029, 10, raw)
        kind, script = kind_of[raw], script_of[raw]
        space_next = np.append((kind[1:] & 32) | (raw[1:] == 10), True).astype(bool)
        stop = ((kind & 8) > 0) & space_next
        # no end after a single letter, nor before a small one: those are abbreviations
        in_word = (kind & 2) > 0
        stop[2:] &= ~((raw[2:] == 46) & in_word[1:-1] & ~in_word[:-2])
        stop[:-2] &= ~((raw[:-2] == 46) & (raw[1:-1] != 10) & ((kind[2:] & 5) == 1) & (script[2:] <= 2))
        cut = ((kind & 16) > 0) | stop
        thai = script == 4
        gap = (kind & 32) > 0
        cut[1:-1] |= gap[1:-1] & thai[:-2] & thai[2:]
        cut |= document_end
        self.document = np.cumsum(document_end) - document_end
        self.segment = np.cumsum(cut) - cut
        self.raw, self.kind, self.script = raw, kind, script
        self.n = int(self.segment[-1]) + 1 if len(raw) else 0
        self.doc_of = np.zeros(self.n, np.int64)
        self.doc_of[self.segment] = self.document
        starts = np.flatnonzero(np.append(True, cut[:-1]))
        doc_start = np.flatnonzero(np.append(True, document_end[:-1]))
        self.start = starts - doc_start[self.doc_of]
        self.end = np.append(starts[1:], len(raw)) - doc_start[self.doc_of]
        word = (kind & 2) > 0
        letter = (kind & 1) > 0
        self.letters = np.bincount(self.segment[letter], minlength=self.n)
        # non-Latin letters outvote Latin ones of their segment
        latin = np.bincount(self.segment[letter & (script == 1)], minlength=self.n)
        other = np.bincount(self.segment[word & (script > 1)], minlength=self.n)
        signs = np.bincount(self.segment[word & (script == 5)], minlength=self.n)
        foreign = other * 4 + signs * 12 >= latin
        # capitalised words are mostly names; they vote only where little else is left
        first = word & ~np.append(False, word[:-1])
        number = np.cumsum(first)
        capital = np.zeros(int(number[-1]) + 1 if len(number) else 1, bool)
        capital[number[first]] = (kind[first] & 4) > 0
        plain = word & ~capital[number]
        enough = np.bincount(self.segment[plain], minlength=self.n) >= 12
        vote = word & (~enough[self.segment] | plain) & ~((script == 1) & (foreign & (other > 0))[self.segment])
        self.sequence = np.where(vote, lower_of[raw], 0)


class Profiles:
    """Dense n-gram tables and the ranks of every language."""

    def __init__(self, samples: list[tuple[str, str]]):
        by: dict[str, list[str]] = {}
        for label, text in sorted(samples, key=lambda s: (str(s[0]), str(s[1]))):
            code = normal_label(label)
            if code and text:
                by.setdefault(code, []).append(text)
        self.languages = sorted(by)
        counts = {code: self._count(texts) for code, texts in by.items()}
        tops = {code: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]] for code, c in counts.items()}
        total: Counter = Counter()
        for code, c in counts.items():
            size = sum(c.values())
            for g in tops[code]:
                total[g] += c[g] / size
        grams = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))]
        number = {g: i + 1 for i, g in enumerate(grams)}  # frequent ones first: ties of rank fall that way
        self.size = len(grams) + 1
        self.rank = np.full((len(self.languages), self.size), PROFILE, np.int32)
        for k, code in enumerate(self.languages):
            for r, g in enumerate(tops[code]):
                self.rank[k, number[g]] = r
        # characters of three-grams come first, so that their cube stays small
        three = sorted({c for g in grams if len(g) == 3 for c in g if c})
        rest = sorted({c for g in grams for c in g if c} - set(three))
        self.alphabet = np.ones(0x110000, np.uint16)
        self.alphabet[0] = 0
        for i, c in enumerate([*three, *rest]):
            self.alphabet[c] = i + 2
        self.small, self.wide = len(three) + 2, len(three) + len(rest) + 2
        self.one = np.zeros(self.wide, np.int32)
        self.two = np.zeros(self.wide**2, np.int32)
        self.three = np.zeros(self.small**3, np.int32)
        for g, i in number.items():
            a = [int(self.alphabet[c]) if c else 0 for c in g]
            if len(a) == 1:
                self.one[a[0]] = i
            elif len(a) == 2:
                self.two[a[0] * self.wide + a[1]] = i
            else:
                self.three[(a[0] * self.small + a[1]) * self.small + a[2]] = i

    @staticmethod
    def _count(texts: list[str]) -> Counter:
        """N-grams of a language's samples; three-grams only of alphabets, where they are few."""
        out: Counter = Counter()
        for i in range(0, len(texts), 64):
            s = Segments(texts[i : i + 64]).sequence.tolist()
            for j in range(1, len(s) - 1):
                if s[j]:
                    out[(s[j],)] += 1
                    out[(s[j], s[j + 1])] += 1
                    if not s[j - 1]:
                        out[(0, s[j])] += 1
                    if s[j] < 0x530:
                        out[(s[j - 1], s[j], s[j + 1])] += 1
        return out

    def distances(self, batch: Segments) -> tuple[np.ndarray, np.ndarray]:
        """Mean out-of-place distance of every segment to every language, and the segment's distinct n-grams."""
        a = self.alphabet[batch.sequence].astype(np.int64)
        before, after = np.append(0, a[:-1]), np.append(a[1:], 0)
        on = a > 0
        ids = [np.where(on, self.one[a], 0), np.where(on, self.two[a * self.wide + after], 0), np.where(on & (before == 0), self.two[a], 0)]
        fits = on & (a < self.small) & (before < self.small) & (after < self.small)
        cube = np.where(fits, (before * self.small + a) * self.small + after, 0)
        ids.append(np.where(fits, self.three[cube], 0))
        distance = np.zeros((batch.n, len(self.languages)))
        distinct = np.zeros(batch.n, np.int64)
        edges = np.searchsorted(batch.segment, np.arange(0, batch.n + BLOCK, BLOCK))
        for k in range(len(edges) - 1):
            lo, hi, base = edges[k], edges[k + 1], k * BLOCK
            if lo == hi:
                continue
            segment = (batch.segment[lo:hi] - base) * self.size
            keys = np.concatenate([(segment + i[lo:hi])[i[lo:hi] > 0] for i in ids])
            if not len(keys):
                continue
            keys.sort()
            edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            hit, counts = keys[edge], np.diff(np.append(edge, len(keys)))
            seg = hit // self.size
            # frequent n-grams first within their segment; the sorted values hold all that is needed, so nothing is gathered
            order = (seg << 40) | ((65_535 - np.minimum(counts, 65_535)) << 20) | (hit - seg * self.size)
            order.sort()
            seg, gram = order >> 40, order & 0xFFFFF
            begin = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            which = seg[begin]
            n = np.diff(np.append(begin, len(seg)))
            rank = (np.arange(len(seg)) - np.repeat(begin, n)).astype(np.int32)
            off = self.rank[:, gram]
            off -= rank
            np.abs(off, out=off)
            np.minimum(off, PROFILE, out=off)
            if n.max() > PROFILE:
                off *= rank < PROFILE
                n = np.minimum(n, PROFILE)
            sums = np.add.reduceat(off, begin, axis=1)
            distance[base + which] = (sums / (n * PROFILE)).T
            distinct[base + which] = n
        return distance, distinct


class Judged:
    """Languages of the segments and documents of a batch."""

    def __init__(self, profiles: Profiles, texts: list[str | None]):
        b = self.segments = Segments(texts)
        docs = len(texts)
        if not profiles.languages:
            self._unjudged(docs)
            return
        distance, distinct = profiles.distances(b)
        mass = distance * distinct[:, None]
        total = np.zeros((docs, len(profiles.languages)))
        np.add.at(total, b.doc_of, mass)
        grams = np.bincount(b.doc_of, weights=distinct, minlength=docs)
        main = np.argmin(total, axis=1)
        own = np.argmin(distance, axis=1)
        gain = (distance[np.arange(b.n), main[b.doc_of]] - distance[np.arange(b.n), own]) * distinct
        leaves = (distinct > 0) & (gain > MARGIN)
        language = np.where(leaves, own, main[b.doc_of])
        letters = np.zeros((docs, len(profiles.languages)), np.int64)
        np.add.at(letters, (b.doc_of, language), b.letters)
        self.letters, self.sum = letters, letters.sum(axis=1)
        share = letters * 100 >= LEAST_SHARE * self.sum[:, None]
        self.counts = share & (letters > 0) & (grams > 0)[:, None]
        self.codes = profiles.languages
        self.known = grams > 0
        self.main = np.where(self.known, np.argmax(letters, axis=1), -1)
        ordered = np.sort(total, axis=1)
        clear = 1 - ordered[:, 0] / np.maximum(ordered[:, 1], 1e-9) if total.shape[1] > 1 else np.ones(docs)
        purity = letters.max(axis=1, initial=0) / np.maximum(self.sum, 1)
        self.score = np.where(self.known, np.clip(np.round(1000 * purity * np.minimum(1, 2.5 * clear)), 0, 1000), 0).astype(np.int32)
        near = np.sort(distance, axis=1)
        margin = 1 - near[:, 0] / np.maximum(near[:, 1], 1e-9) if total.shape[1] > 1 else np.ones(b.n)
        held = np.where(leaves | (own == main[b.doc_of]), margin, 0.1)
        self.segment_language = np.where(grams[b.doc_of] > 0, language, -1)
        self.segment_score = np.where(self.segment_language >= 0, np.clip(np.round(1000 * np.minimum(1, 2.5 * held)), 0, 1000), 0).astype(np.int32)


    def _unjudged(self, docs: int) -> None:
        """Without profiles nothing has a language."""
        self.codes, self.letters = [], np.zeros((docs, 0), np.int64)
        self.sum, self.counts = np.bincount(self.segments.doc_of, weights=self.segments.letters, minlength=docs).astype(np.int64), np.zeros((docs, 0), bool)
        self.main, self.score = np.full(docs, -1), np.zeros(docs, np.int32)
        self.segment_language, self.segment_score = np.full(self.segments.n, -1), np.zeros(self.segments.n, np.int32)


def fit(samples: DataFrame, label: str = "language", text: str = "text", order: str = "sample_id") -> Profiles:
    """Profiles of at most ``MAX_SAMPLES`` labelled rows of each label, the first by ``order``; ``MAX_LABELS`` labels at most."""
    first = F.row_number().over(Window.partitionBy(label).orderBy(order, text))
    known = samples.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(label, text, order)
    rows = known.withColumn("__n", first).filter(F.col("__n") <= MAX_SAMPLES).select(label, text).limit(MAX_LABELS * MAX_SAMPLES + 1).collect()
    if len(rows) > MAX_LABELS * MAX_SAMPLES:
        raise ValueError(f"more than {MAX_LABELS} labels of {MAX_SAMPLES} samples")
    return Profiles([(r[0], r[1]) for r in rows])


def _halves(batch: pa.RecordBatch, rows: int = 1_500) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that fit a task's memory: a character takes about a hundred bytes of arrays."""
    yield from slices(batch, 1, rows)


def documents(rows: DataFrame, profiles: Profiles, key: str = "row_id", text: str = "text", label: str = "language") -> DataFrame:
    """A row an input row: (key, label, detected, score, languages, letters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _halves(batch):
                j = Judged(profiles, strings(part.column(1)))
                found = [[j.codes[k] for k in np.flatnonzero(c)] for c in j.counts]
                detected = [j.codes[m] if m >= 0 else None for m in j.main]
                labels = [normal_label(s) for s in strings(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(labels, pa.string()), pa.array(detected, pa.string()), pa.array(j.score, pa.int32()), pa.array(found, pa.list_(pa.string())), pa.array(j.sum, pa.int64())], names=[key, "label", "detected", "score", "languages", "letters"])

    schema = rows.select(key, F.lit("").alias("label"), F.lit("").alias("detected"), F.lit(0).alias("score"), F.array(F.lit("")).alias("languages"), F.lit(0).cast("bigint").alias("letters")).schema
    return map_arrow(spread(rows.select(key, text, label)), run, schema)


def segments(rows: DataFrame, profiles: Profiles, key: str = "row_id", text: str = "text") -> DataFrame:
    """A row a run of segments of one language: (key, start_char, end_char, language, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _halves(batch):
                j = Judged(profiles, strings(part.column(1)))
                b = j.segments
                doc, lang = b.doc_of, j.segment_language
                new = np.append(True, (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])) if b.n else np.zeros(0, bool)
                at = np.flatnonzero(new)
                last = np.append(at[1:], b.n) - 1 if len(at) else at
                keep = lang[at] >= 0
                at, last = at[keep], last[keep]
                weight = np.maximum(b.letters, 1)
                total, size = np.append(0, np.cumsum(j.segment_score * weight)), np.append(0, np.cumsum(weight))
                score = (total[last + 1] - total[at]) // (size[last + 1] - size[at])
                # the line feed that ends a document is not the document's
                end = b.end[last] - (np.append(doc[1:], -1)[last] != doc[last])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[at])), pa.array(b.start[at], pa.int64()), pa.array(end, pa.int64()), pa.array([j.codes[k] for k in lang[at]], pa.string()), pa.array(score, pa.int32())], names=[key, "start_char", "end_char", "language", "score"])

    zero = F.lit(0).cast("bigint")
    schema = rows.select(key, zero.alias("start_char"), zero.alias("end_char"), F.lit("").alias("language"), F.lit(0).alias("score")).schema
    return map_arrow(spread(rows.select(key, text)), run, schema).distinct()


def wrong_labels(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """(row_id, language): rows without a label, with another language's, or in several languages; a row a language."""
    judged = documents(rows, fit(samples)).filter((F.col("letters") >= LEAST_LETTERS) & (F.size("languages") > 0))
    wrong = judged.filter(F.col("label").isNull() | (F.size("languages") > 1) | ~F.array_contains("languages", F.col("label")))
    return wrong.select("row_id", F.explode("languages").alias("language")).distinct()
