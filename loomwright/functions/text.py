"""Text measures and content assessment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: an address with a dotted host.
EMAIL = r"(?i)[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+"
#: White space of the assessment, and its thresholds.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
LEAST_ELEMENTS, MOST_REPEATED, MOST_REPEATED_BYTES = 4, 0.30, 0.20
LEAST_WORDS, MOST_TRIGRAM, MOST_EIGHTGRAM = 50, 0.18, 0.12
PARAGRAPH = r"\n[ \t\r]*\n+"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def has_email(text: Column) -> Column:
    return text.rlike(EMAIL)


def elements(text: Column, pattern: str) -> Column:
    """Pieces between matches, their white space collapsed, empty ones dropped."""
    squeezed = F.transform(F.split(text, pattern), lambda x: F.trim(F.regexp_replace(x, SPACE, " ")))
    return F.filter(squeezed, lambda x: x != "")


def lines(text: Column) -> Column:
    return elements(text, "\n")


def paragraphs(text: Column) -> Column:
    return elements(F.trim(text), PARAGRAPH)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and numbers."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _bytes(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + F.octet_length(x))


def _once(value: Column, body) -> Column:
    """``body(value)`` with the value bound to a lambda's variable, so that it is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_structure(items: Column, text: Column) -> Column:
    """Whether too many elements, or too many of the text's bytes, repeat an earlier element."""
    return _once(items, lambda a: _once(F.array_distinct(a), lambda d: _repeats(a, d, text)))


def _repeats(items: Column, distinct: Column, text: Column) -> Column:
    share = (F.size(items) - F.size(distinct)) / F.size(items)
    bytes_share = (_bytes(items) - _bytes(distinct)) / F.greatest(F.octet_length(text), F.lit(1))
    return F.when(F.size(items) >= LEAST_ELEMENTS, (share > MOST_REPEATED) | (bytes_share > MOST_REPEATED_BYTES)).otherwise(F.lit(False))


def boilerplate(text: Column) -> Column:
    return repeated_structure(lines(text), text) | repeated_structure(paragraphs(text), text)


def word_ngrams(items: Column, width: int) -> Column:
    """Runs of ``width`` words, joined; empty where there are fewer words."""

    def runs(a: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(a) - width + 1)
        return F.when(F.size(a) >= width, F.transform(at, lambda i: F.array_join(F.slice(a, i, width), "\x1f"))).otherwise(F.array().cast("array<string>"))

    return _once(items, runs)


def top_ngram_fraction(text: Column, width: int) -> Column:
    """Share of a text's words in its most frequent n-gram; null where there are fewer words. Counted within the row: nothing is exploded."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(items) -> float | None:
            items = [] if items is None else list(items)
            if len(items) < width:
                return None
            counts: dict[tuple, int] = {}
            for gram in zip(*[items[i:] for i in range(width)]):
                counts[gram] = counts.get(gram, 0) + 1
            return max(counts.values()) * width / len(items)

        for series in batches:
            yield series.map(one).astype("float64")

    return F.pandas_udf(run, "double")(words(text))


def _repeated_words(items: list[str], width: int) -> int:
    """Words in n-grams met before, a repeated n-gram skipping past itself."""
    seen: set[tuple] = set()
    at = total = 0
    while at + width <= len(items):
        gram = tuple(items[at : at + width])
        again = gram in seen
        seen.add(gram)
        total += width * again
        at += width if again else 1
    return total


def _repetitive(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def judge(items) -> bool:
        n = 0 if items is None else len(items)
        if n < LEAST_WORDS:
            return False
        items = list(items)
        counts: dict[tuple, int] = {}
        for gram in zip(items, items[1:], items[2:]):
            counts[gram] = counts.get(gram, 0) + 1
        return max(counts.values()) * 3 / n > MOST_TRIGRAM or _repeated_words(items, 8) / n > MOST_EIGHTGRAM

    for series in batches:
        yield series.map(judge)


def repetitive(text: Column) -> Column:
    """Whether one 3-gram, or repeated 8-grams, make up too much of a text of 50 words or more.

    The greedy skip past a repeated 8-gram is sequential, so it runs as an Arrow function over
    the word arrays that the JVM made.
    """
    return F.pandas_udf(_repetitive, "boolean")(words(text))


def truncate_utf8(text: Column, limit: Column) -> Column:
    """The longest prefix of whole characters within a number of bytes."""
    head = F.substring(F.encode(text, "UTF-8"), F.lit(1), limit)
    cut = lambda n: F.try_validate_utf8(F.substring(head, F.lit(1), F.length(head) - n).cast("string"))
    return F.coalesce(cut(0), cut(1), cut(2), cut(3))
