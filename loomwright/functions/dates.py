"""Dates of four lexical precisions as half-open UTC intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:\d{2})$"


def _at(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))


def interval(value: Column) -> Column:
    """struct<start, stop>: YYYY, YYYY-MM, YYYY-MM-DD up to the next one, RFC 3339 as an instant; null otherwise.

    ``stop`` is exclusive but for instants, where both ends are the instant itself.
    """
    year = _at(F.concat(value, F.lit("-01-01")))
    month = _at(F.concat(value, F.lit("-01")))
    day = _at(value)
    moment = F.try_to_timestamp(value)
    pair = lambda a, b: F.when(a.isNotNull(), F.struct(a.alias("start"), b.alias("stop"), F.lit(False).alias("instant")))
    return (
        F.when(value.rlike(r"^\d{4}$"), pair(year, year + F.expr("INTERVAL 1 YEAR")))
        .when(value.rlike(r"^\d{4}-\d{2}$"), pair(month, month + F.expr("INTERVAL 1 MONTH")))
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), pair(day, day + F.expr("INTERVAL 1 DAY")))
        .when(value.rlike(_RFC3339), F.when(moment.isNotNull(), F.struct(moment.alias("start"), moment.alias("stop"), F.lit(True).alias("instant"))))
    )


def overlaps(value: Column, since: str | None = None, until: str | None = None) -> Column:
    """Whether a date's interval meets the closed interval of the bounds; unusable dates never do."""
    here = interval(value)
    ok = here.isNotNull()
    if since:
        low = interval(F.lit(since))
        ok = ok & ((here["stop"] > low["start"]) | (here["instant"] & (here["stop"] == low["start"])))
    if until:
        high = interval(F.lit(until))
        ok = ok & ((here["start"] < high["stop"]) | (high["instant"] & (here["start"] == high["stop"])))
    return F.coalesce(ok, F.lit(False))
