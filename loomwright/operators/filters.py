"""Record filters: a conjunction of conditions, globally and by corpus."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import dates, glob

FLAGS = ("email_addresses", "repetitive_content", "boilerplate_content", "main_content")


def _text(name: str) -> Column:
    """A missing value reads as an empty string."""
    return F.coalesce(F.col(name), F.lit(""))


@dataclass(frozen=True)
class ValueFilter:
    """Globs to include and exclude; exclusion wins, no inclusion allows all."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def validate(self, what: str) -> None:
        if not self.include and not self.exclude:
            raise ValueError(f"{what}: declares nothing")
        for side in (self.include, self.exclude):
            if len(set(side)) != len(side) or not all(side):
                raise ValueError(f"{what}: empty or repeated pattern")
            for p in side:
                glob.to_regex(p)

    def column(self, *names: str) -> Column:
        """Allowed when no column matches an exclusion and any matches an inclusion."""
        any_of = lambda patterns: reduce(or_, [glob.matches(_text(n), list(patterns)) for n in names])
        allowed = any_of(self.include) if self.include else F.lit(True)
        return allowed & ~any_of(self.exclude) if self.exclude else allowed


@dataclass(frozen=True)
class DateFilter:
    since: str | None = None
    until: str | None = None

    def validate(self, what: str) -> None:
        if not self.since and not self.until:
            raise ValueError(f"{what}: declares no bound")

    def column(self, name: str = "date") -> Column:
        return dates.overlaps(_text(name), self.since, self.until)


@dataclass(frozen=True)
class Exclusion:
    """A disjunction: flags that are present and equal, or licences that match."""

    flags: Mapping[str, bool] = field(default_factory=dict)
    licenses: tuple[str, ...] = ()

    def column(self) -> Column:
        parts = [F.coalesce(F.col(k) == F.lit(v), F.lit(False)) for k, v in self.flags.items()]
        if self.licenses:
            parts.append(glob.matches(_text("license"), list(self.licenses)))
        return reduce(or_, parts) if parts else F.lit(False)


@dataclass(frozen=True)
class RecordFilter:
    main_content: bool | None = None
    exclude: Exclusion | None = None
    licenses: ValueFilter | None = None
    languages: ValueFilter | None = None
    sources: ValueFilter | None = None
    date: DateFilter | None = None

    def validate(self) -> None:
        if all(x is None for x in (self.main_content, self.exclude, self.licenses, self.languages, self.sources, self.date)):
            raise ValueError("a record filter must declare a condition")
        if self.exclude is not None:
            if set(self.exclude.flags) - set(FLAGS):
                raise ValueError("unknown flag")
            if self.exclude.licenses and self.licenses is not None and self.licenses.exclude:
                raise ValueError("licence exclusions cannot be combined")
        for what in ("licenses", "languages", "sources", "date"):
            part = getattr(self, what)
            if part is not None:
                part.validate(what)

    def column(self) -> Column:
        parts = [F.lit(True)]
        if self.main_content is not None:
            parts.append(F.coalesce(F.col("main_content"), F.lit(True)) == F.lit(self.main_content))
        if self.exclude is not None:
            parts.append(~self.exclude.column())
        if self.licenses is not None:
            parts.append(self.licenses.column("license"))
        if self.languages is not None:
            parts.append(self.languages.column("language"))
        if self.sources is not None:
            parts.append(self.sources.column("source", "source_name"))
        if self.date is not None:
            parts.append(self.date.column())
        return reduce(and_, parts)


@dataclass(frozen=True)
class Policy:
    """A global filter and filters of single corpora, which add to it."""

    every: RecordFilter | None = None
    corpora: Mapping[str, RecordFilter] = field(default_factory=dict)

    def validate(self, selected: list[str]) -> None:
        if self.every is None and not self.corpora:
            raise ValueError("a policy must declare a filter")
        if set(self.corpora) - set(selected):
            raise ValueError("filter of an unselected corpus")
        for f in [self.every, *self.corpora.values()]:
            if f is not None:
                f.validate()

    def column(self, corpus: str = "corpus") -> Column:
        out = self.every.column() if self.every else F.lit(True)
        for name, f in self.corpora.items():
            out = out & F.when(F.col(corpus) == name, f.column()).otherwise(F.lit(True))
        return out


def license_policy(licenses: Column, include: list[str]) -> Column:
    """Whether every licence of a shard is allowed."""
    return F.forall(licenses, lambda x: glob.matches(x, include))


def languages_any(declared: Column, requested: list[str]) -> Column:
    """Case-insensitive membership; nothing declared never matches."""
    wanted = [r.lower() for r in requested]
    return F.coalesce(F.exists(declared, lambda x: F.lower(x).isin(wanted)), F.lit(False))


def rejection(text: str = "text", license_ok: Column | None = None) -> Column:
    """Why a row is rejected, or null."""
    out = F.when(F.col(text).isNull(), "mapping").when(F.trim(F.regexp_replace(text, r"\s", " ")) == "", "empty").when(F.instr(text, "\x00") > 0, "malformed")
    return out.when(~license_ok, "license-policy") if license_ok is not None else out


def rejections(rows: DataFrame, reason: Column) -> DataFrame:
    """Accepted and rejected rows by reason."""
    return rows.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def unassessed(shards: DataFrame, flags: list[str]) -> DataFrame:
    """Shards of a schema that has no flags, which an exclusion by flag can't see."""
    return shards.filter((F.col("record_schema") < 2) & F.lit(bool(flags)))


def skip_completed(selected: DataFrame, completed: DataFrame, key: str = "corpus") -> DataFrame:
    return selected.join(completed.select(key).distinct(), key, "left_anti")
