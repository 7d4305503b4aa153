"""Licence identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole-string names, compared without case, and what they stand for.
ALIASES = {
    "Apache 2 License - https://www.apache.org/licenses/LICENSE-2.0": "Apache-2.0",
    "BSD 2-Clause": "BSD-2-Clause",
    "BSD 3-Clause": "BSD-3-Clause",
    "Community Data License Agreement - Permissive 1.0 - https://cdla.dev/": "CDLA-Permissive-1.0",
    "ISC License": "ISC",
    "MIT License": "MIT",
}
#: Patterns of licence addresses and names.
CC_URL = r"(?i)https?://creativecommons\.org/(?:licenses/([a-z-]+)/([0-9.]+)|publicdomain/zero/([0-9.]+))"
CC_NAME = r"(?i)^CC[ _-]*(BY(?:[ _-]*(?:NC|ND|SA)){0,2}|ZERO|0)[ _-]*([0-9]+(?:\.[0-9]+)?)$"

#: Fixed value: white space of any script at the ends of a name.
SPACE_AROUND = r"^[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+\z"


def normalize(raw: Column) -> Column:
    """Canonical identifier; unknown expressions stay as they are, trimmed. Null stays null."""
    value = F.regexp_replace(raw, SPACE_AROUND, "")
    low = F.lower(value)
    part = lambda pattern, i: F.regexp_extract(value, pattern, i)
    out = F.when(low == "", F.lit(""))
    for name, identifier in ALIASES.items():
        out = out.when(low == name.lower(), F.lit(identifier))
    out = out.when(part(CC_URL, 3) != "", F.concat(F.lit("CC0-"), part(CC_URL, 3)))
    out = out.when(part(CC_URL, 1) != "", F.concat(F.lit("CC-"), F.upper(part(CC_URL, 1)), F.lit("-"), part(CC_URL, 2)))
    out = out.when(low == "public domain", F.lit("LicenseRef-Public-Domain"))
    name = F.upper(F.translate(part(CC_NAME, 1), " _", "--"))
    out = out.when(name.isin("ZERO", "0"), F.concat(F.lit("CC0-"), part(CC_NAME, 2)))
    out = out.when(name != "", F.concat(F.lit("CC-"), name, F.lit("-"), part(CC_NAME, 2)))
    return out.otherwise(value)


def normalize_set(raw: Column) -> Column:
    """Terms of several declarations, each normalized, distinct, sorted and joined by AND."""
    terms = F.filter(F.transform(raw, normalize), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_sort(F.array_distinct(terms)), " AND ")


def effective(record: Column, default: Column | str) -> Column:
    """A record's own licence, else the source's."""
    own = F.nullif(normalize(record), F.lit(""))
    return F.coalesce(own, F.lit(default) if isinstance(default, str) else default)
