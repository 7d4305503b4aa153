"""Path globs: ``*`` and ``?`` stay within a segment, classes and escapes, whole string, case kept."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(pattern: str) -> str:
    """Regular expression of a glob; ValueError where the glob is malformed."""
    out, i = ["\\A"], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(pattern):
                raise ValueError(f"glob ends in an escape: {pattern!r}")
            out.append(re.escape(pattern[i]))
            i += 1
        elif c == "[":
            negated = pattern[i : i + 1] == "^"
            i += negated
            members: list[str] = []
            while True:
                if i >= len(pattern):
                    raise ValueError(f"glob has an open class: {pattern!r}")
                if pattern[i] == "]" and members:
                    i += 1
                    break
                low, i = _member(pattern, i)
                high = low
                if pattern[i : i + 1] == "-":
                    high, i = _member(pattern, i + 1)
                members.append(f"{re.escape(low)}-{re.escape(high)}")
            out.append("[" + "^" * negated + "".join(members) + "]")
        else:
            out.append(re.escape(c))
    return "".join(out) + "\\z"


def _member(pattern: str, i: int) -> tuple[str, int]:
    if i < len(pattern) and pattern[i] == "\\":
        i += 1
    if i >= len(pattern) or pattern[i] in "-]" and pattern[i - 1] != "\\":
        raise ValueError(f"glob has a bad class: {pattern!r}")
    return pattern[i], i + 1


def matches(value: Column, patterns: list[str]) -> Column:
    """Whether any glob matches. A glob with one trailing star also tells its prefix, which scans can skip by."""
    each = []
    for p in patterns:
        full = value.rlike("(?s)" + to_regex(p))
        prefix = re.match(r"[^*?\[\\]+", p)
        each.append(value.startswith(prefix.group()) & full if prefix else full)
    return reduce(or_, each) if each else F.lit(False)
