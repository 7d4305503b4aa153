"""Declarative mapping of raw records onto canonical rows."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import license as licenses

CHAT = "array<struct<role:string,content:string>>"


def _member(at: str):
    return lambda v: F.try_variant_get(v, at, "variant")


def path_values(document: Column, path: str) -> Column:
    """Strings at a dotted path of a variant, ``[]`` expanding arrays; missing and null give none.

    Numbers keep their JSON text; objects and arrays at the end of a path are no scalars and
    raise where they are read.
    """
    steps = path.split(".")
    values = F.array(document)
    for step in steps:
        name, expand = (step[:-2], True) if step.endswith("[]") else (step, False)
        quoted = name.replace("\\", "\\\\").replace('"', '\\"')
        values = F.transform(values, _member(f'$["{quoted}"]'))
        values = F.filter(values, lambda v: v.isNotNull() & ~F.is_variant_null(v))
        if expand:
            values = F.flatten(F.transform(values, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
            values = F.filter(values, lambda v: v.isNotNull() & ~F.is_variant_null(v))
    return F.transform(values, lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def declared_licenses(document: Column, path: str | None) -> tuple[Column, Column]:
    """(identifier, raw) of the licences that a record declares, one or an array of them: each normalized, joined by AND; several are kept raw as a JSON array."""
    if not path:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    values = F.filter(path_values(document, path if path.endswith("[]") else path + "[]"), lambda x: x != "")
    raw = F.when(F.size(values) == 1, F.element_at(values, 1)).when(F.size(values) > 1, F.to_json(values))
    return licenses.normalize_set(values), raw


def mapped_text(document: Column, paths: list[str], fallback: list[str] = ()) -> Column:
    """Non-blank values of all paths joined by blank lines; the fallback where they give nothing."""

    def joined(each: list[str]) -> Column:
        values = F.flatten(F.array(*[path_values(document, p) for p in each]))
        return F.array_join(F.filter(values, lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != ""), "\n\n")

    main = joined(list(paths))
    return F.when(main != "", main).otherwise(joined(list(fallback))) if fallback else main


def mapped_meta(document: Column, fields: Mapping[str, str]) -> Column:
    """JSON object with sorted keys: no value leaves a key out, several make an array; null when empty."""
    entries = []
    for name in sorted(fields):
        values = path_values(document, fields[name])
        key = json.dumps(name, ensure_ascii=False) + ":"
        one = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        many = F.concat(F.lit("["), F.array_join(F.transform(values, one), ","), F.lit("]"))
        entries.append(F.when(F.size(values) == 1, F.concat(F.lit(key), one(F.element_at(values, 1)))).when(F.size(values) > 1, F.concat(F.lit(key), many)))
    kept = F.filter(F.array(*entries), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.concat(F.lit("{"), F.array_join(kept, ","), F.lit("}")))


def escaped(payload: Column) -> Column:
    """Payloads write angle brackets, ampersands and the two line separators as escapes."""
    for c in ("<", ">", "&", "\u2028", "\u2029"):
        payload = F.replace(payload, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return payload


def encode_conversation(messages: Column, tools: Column | None = None) -> Column:
    """Canonical payload of a conversation."""
    body = F.to_json(F.struct(messages.alias("messages")))
    if tools is not None:
        body = F.when(tools.isNull(), body).otherwise(F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"tools":'), tools, F.lit("}")))
    return escaped(body)


def decoded_conversation(payload: Column) -> Column:
    """Messages of an encoded conversation, null where it isn't one: other members than messages and tools, or a message with other members than role, content and context."""
    known = "messages array<struct<role: string, content: string, context: string>>, tools string"
    held = F.from_json(payload, known)
    doc = F.try_parse_json(payload)
    keys = lambda v: F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    each = F.try_variant_get(doc, "$.messages", "array<variant>")
    top = F.size(F.array_except(keys(doc), F.array(F.lit("messages"), F.lit("tools")))) == 0
    inner = F.forall(each, lambda m: F.size(F.array_except(keys(m), F.array(F.lit("role"), F.lit("content"), F.lit("context")))) == 0)
    return F.when(F.coalesce(top & inner, F.lit(False)) & valid_conversation(held["messages"]), held["messages"])


def conversation_text(payload: Column) -> Column:
    """Contents and contexts of an encoded conversation, joined by line feeds."""
    messages = F.from_json(payload, "messages array<struct<content: string, context: string>>")["messages"]
    parts = F.flatten(F.transform(messages, lambda m: F.when(F.coalesce(m["context"], F.lit("")) == "", F.array(m["content"])).otherwise(F.array(m["content"], m["context"]))))
    return F.array_join(parts, "\n")


def valid_conversation(messages: Column) -> Column:
    """At least one user and one assistant message, and no message without content."""
    has = lambda role: F.exists(messages, lambda m: m["role"] == role)
    return F.coalesce(has("user") & has("assistant") & F.forall(messages, lambda m: m["content"].isNotNull() & (F.trim(m["content"]) != "")), F.lit(False))


def role(raw: Column, aliases: Mapping[str, str]) -> Column:
    low = F.lower(F.trim(raw))
    out = None
    for a, b in aliases.items():
        out = F.when(low == a, F.lit(b)) if out is None else out.when(low == a, F.lit(b))
    return low if out is None else out.otherwise(low)


def chat_messages(roles: Column, contents: Column, aliases: Mapping[str, str] = {}, system: Column | None = None) -> Column:  # noqa: B006
    """Messages of aligned arrays, a system message first where there is one; null where lengths differ."""
    both = F.arrays_zip(roles.alias("r"), contents.alias("c"))
    messages = F.transform(both, lambda m: F.struct(role(m["r"], aliases).alias("role"), m["c"].alias("content")))
    if system is not None:
        first = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))
        messages = F.when(system.isNull() | (F.trim(system) == ""), messages).otherwise(F.concat(first, messages))
    return F.when(F.size(roles) == F.size(contents), messages)


def dialogue_pair(instruction: Column, response: Column, context: Column | None = None) -> Column:
    asked = instruction if context is None else F.when(context.isNull() | (F.trim(context) == ""), instruction).otherwise(F.concat(instruction, F.lit("\n\n"), context))
    message = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.array(message("user", asked), message("assistant", response))


def turns_to_conversations(turns: DataFrame, conversation: str, turn: str, role_column: str = "role", content: str = "content") -> DataFrame:
    """A row a conversation from a row a turn, in order of turns."""
    listed = F.array_sort(F.collect_list(F.struct(turn, F.col(role_column).alias("role"), F.col(content).alias("content"))))
    bare = F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return turns.groupBy(conversation).agg(bare.alias("messages"))


def best_path(node: dict, text: str, replies: str, rank: str, role_field: str | None = None, source_order: bool = False, answering: str = "assistant") -> list[tuple[str, str]]:
    """Messages along the lowest ranks of a conversation tree; ties fall to the earlier reply.

    Where a field tells the roles, those of questions are anything but ``answering`` and answers
    are it, in strict alternation.
    """
    out, current, asking = [], node, True
    while current is not None:
        said = str(current.get(text) or "").strip()
        if not said:
            raise ValueError("empty message in a tree")
        who = "user" if asking else "assistant"
        if role_field and (str(current.get(role_field) or "").strip().lower() == answering.lower()) == asking:
            raise ValueError("roles don't alternate")
        out.append((who, said))
        ranked = [(r.get(rank), i, r) for i, r in enumerate(current.get(replies) or [])]
        if any(x is None for x, _, _ in ranked) and not source_order:
            ranked = [x for x in ranked if x[0] is not None]
        ranked.sort(key=lambda x: (x[0] if x[0] is not None else x[1], x[1]))
        current, asking = (ranked[0][2] if ranked else None), not asking
    return out


def ranked_trees(document: Column, text: str = "text", replies: str = "replies", rank: str = "rank", source_order: bool = False, role_field: str | None = None, answering: str = "assistant") -> Column:
    """Messages of the best path through each JSON tree; null where the tree can't be read or lacks an answer."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(s):
            try:
                path = best_path(json.loads(s), text, replies, rank, role_field, source_order, answering)
            except (ValueError, TypeError, AttributeError):
                return None
            return [{"role": r, "content": c} for r, c in path] if len(path) > 1 else None

        for series in batches:
            yield series.map(one)

    return F.pandas_udf(run, CHAT)(document)


def canonical(rows: DataFrame, text: Column, source: Column, fallback_source: Column, license_raw: Column, default_license: str, keep_nul: bool = False) -> DataFrame:
    """Canonical columns of mapped rows: NUL policy, digest, source and licence."""
    body = text if keep_nul else F.replace(text, F.lit("\x00"), F.lit(" "))
    return rows.withColumns({
        "text": body, "content_sha256": F.sha2(body, 256), "source": F.coalesce(F.nullif(source, F.lit("")), fallback_source),
        "license": licenses.effective(license_raw, default_license), "license_raw": F.nullif(license_raw, F.lit("")),
    })


def main_content(document: Column, condition: Mapping[str, object]) -> Column:
    """Conjunction of path equals scalar, compared as strings; an absent field is an error."""
    # the check of presence comes first: a field that is absent is an error even after a mismatch
    out, absent = F.lit(True), F.lit(None).cast("string")
    for path, wanted in condition.items():
        value = F.get(path_values(document, path), 0)
        absent = F.coalesce(absent, F.when(value.isNull(), F.lit(path)))
        text = json.dumps(wanted) if isinstance(wanted, bool) or wanted is None else str(wanted)
        out = out & (value == F.lit(text))
    missing = F.raise_error(F.concat(F.lit("main_content: absent field "), absent)).cast("boolean")
    return F.when(absent.isNotNull(), missing).otherwise(out)
