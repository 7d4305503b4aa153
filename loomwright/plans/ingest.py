"""Ingestion: scan, map and redact once into a written table, then deduplicate and assess from it.

The written table cuts the lineage, so that files are read, parsed and redacted once however often
their rows are used; deduplication and reports read its narrow columns only.
"""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions import glob, privacy, text
from loomwright.functions import license as licenses
from loomwright.operators import dedup, mapping
from loomwright.plans.profile import Input, Plan, Profile, choose_format
from loomwright.runtime import cut
from loomwright.sources import probe, readers

#: Canonical columns in their contractual order, with their types.
CANONICAL = {
    "content_sha256": "binary", "text": "string", "source": "string", "source_name": "string", "license": "string", "license_raw": "string", "language": "string", "language_score": "int",
    "date": "string", "token_count": "bigint", "meta": "string", "email_addresses": "boolean", "repetitive_content": "boolean", "boilerplate_content": "boolean", "main_content": "boolean",
    "redacted_email_addresses": "bigint", "redacted_ip_addresses": "bigint", "redacted_phone_numbers": "bigint", "removed_mail_routing_headers": "bigint", "redacted_credentials": "bigint",
}
#: Columns of the accepted older layouts, and the defaults of what they lack.
OLD_DEFAULTS = {"main_content": "true", "email_addresses": "NULL", "repetitive_content": "NULL", "boilerplate_content": "NULL"}


def canonical_view(rows: DataFrame) -> DataFrame:
    """Rows of any accepted layout in canonical columns; what a layout lacks has its fixed default."""
    aliases = {"lang": "language", "lang_score": "language_score", "tokens": "token_count", "sha256": "content_sha256"}
    for old, new in aliases.items():
        if old in rows.columns and new not in rows.columns:
            rows = rows.withColumnRenamed(old, new)
    out = []
    for name, kind in CANONICAL.items():
        if name in rows.columns:
            value = F.unhex(name) if name == "content_sha256" and dict(rows.dtypes)[name] == "string" else F.col(name).cast(kind)
        else:
            value = F.expr(OLD_DEFAULTS.get(name, "0" if kind == "bigint" and name != "token_count" else "NULL")).cast(kind)
        out.append(value.alias(name))
    return rows.select(*out)


def _paths(p: Profile) -> list[list[str]]:
    """Every path that a profile names, as keys."""

    def strings(x) -> list[str]:
        if isinstance(x, dict):
            return [s for v in x.values() for s in strings(v)]
        return [x] if isinstance(x, str) else [s for v in x or [] for s in strings(v)] if isinstance(x, (list, tuple)) else []

    named = [s for k, v in p.options.items() if k not in ("role_aliases", "missing_rank", "assistant_role") for s in strings(v)]
    return [[step.removesuffix("[]") for step in path.split(".")] for path in [*named, *p.main_content]]


def _needed(schema: T.StructType, paths: list[list[str]], at: str = "") -> list[Column]:
    """The columns, and of structs the leaves, that paths lead to; only these are read. Arrays and maps are read whole."""
    out = []
    for field in schema:
        below = [p[1:] for p in paths if p and p[0] == field.name]
        name = f"{at}`{field.name}`"
        if not below:
            continue
        if isinstance(field.dataType, T.StructType) and all(below):
            inner = _needed(field.dataType, below, name + ".")
            out.append(F.when(F.col(name).isNotNull(), F.struct(*inner)).alias(field.name) if inner else F.lit(None).cast("string").alias(field.name))
        else:
            out.append(F.col(name).alias(field.name))
    return out or [F.lit(None).cast("string").alias("nothing")]


def _scan(spark: SparkSession, one: Input, record_bytes: int) -> DataFrame:
    """(path, source, position, text, doc) of an input; doc is the record of mapped formats."""
    if one.format == "parquet":
        rows = spark.read.parquet(one.path)
        if one.profile is None:
            column = readers.text_column(rows.columns, one.text_column)
            flat = readers.parquet_text(spark, one.path, column)
            return flat.withColumn("doc", F.lit(None).cast("variant"))
        record = F.parse_json(F.to_json(F.struct(*_needed(rows.schema, _paths(one.profile)))))
        return rows.select(F.col("_metadata.file_path").alias("path"), F.concat(F.lit(one.path + "#row="), F.col("_metadata.row_index").cast("string")).alias("source"), F.col("_metadata.row_index").alias("position"), F.lit(None).cast("string").alias("text"), record.alias("doc"))
    found = probe.files(spark, one.path)
    none = F.lit(None).cast("variant")
    if one.format in ("text", "markdown"):
        if one.profile is None:
            # files over the record size become chunks
            small, large = found.filter(F.col("length") <= record_bytes), found.filter(F.col("length") > record_bytes)
            return readers.text_files(small).unionByName(readers.chunked_text(large, record_bytes)).withColumn("doc", none)
        rows = readers.text_files(found).withColumn("doc", none)
        if one.profile is not None:
            rows = rows.withColumn("text", readers.bounded_text(F.col("text"), one.profile.options["start"], one.profile.options["stop"]))
        return rows
    if one.format == "mbox":
        return readers.mailboxes(found).withColumn("doc", none)
    if one.format == "xml":
        o = one.profile.options
        selectors = {"text": o["text"], **({"source": o["source"]} if o.get("source") else {}), **o.get("meta", {})}
        return readers.xml_records(found, selectors, o.get("exclude", []), o.get("source_prefix", ""), o.get("on_malformed", "error") == "skip").withColumn("doc", none)
    lines = readers.json_lines(found) if one.format == "jsonl" else readers.json_documents(found)
    doc = lines.withColumn("doc", F.expr("try_parse_json(text)"))
    plain = F.try_variant_get("doc", f"$.{one.text_column}", "string") if one.profile is None else F.lit(None).cast("string")
    return doc.withColumn("broken", F.col("doc").isNull()).withColumn("text", plain)


def _first(doc: Column, path: str | None) -> Column:
    return F.get(mapping.path_values(doc, path), 0) if path else F.lit(None).cast("string")


def _mapped(rows: DataFrame, p: Profile) -> DataFrame:
    """Text, source, licence and metadata of a profile."""
    o, doc = p.options, F.col("doc")
    listed = lambda x: [x] if isinstance(x, str) else list(x or [])
    if p.kind == "record-map":
        body = mapping.mapped_text(doc, listed(o["text"]), listed(o.get("text_fallback")))
    elif p.kind == "dialogue-pair":
        said = lambda k: mapping.mapped_text(doc, listed(o.get(k))) if o.get(k) else None
        messages = mapping.dialogue_pair(said("text"), said("response"), said("context"))
        body = F.when(mapping.valid_conversation(messages), mapping.encode_conversation(messages))
    elif p.kind == "chat-messages":
        messages = mapping.chat_messages(mapping.path_values(doc, o["role"]), mapping.path_values(doc, o["content"]), o.get("role_aliases", {}), _first(doc, o.get("system")))
        body = F.when(mapping.valid_conversation(messages), mapping.encode_conversation(messages, _first(doc, o.get("tools"))))
    else:
        messages = mapping.ranked_trees(F.to_json(doc), o["text"], o["replies"], o["rank"], o.get("missing_rank") == "source-order", o.get("role"), o.get("assistant_role", "assistant"))
        body = F.when(mapping.valid_conversation(messages), mapping.encode_conversation(messages))
    declared, declared_raw = mapping.declared_licenses(doc, o.get("license"))
    named = F.coalesce(_first(doc, o.get("source")), _first(doc, o.get("id")), F.col("source"))
    return rows.withColumns({
        "text": body, "source": named, "license_raw": declared_raw, "declared": declared, "language": _first(doc, o.get("language")), "date": _first(doc, o.get("date")),
        "meta": mapping.mapped_meta(doc, o["meta"]) if o.get("meta") else F.lit(None).cast("string"),
        "main_content": F.when(doc.isNull(), F.lit(True)).otherwise(mapping.main_content(doc, p.main_content)) if p.main_content else F.lit(True),
    })


def scanned(spark: SparkSession, one: Input, number: int, record_bytes: int = 64 << 20, direct: bool = False) -> DataFrame:
    """Rows of an input with their plan order and, where they are rejected, the reason.

    An input that is read directly, without evidence that counts rejections, fails at an empty
    record unless its profile skips them.
    """
    rows = _scan(spark, one, record_bytes)
    if "broken" not in rows.columns:
        rows = rows.withColumn("broken", F.lit(False))
    if one.profile is not None and one.format in ("json", "jsonl", "parquet"):
        rows = _mapped(rows, one.profile)
    if "declared" not in rows.columns:
        rows = rows.withColumn("declared", F.lit(None).cast("string"))
    for name in ("license_raw", "language", "date", "meta"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    if "main_content" not in rows.columns:
        rows = rows.withColumn("main_content", F.lit(True))
    body = F.col("text")
    if one.profile is None or one.profile.replaces_nul:
        body = F.replace(body, F.lit("\x00"), F.lit(" "))
    rows = rows.withColumn("text", body).withColumn("license", F.coalesce(F.nullif("declared", F.lit("")), F.lit(one.license)))
    empty = F.coalesce(F.trim(F.regexp_replace("text", r"\s", " ")), F.lit("")) == ""
    stops = direct and one.profile is not None and one.profile.on_empty == "error"
    told = F.raise_error(F.concat(F.lit("empty record: "), F.col("source"))).cast("string") if stops else F.lit("empty")
    reason = F.when(F.col("broken"), F.lit("malformed"))
    if "doc" in rows.columns and one.profile is not None and one.format in ("json", "jsonl", "parquet"):
        # a record whose text path isn't there, or whose roles can't be read, isn't empty but unmapped
        reason = reason.when(F.col("text").isNull(), F.lit("mapping"))
    reason = reason.when(empty, told).when(F.octet_length("text") > record_bytes, F.lit("oversized"))
    if one.profile is not None and one.profile.license_policy:
        reason = reason.when(~glob.matches(F.col("license"), list(one.profile.license_policy)), "license-policy")
    return rows.withColumn("reject_reason", reason).select(F.lit(number).alias("input_no"), "path", "position", "source", "text", "license", "license_raw", "language", "date", "meta", "main_content", F.lit(one.profile is not None and one.profile.kind != "record-map" and one.format in ("json", "jsonl", "parquet")).alias("conversation"), "reject_reason")


def planned(spark: SparkSession, roots: list[str], license: str, profiles: dict[str, Profile] | None = None, text_column: str | None = None, declared: dict[str, str] | None = None, most: int = 100_000) -> Plan:
    """A plan over probed files: a file's format is detected unless ``declared`` for its suffix, and read by the profile of its format.

    A plan names its files, so their number is bounded; more than ``most`` is an error.
    """
    found = probe.probed(probe.files(spark, *roots)).select("path", "format").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} files; plan folders apart")
    inputs = []
    for path, detected in sorted((r.path, r.format) for r in found):
        local = path.removeprefix("file:").replace("//", "/", 1) if path.startswith("file:") else path
        chosen = choose_format(detected, (declared or {}).get(os.path.splitext(local)[1]))
        profile = (profiles or {}).get(chosen)
        inputs.append(Input(local, chosen, license, profile, text_column if profile is None and chosen in ("parquet", "jsonl") else None))
    return Plan(tuple(inputs)).checked()


def scan_plan(spark: SparkSession, plan: Plan) -> DataFrame:
    plan.checked()
    return reduce(DataFrame.unionByName, [scanned(spark, one, i, plan.record_bytes, plan.direct) for i, one in enumerate(plan.inputs)])


def redacted(rows: DataFrame) -> DataFrame:
    """Texts, sources and metadata without direct identifiers, and the replacements counted together."""
    with_structs = rows.withColumns({"r": privacy.redacted_payload(F.col("text"), F.col("conversation")), "s": privacy.redacted(F.col("source")), "m": privacy.redacted_json(F.col("meta"))})
    count = lambda c: F.col(f"r.{c}") + F.col(f"s.{c}") + F.col(f"m.{c}")
    return with_structs.withColumns({
        "text": F.col("r.text"), "source": F.col("s.text"), "meta": F.col("m.text"), "redacted_email_addresses": count("email_addresses"), "redacted_ip_addresses": count("ip_addresses"),
        "redacted_phone_numbers": count("phone_numbers"), "removed_mail_routing_headers": count("mail_routing_headers"), "redacted_credentials": count("credentials"),
    }).drop("r", "s", "m")


def written(scan: DataFrame) -> DataFrame:
    """The scan, redacted and identified, written once; rejected rows keep their reason and lose their text."""
    accepted = F.col("reject_reason").isNull()
    blank = scan.withColumns({c: F.when(accepted, F.col(c)) for c in ("text", "meta")})
    return cut(dedup.identified(redacted(blank)))


def ingested(scan: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """Canonical rows: redaction, then exact deduplication in plan order, then assessment of what is kept.

    Takes a scan or what ``written`` made of it. Winners come from digests and positions alone;
    the wide rows meet them once, by position.
    """
    rows = (scan if "content_sha256" in scan.columns else written(scan)).filter("reject_reason IS NULL")
    order = ["input_no", "path", "position"]
    winners = rows.groupBy(*dedup.KEY).agg(F.min(F.struct(*order)).alias("first"))
    if seed is not None:
        winners = dedup.without_seed(winners, seed)
    kept = rows.join(winners.select("first.*"), order, "left_semi")
    said = kept.withColumn("said", F.when(F.col("conversation"), mapping.conversation_text(F.col("text"))).otherwise(F.col("text")))
    assessed = said.withColumns({
        "email_addresses": text.has_email(F.col("said")), "boilerplate_content": text.boilerplate(F.col("said")), "repetitive_content": text.repetitive(F.col("said")),
        "token_count": F.octet_length("text").cast("bigint"), "source_name": F.lit(None).cast("string"), "language_score": F.lit(None).cast("int"),
    })
    return canonical_view(assessed)


def report(scan: DataFrame, kept: DataFrame) -> DataFrame:
    """Input, retained, duplicate and rejected rows; rejected ones by reason as a map."""
    by = scan.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
    totals = by.agg(F.sum("n").alias("input"), F.coalesce(F.sum(F.when(F.col("reject_reason").isNull(), F.col("n"))), F.lit(0)).alias("seen"), F.map_from_entries(F.collect_list(F.when(F.col("reject_reason").isNotNull(), F.struct("reject_reason", "n")))).alias("rejected"))
    return totals.crossJoin(kept.agg(F.count(F.lit(1)).alias("retained"))).withColumn("duplicate", F.col("seen") - F.col("retained"))


def manifest(plan: Plan, objects: DataFrame, name: str) -> str:
    """Manifest document of what was written."""
    rows = [r.asDict() for r in objects.orderBy("sha256").collect()]
    body = {"name": name, "plan": plan.identity(), "records": sum(r["records"] for r in rows), "bytes": sum(r["bytes"] for r in rows), "shards": [{"sha256": r["sha256"], "records": r["records"], "bytes": r["bytes"]} for r in rows]}
    return json.dumps(body, sort_keys=True, indent=1)
