"""Audits of canonical rows, objects and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, digest: str = "content_sha256", one_license: bool = True, recount: Column | None = None) -> DataFrame:
    """(key, rule) of every broken rule. Contents may not repeat, whatever the licence, unless told otherwise.

    ``recount`` gives a text's tokens under the tokenizer of the rows; recorded counts have to be it.
    """
    hexed = F.lower(F.hex(digest)) if dict(rows.dtypes)[digest] == "binary" else F.lower(digest)
    meta = F.schema_of_variant(F.expr("try_parse_json(meta)"))
    rules = {
        "text-missing": F.col("text").isNull() | (F.col("text") == ""),
        "digest-differs": F.col("text").isNotNull() & ~hexed.eqNullSafe(F.sha2("text", 256)),
        "tokens-missing": F.col("token_count").isNull() | (F.col("token_count") < 0),
        "score-out-of-range": (F.col("language_score") < 0) | (F.col("language_score") > 1000),
        "meta-not-an-object": F.col("meta").isNotNull() & ~F.coalesce(meta.startswith("OBJECT"), F.lit(False)),
    }
    if recount is not None:
        rules["tokens-differ"] = F.col("token_count").isNotNull() & ~F.col("token_count").eqNullSafe(recount)
    broken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    single = rows.select(key, F.explode(broken).alias("rule"))
    same = [F.sha2("text", 256).alias("content")] + ([] if one_license else ["license"])
    ids = rows.filter(F.col("text").isNotNull()).select(key, *same)
    by = ["content"] + ([] if one_license else ["license"])
    repeated = ids.groupBy(*by).agg(F.count_distinct(key).alias("n")).filter("n > 1").select(*by)
    again = ids.join(repeated, by, "left_semi").select(key, F.lit("content-repeated").alias("rule"))
    return single.unionByName(again).distinct()


def object_path(path: Column) -> Column:
    """struct<name, canonical>: an object lies under its digest's first four digits, two folders deep."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    fanned = path.rlike(r"(?:^|/)([0-9a-f]{2})/([0-9a-f]{2})/\1\2[0-9a-f]{60}$")
    return F.struct(name.alias("name"), F.coalesce(fanned, F.lit(False)).alias("canonical"))


def scrub(files: DataFrame) -> DataFrame:
    """Objects whose content isn't what their name says; ``files`` comes from the binary source."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", "length", name.alias("name"), F.sha2("content", 256).alias("digest")).withColumn("intact", F.col("name") == F.col("digest"))


def object_faults(declared: DataFrame, told: DataFrame, found: DataFrame) -> DataFrame:
    """(sha256, fault) of an index against its objects, each checked once however many manifests name it.

    ``declared`` has (manifest, sha256, docs, tokens, bytes), ``told`` the objects' own totals
    (sha256, records, tokens, content_bytes), ``found`` what lies in the store (sha256 of the name,
    digest of the content, as ``scrub`` gives them).
    """
    once = declared.groupBy("sha256").agg(F.min("docs").alias("docs"), F.min("tokens").alias("tokens"), F.min("bytes").alias("bytes"), (F.count_distinct("docs", "tokens", "bytes") > 1).alias("conflict"))
    sums = told.select("sha256", "records", F.col("tokens").alias("told_tokens"), "content_bytes")
    both = once.join(sums, "sha256", "left").join(found.select(F.col("name").alias("sha256"), "intact"), "sha256", "left")
    rules = {
        "missing": F.col("intact").isNull(), "broken": ~F.col("intact"), "conflict": F.col("conflict"), "docs": F.col("records") != F.col("docs"), "tokens": F.col("told_tokens") != F.col("tokens"), "bytes": F.col("content_bytes") != F.col("bytes"),
    }
    faults = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return both.select("sha256", F.explode(faults).alias("fault"))


def attestation(footer: Column) -> Column:
    """How far a shard vouches for itself, from its footer's keys."""
    return F.when(F.array_contains(F.map_keys(footer), "loomwright.bom"), "embedded").when(F.array_contains(F.map_keys(footer), "loomwright.record_schema"), "implicit").otherwise("unattested")


def not_increasing(series: DataFrame, by: list[str], at: str, step: str) -> DataFrame:
    """Observations whose step isn't above the one before."""
    before = F.lag(step).over(Window.partitionBy(*by).orderBy(at))
    return series.withColumn("before", before).filter(F.col(step) <= F.col("before"))
