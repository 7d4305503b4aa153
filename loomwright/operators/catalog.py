"""Catalogue of corpora and shards: totals, references and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.runtime import running_before

NO_LICENSE = "(none declared)"
MEASURES = ["docs", "tokens", "bytes"]


def shard_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Records, tokens, bytes, flagged rows, redactions and distinct licences of every group."""
    flags = ["email_addresses", "repetitive_content", "boilerplate_content"]
    redactions = ["redacted_email_addresses", "redacted_ip_addresses", "redacted_phone_numbers", "removed_mail_routing_headers", "redacted_credentials"]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"),
        *[F.count_if(F.col(f)).alias(f"{f}_records") for f in flags], *[F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in redactions],
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )


def license_usage(rows: DataFrame, shard: str = "shard_id") -> DataFrame:
    """Documents and tokens of every licence within a shard."""
    return rows.groupBy(shard, "license").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))


def totals_by_license(shards: DataFrame, licenses: str = "licenses") -> DataFrame:
    """Measures by licence; a shard under several licences counts once for each, so shards over-sum."""
    named = shards.withColumn("license", F.explode_outer(licenses))
    key = F.coalesce(F.nullif("license", F.lit("")), F.lit(NO_LICENSE)).alias("license")
    return named.groupBy(key).agg(F.count(F.lit(1)).alias("shards"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES])


def grouped_totals(shards: DataFrame, outer: str, inner: str) -> DataFrame:
    """Totals by (outer, inner), by outer and over all, in one pass."""
    rolled = shards.rollup(outer, inner).agg(F.count(F.lit(1)).alias("shards"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES], F.grouping_id().alias("level"))
    return rolled.select("level", outer, inner, "shards", *MEASURES)


def corpora_list(corpora: DataFrame, shards: DataFrame) -> DataFrame:
    """A corpus a row: measures of its shards, licences and languages. ``shards`` has a corpus column."""
    sums = shards.groupBy("corpus").agg(F.count(F.lit(1)).alias("shards"), *[F.sum(m).alias(m) for m in MEASURES])
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))), ",")
    return corpora.select("corpus", "domain", listed("licenses").alias("licenses"), listed("languages").alias("languages")).join(sums, "corpus", "left").fillna(0, ["shards", *MEASURES])


def unknown_references(shards: DataFrame, corpora: DataFrame) -> DataFrame:
    """Sources that shards name and no corpus declares."""
    named = shards.select("shard_id", F.explode("sources").alias("corpus")).distinct()
    return named.join(corpora.select("corpus"), "corpus", "left_anti")


def reference_state(inventory: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Full outer comparison: referenced, unreferenced or missing."""
    a = inventory.select(key).distinct().withColumn("stored", F.lit(True))
    b = references.groupBy(key).agg(F.count(F.lit(1)).alias("uses"))
    state = F.when(F.col("stored").isNull(), "missing").when(F.col("uses").isNull(), "unreferenced").otherwise("referenced")
    return a.join(b, key, "full_outer").select(key, state.alias("state"), F.coalesce("uses", F.lit(0)).alias("uses"))


def longest_prefix(paths: DataFrame, selections: DataFrame, path: str = "path", selection: str = "selection") -> DataFrame:
    """The longest selection equal to a path or above it.

    Every path explodes into its own prefixes (as many as it has segments), which equi-join the
    selections, so no pair of path and selection is ever formed that doesn't match.
    """
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = paths.select(path, F.explode(prefixes).alias(selection)).join(selections.select(selection).distinct(), selection)
    return each.groupBy(path).agg(F.max_by(selection, F.length(selection)).alias(selection))


def map_sums(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """Key-wise sums of a map column, as a map with sorted keys."""
    flat = rows.select(*by, F.explode(column).alias("__key", "__value")).groupBy(*by, "__key").agg(F.sum("__value").alias("__value"))
    return flat.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__key", "__value")))).alias(column))


def reconcile(declared: DataFrame, computed: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Keys whose declared and computed measures differ, or that only one side has."""
    a = declared.select(key, *[F.col(m).alias(f"declared_{m}") for m in measures])
    b = computed.select(key, *[F.col(m).alias(f"computed_{m}") for m in measures])
    differs = F.lit(False)
    for m in measures:
        differs = differs | ~F.col(f"declared_{m}").eqNullSafe(F.col(f"computed_{m}"))
    return a.join(b, key, "full_outer").filter(differs)


def distinct_objects(references: DataFrame) -> DataFrame:
    """One fetch a digest, with its uses; a digest with two sizes is a conflict."""
    return references.groupBy("sha256").agg(F.count(F.lit(1)).alias("uses"), F.min("bytes").alias("bytes"), (F.count_distinct("bytes") > 1).alias("conflict"))


def bijection(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Keys that keep two sets from being in bijection, with the times each side has them."""
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = count(expected, "expected").join(count(given, "given"), key, "full_outer").fillna(0, ["expected", "given"])
    return both.filter("expected <> 1 OR given <> 1")


def preserved_context(fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """Fresh sources with the earliest prior context of the same name or address."""
    by_name = fresh.join(prior.select(F.col("name"), F.col("context"), F.col("position")), "name")
    by_url = fresh.join(prior.select(F.col("url"), F.col("context"), F.col("position")), "url").select(by_name.columns)
    first = by_name.unionByName(by_url).groupBy("name", "url").agg(F.min_by("context", "position").alias("context"))
    return fresh.join(first, ["name", "url"], "left")


def unique_paths(*selections: DataFrame) -> DataFrame:
    """Union of selections, a manifest once."""
    out = selections[0]
    for s in selections[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["path"])


def prune_oldest(objects: DataFrame, cap: int) -> DataFrame:
    """Objects to remove, oldest first, until the rest fits a cap; objects in use stay."""
    ranked = objects.withColumns({"__idle": ~F.col("in_use"), "__age": -F.col("used_at").cast("timestamp").cast("double")})
    placed = running_before(ranked, ["__idle", "__age", "sha256"], F.col("bytes"), "__newer")
    return placed.filter((F.col("__newer") + F.col("bytes") > cap) & ~F.col("in_use")).select(*objects.columns)


def logical_path(manifest: Column) -> Column:
    """Path of a corpus from its manifest's path."""
    return F.regexp_replace(manifest, r"(?:/manifest)?\.(?:ya?ml|json)$", "")


def source_of_artifact(artifacts: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): the first declared root, by its position, that an artifact lies in or is; no root is an error when it's read.

    As with ``longest_prefix`` an artifact explodes into its own prefixes, which equi-join the roots.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = artifacts.select("path", F.explode(prefixes).alias("root")).join(roots.select("root", "position"), "root")
    first = each.groupBy("path").agg(F.min_by("root", "position").alias("root"))
    lost = F.raise_error(F.concat(F.lit("no declared source holds "), F.col("path"))).cast("string")
    return artifacts.select("path").distinct().join(first, "path", "left").select("path", F.coalesce("root", lost).alias("root"))


def resolved_paths(declared: DataFrame, selected: DataFrame) -> DataFrame:
    """(declared, path, fault): a selected path by its own or its logical name; none or several are a fault."""
    names = selected.select(F.explode(F.array_distinct(F.array("path", logical_path(F.col("path"))))).alias("declared"), "path")
    found = declared.select("declared").distinct().join(names, "declared", "left").groupBy("declared").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path"))
    fault = F.when(F.col("n") == 0, "not selected").when(F.col("n") > 1, "ambiguous")
    return found.select("declared", F.when(F.col("n") == 1, F.col("path")).alias("path"), fault.alias("fault"))


def totals_with_usage(shards: DataFrame, usage: DataFrame) -> DataFrame:
    """Totals by licence where shards of one licence give all their measures and others their usage by licence.

    ``shards`` has (shard_id, licenses, docs, tokens, bytes), ``usage`` (shard_id, license, docs,
    tokens); a shard of several licences counts once under each and gives no bytes to any.
    """
    key = F.coalesce(F.nullif("license", F.lit("")), F.lit(NO_LICENSE)).alias("license")
    several = F.size(F.coalesce("licenses", F.array().cast("array<string>"))) > 1
    single = shards.filter(~several).select(F.get("licenses", 0).alias("license"), *MEASURES)
    each = usage.join(shards.filter(several).select("shard_id"), "shard_id", "left_semi").select("license", "docs", "tokens", F.lit(0).cast("bigint").alias("bytes"))
    return single.unionByName(each).groupBy(key).agg(F.count(F.lit(1)).alias("shards"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES])


def tree_difference(staged: DataFrame, applied: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, state): files of a contribution that are missing, unexpected or of other content once it is applied."""
    a, b = staged.select("path", F.col("sha256").alias("staged")), applied.select("path", F.col("sha256").alias("applied"))
    every = expected.select("path").withColumn("expected", F.lit(True)).join(a, "path", "full_outer").join(b, "path", "full_outer")
    state = F.when(F.col("expected").isNull(), "unexpected").when(F.col("staged").isNull() | F.col("applied").isNull(), "missing").when(F.col("staged") != F.col("applied"), "differs")
    return every.select("path", state.alias("state")).filter("state IS NOT NULL")


def rebuilt_sources(fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """Sources of a rebuilt manifest: fresh shards replace the old ones, contexts are kept by name or address."""
    return preserved_context(fresh, prior)
