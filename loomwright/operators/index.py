"""Directory indexes of corpora: loading, expansion of sub-manifests, and rule sets.

Manifests are metadata of driver size: a tree of small JSON documents. Their rows become
DataFrames for everything that joins or sums.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Categories of sources, and what the acquisition of each must tell.
CATEGORIES = {
    "public-dataset": (), "commercially-licensed": ("basis",), "private-third-party": ("basis",), "web-crawl": ("basis", "crawler", "domains"),
    "user-data": ("basis", "service", "interaction"), "synthetic": ("basis", "generator"), "other": (),
}
#: Facts that belong to one category alone.
OWN_FACTS = {"crawler": "web-crawl", "domains": "web-crawl", "service": "user-data", "interaction": "user-data", "generator": "synthetic"}
CRAWLER_FACTS = ("name", "purpose", "behaviour", "protocols")
SHARDS = "manifest string, sha256 string, docs bigint, tokens bigint, bytes bigint, licenses array<string>, sources array<string>"


def _load(path: str) -> dict:
    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError(f"{path}: repeated key")
        return out

    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ValueError(f"{path}: no YAML reader is installed") from e
            return yaml.safe_load(f)
        return json.load(f, object_pairs_hook=unique)


def walk(folder: str, name: str = "index.json", seen: frozenset = frozenset()) -> Iterator[tuple[str, dict]]:
    """(path, manifest) depth first; only entries that an index names are visible."""
    top = os.path.realpath(os.path.join(folder, name))
    if top in seen:
        raise ValueError(f"{top} contains itself")
    entries = _load(top).get("entries", [])
    if entries != sorted(set(entries)):
        raise ValueError(f"{top}: entries are sorted and unique")
    for entry in entries:
        path = os.path.join(folder, entry)
        if os.path.isdir(path):
            yield from walk(path, name, seen | {top})
        else:
            yield os.path.relpath(path, folder) if not seen else path, _load(path)


def expanded(path: str, manifest: dict, seen: tuple = ()) -> list[dict]:
    """Shards of a manifest, its sub-manifests' included, whose totals must be what it declares."""
    if path in seen:
        raise ValueError(f"{path} contains itself")
    rollup = manifest.get("rollup")
    if not rollup:
        return list(manifest.get("shards", []))
    out: list[dict] = []
    for sub in rollup["manifests"]:
        below = os.path.join(os.path.dirname(path), sub)
        if below in seen:
            raise ValueError(f"{below} contains itself")
        out += expanded(below, _load(below), (*seen, path))
    digests = [s["sha256"] for s in out]
    if len(set(digests)) != len(digests):
        raise ValueError(f"{path}: a shard twice")
    for m in ("docs", "tokens", "bytes"):
        if m in rollup and sum(s.get(m, 0) for s in out) != rollup[m]:
            raise ValueError(f"{path}: {m} differ from the declaration")
    return out


def shard_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A row a shard of every visible manifest."""
    rows = [(p, s["sha256"], s.get("docs", 0), s.get("tokens", 0), s.get("bytes", 0), s.get("licenses", []), s.get("sources", [])) for p, m in walk(folder) for s in expanded(os.path.join(folder, p), m)]
    return spark.createDataFrame(rows, SHARDS)


def source_faults(source: dict) -> list[str]:
    """What is wrong with a source's provenance."""
    category = source.get("category", "")
    category = "public-dataset" if category == "public" else category
    told = any(source.get(f) for f in ("input_formats", "usage", "content", "acquisition", "license_evidence", "collected_from", "collected_to"))
    if not category:
        return ["category is missing"] if told else []
    if category not in CATEGORIES:
        return [f"unknown category {category!r}"]
    faults = []
    formats = source.get("input_formats", [])
    if formats != sorted(set(formats)) or not all(formats):
        faults.append("input_formats are sorted and unique")
    since, until = source.get("collected_from") or "", source.get("collected_to") or ""
    if since and until and since[: len(until)] > until[: len(since)]:
        faults.append("collected_from is after collected_to")
    acquisition = source.get("acquisition")
    if acquisition is None:
        return faults + ([f"{category} needs acquisition details"] if CATEGORIES[category] else [])
    faults += [f"{category} needs {f}" for f in CATEGORIES[category] if not acquisition.get(f)]
    faults += [f"{f} belongs to {c}" for f, c in OWN_FACTS.items() if acquisition.get(f) and c != category]
    if category == "web-crawl":
        faults += [f"crawler needs {f}" for f in CRAWLER_FACTS if not (acquisition.get("crawler") or {}).get(f)]
        names = [d.get("domain", "") for d in acquisition.get("domains") or []]
        if names != sorted(set(names)):
            faults.append("domains are sorted and unique")
        faults += [f"domain {d.get('domain', '')!r} needs acquired bytes" for d in acquisition.get("domains") or [] if not d.get("bytes", 0) > 0]
    return faults


def manifest_faults(path: str, manifest: dict) -> list[str]:
    """Broken rules of one manifest: order, references and sums."""
    faults = []
    shards = manifest.get("shards", [])
    digests = [s.get("sha256", "") for s in shards]
    if digests != sorted(set(digests)):
        faults.append("shards are sorted and unique")
    names = [s.get("name", "") for s in manifest.get("sources", [])]
    if len(set(names)) != len(names):
        faults.append("source twice")
    for s in shards:
        faults += [f"shard {s.get('sha256', '')[:12]} names unknown source {n!r}" for n in s.get("sources", []) if n not in names]
    for m in ("docs", "tokens", "bytes"):
        if m in manifest and manifest[m] != sum(s.get(m, 0) for s in shards):
            faults.append(f"{m} differ from the shards' sum")
    for s in manifest.get("sources", []):
        faults += [f"source {s.get('name', '')!r}: {f}" for f in source_faults(s)]
    return [f"{path}: {f}" for f in faults]


def verify(folder: str) -> list[str]:
    """Broken rules of a whole index."""
    return [f for path, manifest in walk(folder) for f in manifest_faults(path, manifest)]


def bom(shards: DataFrame) -> DataFrame:
    """Totals by manifest and licence, by manifest, and over all; ``level`` tells which."""
    flat = shards.withColumn("license", F.array_join(F.array_sort("licenses"), " AND "))
    out = flat.rollup("manifest", "license").agg(F.count(F.lit(1)).alias("shards"), *[F.sum(m).alias(m) for m in ("docs", "tokens", "bytes")], F.grouping_id().alias("level"))
    return out.select("level", "manifest", "license", "shards", "docs", "tokens", "bytes")


def disclosure_gaps(sources: DataFrame) -> DataFrame:
    """Missing statements by source, sorted: (section, field, name). ``sources`` has one column a field."""
    asked = {"data": ("url", "license", "category"), "collection": ("collected_from", "collected_to"), "content": ("languages", "modality")}
    gaps = [F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.struct(F.lit(s).alias("section"), F.lit(f).alias("field"))) for s, fields in asked.items() for f in fields if f in sources.columns]
    each = sources.select("name", F.explode(F.filter(F.array(*gaps), lambda x: x.isNotNull())).alias("g"))
    return each.select("g.section", "g.field", "name").orderBy("section", "field", "name")


def disclosed_corpora(uses: DataFrame) -> DataFrame:
    """(bom_sha256, corpus, uses, stages): every corpus once by its bill of materials, with the stages that use it, sorted. ``uses`` has (bom_sha256, corpus, stage), a row a use."""
    return uses.groupBy("bom_sha256").agg(F.min("corpus").alias("corpus"), F.count(F.lit(1)).alias("uses"), F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages"))


def gap_counts(gaps: DataFrame) -> DataFrame:
    """Gaps by section and field, sorted, with their number and the first name."""
    return gaps.groupBy("section", "field").agg(F.count(F.lit(1)).alias("gaps"), F.min("name").alias("first_name")).orderBy("section", "field")


def kept_publications(published: DataFrame, assembled: DataFrame) -> DataFrame:
    """(sha256, url, state): published objects that the assembly still has, and assembled ones that aren't published yet."""
    both = assembled.select("sha256").distinct().join(published.select("sha256", "url").dropDuplicates(["sha256"]), "sha256", "left")
    return both.select("sha256", "url", F.when(F.col("url").isNull(), "assembled").otherwise("published").alias("state"))
