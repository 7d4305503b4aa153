"""Mixes of sources to target weights by hierarchical budgets.

A plan asks shares of ``requested_tokens`` from sources. Leaves are (domain, language, source);
a source's weight goes to its languages in proportion to their tokens. Every leaf can give its
tokens ``max_repeats`` times. What a leaf can't give goes to its siblings of the same domain and
language, then to other languages of the domain, then to other domains, each time in proportion
to the weights of those that still have room. The first step, a leaf's own share against its room,
is done in exact fractions: a leaf that lacks any of its share makes its source short. A leaf's records come in seeded epochs, each a
permutation of the leaf, cut where the running token count reaches the budget.

Defined results: weights that are null or not positive count as 0; a source without rows has
capacity 0; null ``max_repeats`` counts as 1; plans without usable weights give no rows; a row
id counts once.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.tokens import RANKS_PATH, once, with_token_counts
from loomwright.runtime import ship

SEED = 20260

SHARES_SCHEMA = (
    "plan_id bigint, domain string, language string, source string, weight bigint, weight_sum decimal(38,0),"
    "requested_tokens bigint, available_tokens bigint, max_repeats int, asked double, budget double, actual_share double, lacks boolean"
)


def record_tokens(rows: DataFrame, path: str = RANKS_PATH, language: bool = True) -> DataFrame:
    """(row_id, source, language, n_tokens), each row id once."""
    flat = rows.select("row_id", "ingested_at", "source", (F.coalesce("language", F.lit("")) if language else F.lit("")).alias("language"), "text")
    counted = with_token_counts(flat, "text", ["row_id", "ingested_at", "source", "language"], path=path)
    return once(counted, "row_id", "ingested_at", "source", "language", "n_tokens")


def demands(plans: DataFrame) -> DataFrame:
    """(plan_id, source, weight, weight_sum, requested_tokens, max_repeats), a row a weighted source."""
    one = plans.select("plan_id", F.coalesce("requested_tokens", F.lit(0)).alias("requested_tokens"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), F.explode("corpus_weights").alias("source", "weight"))
    one = one.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)))
    total = F.sum(F.col("weight").cast("decimal(38,0)")).over(Window.partitionBy("plan_id"))
    return one.withColumn("weight_sum", total).filter("weight_sum > 0")


def _fill(room: dict, weight: dict, amount: float) -> dict:
    """Give ``amount`` to members in proportion to their weights, nobody beyond its room."""
    given = dict.fromkeys(room, 0.0)
    live = [k for k in room if room[k] > 0 and weight[k] > 0]
    while live and amount > 1e-9:
        total = sum(weight[k] for k in live)
        full = [k for k in live if amount * weight[k] / total >= room[k] - given[k]]
        if not full:
            for k in live:
                given[k] += amount * weight[k] / total
            return given
        for k in full:
            amount -= room[k] - given[k]
            given[k] = room[k]
        live = [k for k in live if k not in full]
    return given


def _own_shares(leaves: pd.DataFrame) -> dict:
    """The exact share that every leaf is asked for: its source's, in proportion to its tokens."""
    of = leaves.groupby("source", dropna=False).available_tokens
    total, count = of.transform("sum"), of.transform("size")
    return {
        k: Fraction(int(requested) * int(weight), int(weight_sum)) * (Fraction(int(mine), int(every)) if every else Fraction(1, int(n)))
        for k, requested, weight, weight_sum, mine, every, n in zip(leaves.index, leaves.requested_tokens, leaves.weight, leaves.weight_sum, leaves.available_tokens, total, count)
    }


def _budget(leaves: pd.DataFrame) -> pd.DataFrame:
    """Budgets of one plan's leaves: shortages move to siblings before ancestors."""
    room = {k: int(a) * int(r) for k, a, r in zip(leaves.index, leaves.available_tokens, leaves.max_repeats)}
    share = _own_shares(leaves)
    own = {k: min(share[k], room[k]) for k in room}
    leaves["asked"] = [float(share[k]) for k in leaves.index]
    leaves["lacks"] = [own[k] < share[k] for k in leaves.index]
    given, short = {k: float(x) for k, x in own.items()}, {k: float(share[k] - own[k]) for k in room}
    share = {k: float(x) for k, x in share.items()}
    levels = [["domain", "language"], ["domain"], []]
    for keys in levels:
        groups = leaves.groupby(keys, dropna=False).groups.values() if keys else [leaves.index]
        for group in groups:
            missing = sum(short[k] for k in group)
            if missing <= 1e-9:
                continue
            more = _fill({k: room[k] - given[k] for k in group}, {k: share[k] for k in group}, missing)
            moved = sum(more.values())
            for k in group:
                given[k] += more[k]
                short[k] *= 1 - moved / missing
    leaves["budget"] = [given[k] for k in leaves.index]
    total = leaves.budget.sum()
    leaves["actual_share"] = leaves.budget / total if total else 0.0
    return leaves


def mix_budgets(plans: DataFrame, tokens: DataFrame, corpora: DataFrame) -> DataFrame:
    """Budget and actual share of every leaf of every plan.

    ``tokens`` is aggregated to (source, language) first; a plan has at most as many leaves as
    the catalogue has sources times languages, so a plan's group is bounded by the catalogue.
    """
    ship(plans.sparkSession)
    sums = tokens.groupBy("source", "language").agg(F.sum("n_tokens").alias("available_tokens"))
    domains = corpora.select(F.col("corpus").alias("source"), "domain").dropDuplicates(["source"])
    leaves = demands(plans).join(sums, "source", "left").join(domains, "source", "left")
    leaves = leaves.fillna({"available_tokens": 0, "language": "", "domain": ""})
    leaves = leaves.select("plan_id", "domain", "language", "source", "weight", "weight_sum", "requested_tokens", "available_tokens", F.col("max_repeats").cast("int").alias("max_repeats"), F.lit(0.0).alias("asked"), F.lit(0.0).alias("budget"), F.lit(0.0).alias("actual_share"), F.lit(False).alias("lacks"))
    return leaves.groupBy("plan_id").applyInPandas(_budget, SHARES_SCHEMA)


def mix_shares(budgets: DataFrame) -> DataFrame:
    """Asked and actual share of every weighted source, and whether its leaves lack any of it after their own share."""
    by = budgets.groupBy("plan_id", "source").agg(
        F.first("weight").alias("weight"), F.first("weight_sum").alias("weight_sum"), F.first("requested_tokens").alias("requested_tokens"), F.first("max_repeats").alias("max_repeats"),
        F.sum("available_tokens").alias("available_tokens"), F.sum("budget").alias("budget"), F.sum("actual_share").alias("actual_share"), F.bool_or("lacks").alias("short"),
    )
    gives = (F.col("available_tokens").cast("decimal(19,0)") * F.col("max_repeats").cast("decimal(10,0)")) / F.col("requested_tokens").cast("decimal(38,0)")
    return by.select("plan_id", "source", (F.col("weight") / F.col("weight_sum").cast("double")).alias("asked_share"), "actual_share", F.col("budget").alias("budget_tokens"), "available_tokens", F.when(F.col("requested_tokens") > 0, gives.cast("double")).alias("reachable_share"), "short")


def mix_selection(budgets: DataFrame, tokens: DataFrame, seed: int = SEED) -> DataFrame:
    """The records of each leaf: (plan_id, source, row_id, repeats), repeats being the epochs that hold it.

    Whole epochs need no order: every record of the leaf is taken floor(budget / tokens) times.
    Only the last, partial epoch is a token prefix of a seeded permutation. The prefix is found
    in two steps, so that no task orders a whole leaf: 4,096 hash buckets are summed and ranked,
    and records are ordered within their bucket alone.
    """
    leaf = ["plan_id", "domain", "language", "source"]
    wanted = budgets.filter("budget > 0").select(*leaf, "budget", "available_tokens")
    wanted = wanted.withColumn("epochs", F.floor(F.col("budget") / F.col("available_tokens"))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available_tokens"))
    scored = wanted.join(tokens, ["source", "language"]).filter("n_tokens > 0")
    order = F.xxhash64(F.lit(seed), "plan_id", F.col("epochs"), "row_id")
    scored = scored.withColumn("score", order).withColumn("bucket", F.shiftrightunsigned(F.col("score").bitwiseXOR(F.lit(-(2**63))), 52))
    sums = scored.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("before", before).drop("s")
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*leaf, "bucket").orderBy("score", "row_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = scored.withColumn("inner", inner).join(starts, [*leaf, "bucket"])
    taken = (F.col("before") + F.col("inner") < F.col("rest")).cast("int")
    out = placed.select("plan_id", "source", "row_id", "n_tokens", (F.col("epochs") + taken).cast("int").alias("repeats"))
    return out.filter("repeats > 0")
