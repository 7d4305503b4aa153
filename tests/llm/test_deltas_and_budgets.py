"""Deltas equal recomputation, removals included; shortage comes out of the budgets."""

import random

import pandas as pd
from pyspark.sql import functions as F

from loomwright.llm import mixing, tokens

SCHEMA = "row_id bigint, source string, language string, domain string, content_hash string, n_tokens bigint"


def test_deliveries_equal_recomputation(spark):
    first = [(i, f"s{i % 3}", ["en", None][i % 2], "d", f"h{i}", i) for i in range(12)]
    state = spark.createDataFrame(first, SCHEMA)
    arrived = [(3, "s9", "de", None, "hx", 50), (4, *first[4][1:]), (20, "s1", "en", "d", "h1", 1)]  # changed, as it stood, new
    removed = spark.createDataFrame([(0,), (5,), (77,)], "row_id bigint")
    cube = tokens.apply_delta(None, tokens.cube_delta(None, state))
    delta, after = tokens.deliver(state, spark.createDataFrame(arrived, SCHEMA), removed)
    wanted = sorted(map(str, [r for r in first if r[0] not in (0, 3, 5)] + [arrived[0], arrived[2]]))
    assert sorted(str(tuple(r)) for r in after.collect()) == wanted
    moved = {tuple(r) for r in tokens.apply_delta(cube, delta).collect()}
    assert moved == {tuple(r) for r in tokens.apply_delta(None, tokens.cube_delta(None, after)).collect()}
    # cells that no changed row touches are not in the delta
    assert ("s2", "en", "d") not in {(r.source, r.language, r.domain) for r in delta.collect() if r.tokens > 0}
    none, emptied = tokens.deliver(after, None, after.select("row_id"))
    assert emptied.count() == 0 and tokens.apply_delta(cube, delta.unionByName(none)).count() == 0


def test_counts_of_gone_content_go(spark):
    table = spark.createDataFrame([("h1", "t", 3), ("h2", "t", 4)], "content_hash string, tokenizer_hash string, n_tokens bigint")
    state = spark.createDataFrame([(1, "s", "en", "d", "h1", 3), (2, "s", "en", "d", "h1", 3)], SCHEMA)
    assert [r.content_hash for r in tokens.prune_counts(table, state).collect()] == ["h1"]


def _leaves(rng):
    rows, weights = [], {f"s{i}": rng.randint(0, 9) * 10 ** rng.randint(0, 12) for i in range(5)}
    total = sum(weights.values()) or 1
    requested = rng.choice([0, 1, 7, 10**6, 10**17])
    for source, weight in weights.items():
        for language in rng.sample(["en", "de", ""], rng.randint(1, 3)):
            rows.append((1, rng.choice(["d1", "d2"]), language, source, weight, total, requested, rng.choice([0, 3, 10**5, 10**16]), rng.randint(1, 3)))
    return pd.DataFrame(rows, columns="plan_id domain language source weight weight_sum requested_tokens available_tokens max_repeats".split()), weights, total, requested


def test_short_sources_are_those_whose_leaves_lack(spark):
    rng = random.Random(3)
    for _ in range(300):
        leaves, weights, total, requested = _leaves(rng)
        got = mixing._budget(leaves.copy())
        for source, part in got.groupby("source"):
            tokens_of, repeats = int(part.available_tokens.sum()), None
            by_leaf = part.max_repeats.nunique() == 1
            if by_leaf:
                repeats = int(part.max_repeats.iloc[0])
                assert bool(part.lacks.any()) == (repeats * tokens_of * total < requested * weights[source])
        assert got.budget.sum() <= requested * 1.000001 and (got.budget <= got.available_tokens * got.max_repeats * 1.000001).all()


def test_an_exact_fit_is_not_short(spark):
    plans = spark.createDataFrame([(1, {"a": 1, "b": 2}, 3 * 10**17, 3), (2, {"a": 1, "b": 2}, 9 * 10**17 + 3, 3)], "plan_id bigint, corpus_weights map<string,bigint>, requested_tokens bigint, max_repeats int")
    rows = spark.createDataFrame([(1, "a", "en", 10**17), (2, "b", "en", 10**17), (3, "b", "de", 10**17)], "row_id bigint, source string, language string, n_tokens bigint")
    corpora = spark.createDataFrame([("a", "x"), ("b", "x")], "corpus string, domain string")
    short = mixing.mix_shares(mixing.mix_budgets(plans, rows, corpora)).filter("short").select("plan_id", "source")
    assert {tuple(r) for r in short.collect()} == {(2, "a"), (2, "b")}
    assert mixing.mix_shares(mixing.mix_budgets(plans, rows, corpora).withColumn("lacks", F.lit(False))).filter("short").count() == 0
