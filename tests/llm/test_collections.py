"""Operators on collections, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import leakage, mixing, nearcopies

WORDS = "amber ledger quarry lantern willow copper vessel granite stairs harbour mirror packing index digest margin steward valley orchard ferry mill".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(n))


def test_golay_code():
    words = [nearcopies.codeword(m) for m in range(4096)]
    assert min(bin(w).count("1") for w in words if w) == 7
    rng = np.random.default_rng(1)
    for m in rng.integers(0, 4096, 50):
        errors = sum(1 << int(b) for b in rng.choice(23, 3, replace=False))
        assert nearcopies.nearest_codewords(np.array([words[m] ^ errors]))[0] == m  # three errors are corrected


def test_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = _text(rng, 90).split()
        texts.append(" ".join(base))
        for edits in (0, 1, 4, 9, 20):
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(len(other))] = _text(rng, 1)
            texts.append(" ".join(other).upper() + "  ")
    texts += [None, "", "short", texts[0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    df = spark.createDataFrame(rows, "row_id bigint, text string").withColumn("a", F.lit("clash")).withColumn("key", F.lit(1))
    search = nearcopies.NearCopies(df)
    got = {(r.row_id_a, r.row_id_b) for r in search.links().collect()}

    def shingles(t):
        t = nearcopies.normal(t)
        return {t[i : i + 5] for i in range(len(t) - 4)}

    kept = [(i, nearcopies.normal(t), shingles(t)) for i, t in enumerate(texts) if t and len(nearcopies.normal(t)) >= 500]
    pairs, copies = set(), {}
    for i, t, _ in kept:
        copies.setdefault(t, []).append(i)
    first = {t: min(ids) for t, ids in copies.items()}
    for x in range(len(kept)):
        for y in range(x + 1, len(kept)):
            (i, s, a), (j, t, b) = kept[x], kept[y]
            if s == t:
                if first[s] in (i, j):
                    pairs.add((i, j))
            elif len(a & b) >= 0.75 * len(a | b) and (first[s] == i or first[t] == j):
                pairs.add((i, j))
    assert got <= pairs and len(got) >= 0.97 * len(pairs)
    classes = {r.row_id: r.class_id for r in search.documents().collect()}
    assert classes[len(texts) - 1] == 0 and classes[0] == 0


def test_near_copies_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (None, "x" * 600), (None, "x" * 600)], "row_id bigint, text string")
    assert nearcopies.NearCopies(df).links().count() == 0


def test_subsequence():
    assert leakage.common_subsequence("abcde", "axcye") == 3 and leakage.common_subsequence([], "x") == 0 and leakage.common_subsequence(["a", "b"], ["b", "a"]) == 1


def test_leaks(spark):
    rng = random.Random(2)
    items = [(i, "en", _text(rng, 40)) for i in range(12)] + [(99, "zh", "学堂的女学生随后要算出去河边的路向铜壶借来六十七盏灯笼然后平分枚铜钱回到山上的灯塔旁边量出距离"), (98, "en", None), (97, None, "")]
    noise = [_text(rng, 120) for _ in range(60)]
    w = items[3][2].split()
    docs = [(i, t) for i, t in enumerate(noise)]
    docs += [(100, noise[0] + " " + items[3][2] + " " + noise[1]), (101, noise[2] + " " + " ".join(w[5:18]).upper() + ", " + noise[3]), (102, noise[4] + " " + " ".join(w[5:17]) + " " + noise[5]), (103, None), (104, ""), (105, "报告说：" + items[12][2][4:34] + "。完")]
    docs += [(106, "看见" + items[12][2][4:29] + "。完"), (107, noise[6] + " " + " ".join(w[:6]) + " ** " + "_".join(w[6:14]) + " " + noise[7])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id bigint, lang string, text string").withColumn("kind", F.lit(1))
    found = leakage.leaks(d, i).filter("kind = 'exact'")
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(100, 3), (101, 3), (105, 99), (107, 3)}
    assert leakage.leaks(d.limit(0), i).count() == 0
    assert leakage.leaks(d, i.filter("item_id = 98")).count() == 0


def _plans(spark, weights, requested, repeats):
    return spark.createDataFrame([(1, weights, requested, repeats), (2, {}, 10, 1), (3, None, 10, 1)], "plan_id bigint, corpus_weights map<string,bigint>, requested_tokens bigint, max_repeats int")


def test_mix(spark):
    corpora = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("c", "d2"), ("gone", "d2")], "corpus string, domain string")
    tokens = spark.createDataFrame([(n, s, l, t) for n, (s, l, t) in enumerate([("a", "en", 10)] * 3 + [("b", "en", 100)] * 4 + [("c", "de", 50)] * 10)], "row_id bigint, source string, language string, n_tokens bigint")
    budgets = mixing.mix_budgets(_plans(spark, {"a": 1, "b": 1, "c": 1, "gone": 1}, 1000, 2), tokens, corpora)
    shares = {r.source: r for r in mixing.mix_shares(budgets).collect()}
    assert {s for s, r in shares.items() if r.short} == {"a", "gone"}
    # a gives its 60; its sibling b takes the 190 that lack, the ancestor's other child c those of gone
    assert {s: round(r.budget_tokens) for s, r in shares.items()} == {"a": 60, "b": 440, "c": 500, "gone": 0}
    assert round(sum(r.actual_share for r in shares.values()), 6) == 1
    chosen = mixing.mix_selection(budgets, tokens).collect()
    assert max(r.repeats for r in chosen) <= 2 and {r.row_id for r in chosen if r.source == "a"} == {0, 1, 2}
    for s, r in shares.items():
        taken = sum(c.repeats * c.n_tokens for c in chosen if c.source == s)
        assert r.budget_tokens <= taken + 1e-6 and taken < r.budget_tokens + 100
    again = mixing.mix_selection(budgets, tokens).collect()
    assert sorted(map(str, chosen)) == sorted(map(str, again))


def test_mix_edges(spark):
    corpora = spark.createDataFrame([("a", None)], "corpus string, domain string")
    none = spark.createDataFrame([], "row_id bigint, source string, language string, n_tokens bigint")
    budgets = mixing.mix_budgets(_plans(spark, {"a": 3, "b": 0}, 100, None), none, corpora)
    assert {(r.source, r.short) for r in mixing.mix_shares(budgets).collect()} == {("a", True), ("b", False)}
    exact = spark.createDataFrame([(1, "a", "en", 50)], "row_id bigint, source string, language string, n_tokens bigint")
    met = mixing.mix_budgets(_plans(spark, {"a": 3}, 100, 2), exact, corpora)
    assert [r.short for r in mixing.mix_shares(met).collect()] == [False]


@pytest.mark.parametrize("room", [{"x": 5, "y": 0}, {"x": 100, "y": 100}])
def test_fill(room):
    given = mixing._fill(room, {"x": 1.0, "y": 3.0}, 40)
    assert all(given[k] <= room[k] for k in room) and abs(sum(given.values()) - min(40, sum(room.values()))) < 1e-6
