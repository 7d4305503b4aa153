"""Weighted interleave over every corpus and row."""

import os
from fractions import Fraction

import pytest

import __spark_entry__
from loomwright.operators import training


def greedy(rows, weights):
    """rows: (corpus, id, tokens) in order; the merge by exact fractions."""
    queue = {c: [r for r in rows if r[0] == c] for c in weights}
    emitted, out = dict.fromkeys(weights, 0), []
    while any(queue.values()):
        c = min((c for c in queue if queue[c]), key=lambda c: (Fraction(emitted[c], weights[c]), c))
        r = queue[c].pop(0)
        emitted[c] += r[2] + 1
        out.append(r[:2])
    return out


@pytest.mark.parametrize("weights", [{f"c{i:02}": 11 + i % 11 for i in range(23)}, {"a": 999_999_999, "b": 999_999_998, "c": 1_000_000_000, "d": 7}])
def test_many_and_large_weights(spark, weights):
    rows = [(c, i, (i * 7 + k * 3) % 9 + (10**12 if "d" in weights and i == 2 else 0)) for k, c in enumerate(weights) for i in range(9)]
    df = spark.createDataFrame(rows, "corpus string, i int, tokens bigint")
    w = spark.createDataFrame(list(weights.items()), "corpus string, weight bigint")
    got = training.weighted_rank(training.interleaved(df, w, ["i"]), ["i"]).orderBy("position").collect()
    assert [(r.corpus, r.i) for r in got] == greedy(rows, weights)


def test_query_covers_every_row(spark):
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("test tables aren't here")
    first = {}
    for r in pq.read_table(f"{d}/text_rows.parquet", columns=["row_id", "ingested_at", "source", "token_count", "text"]).to_pylist():
        key = (r["ingested_at"], r["source"], -1 if r["token_count"] is None else r["token_count"], len((r["text"] or "").encode()))
        first[r["row_id"]] = min(first.get(r["row_id"], key), key)
    rows = sorted((f[1], i, f[2] if f[2] >= 0 else f[3]) for i, f in first.items())
    wanted = greedy(rows, {c: len(c) for c in {r[0] for r in rows}})
    got = __spark_entry__.queries()["weighted_interleave_order"](spark, d).orderBy("position").collect()
    assert [(r.corpus, r.row_id) for r in got] == wanted
