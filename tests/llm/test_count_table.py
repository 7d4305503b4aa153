"""Token counts come from the count table, and none is lost with it."""

from loomwright.llm import tokens


def test_members_encode_what_the_table_lacks(spark):
    rows = spark.createDataFrame([(1, 1, "s", "en", "one two"), (2, 1, "s", "en", "three four five"), (3, 1, None, None, None)], "row_id bigint, ingested_at bigint, source string, language string, text string")
    corpora = spark.createDataFrame([("s", "web")], "corpus string, domain string")
    table = tokens.update_counts(None, rows.filter("row_id = 1"))
    got = {tuple(r) for r in tokens.members(rows, corpora, counts=table).collect()}
    assert {r[0] for r in got} == {1, 2, 3} and got == {tuple(r) for r in tokens.members(rows, corpora).collect()}


def test_queries_take_counts_from_the_table(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1, "s", "en", 2, "one two"), (2, 1, "s", "en", 900, "three"), (3, 1, "s", "en", None, "x")], "row_id bigint, ingested_at bigint, source string, language string, token_count bigint, text string")
    calls, real = [], tokens.update_counts
    monkeypatch.setattr(tokens, "update_counts", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert {r.row_id for r in tokens.wrong_counts(rows).collect()} == {2, 3}
    tokens.members(rows, spark.createDataFrame([("s", "web")], "corpus string, domain string"))
    assert len(calls) == 2
