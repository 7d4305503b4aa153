"""Keys of any spelling project apart from each other, and unreadable rows are told."""

import json

from pyspark.sql import functions as F

from loomwright.operators import drift


def _table(spark, rows):
    files = spark.createDataFrame([(1, "s", 1)], "file_id bigint, stream string, file_seq int")
    data = spark.createDataFrame([(1, i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "file_id bigint, line_no bigint, payload string").withColumn("doc", F.lit("clash"))
    stats = drift.statistics_once(data)
    projection = drift.Projection(stats, drift.changes(files, stats))
    return projection, {r.line_no: r for r in projection.table(data, keep_unreadable=True).collect()}


def test_keys_of_any_spelling(spark):
    rows = [{"author.name": "x", "name": "WRONG"}, {"author.name": "y"}, {"o'hara": 1, "a.b": "dot", "a_b": "under", 'q"t': "quote", "back\\slash": "b"}, {"meta": {"k.l": "m", "it's": 2}}]
    projection, got = _table(spark, rows)
    by_field = {name: column for column, name in projection.column_names().items()}
    assert got[0][by_field["author.name"]] == "x" and got[0][by_field["name"]] == "WRONG" and got[1][by_field["author.name"]] == "y" and got[1][by_field["name"]] is None
    assert got[2][by_field["o'hara"]] == 1 and {got[2][by_field["a.b"]], got[2][by_field["a_b"]]} == {"dot", "under"} and by_field["a.b"] != by_field["a_b"]
    assert got[2][by_field['q"t']] == "quote" and got[2][by_field["back\\slash"]] == "b"
    assert got[3][by_field["meta.k.l"]] == "m" and got[3][by_field["meta.it's"]] == 2
    assert all(not r.failed_casts for r in got.values())


def test_unreadable_rows_are_told(spark):
    _, got = _table(spark, [{"a": 1}, "{broken", None, "[1]", {"a": "word"}, {"a": 2}])
    assert len(got) == 6 and [got[i].failed_casts[0].field for i in (1, 2, 3)] == ["", "", ""] and got[1].failed_casts[0].raw == "{broken"
    assert got[4].a is None and got[4].failed_casts[0].raw == '"word"' and not got[0].failed_casts
