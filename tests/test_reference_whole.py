"""The full outer comparison of shards and references over whole tables."""

import os
from collections import Counter

import pytest

import __spark_entry__
from loomwright.operators import catalog


def test_states(spark):
    inventory, references = spark.createDataFrame([(1,), (7,), (9,)], "shard_id bigint"), spark.createDataFrame([(1,), (7,), (7,), (70,)], "shard_id bigint")
    got = {tuple(r) for r in catalog.reference_state(inventory, references, "shard_id").collect()}
    assert got == {(1, "referenced", 1), (7, "referenced", 2), (9, "unreferenced", 0), (70, "missing", 1)}


def test_query_compares_whole_tables(spark, tmp_path):
    spark.createDataFrame([(1,), (7,), (9,)], "shard_id bigint").write.parquet(str(tmp_path / "shards.parquet"))
    spark.createDataFrame([(1,), (7,), (7,), (70,), (None,)], "shard_id bigint").write.parquet(str(tmp_path / "text_rows.parquet"))
    got = {tuple(r) for r in __spark_entry__.queries()["reference_full_outer"](spark, str(tmp_path)).collect()}
    assert got == {(1, "referenced", 1), (7, "referenced", 2), (9, "unreferenced", 0), (70, "missing", 1)}
