"""Exact deduplication by content and effective licence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.runtime import running_before

KEY = ["content_sha256", "license"]


def identified(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with the hex digest of their text; redaction comes before this."""
    return rows.withColumn("content_sha256", F.sha2(text, 256))


def survivors(rows: DataFrame, *order: str) -> DataFrame:
    """The first row of every (content, licence) in plan order.

    Only digests and order keys are aggregated, so a group of copies of any size is one row on
    every mapper; the text comes back by the semi join on the winner's own key.
    """
    first = rows.groupBy(*KEY).agg(F.min(F.struct(*order)).alias("first")).select(*KEY, *[F.col("first")[o].alias(o) for o in order])
    return rows.join(first, [*KEY, *order], "left_semi")


def without_seed(rows: DataFrame, seed: DataFrame) -> DataFrame:
    """Rows whose identity isn't known yet."""
    return rows.join(seed.select(*KEY).distinct(), KEY, "left_anti")


def groups(rows: DataFrame, id_column: str) -> DataFrame:
    """Digests that several rows share, whatever their licence, with their count and first id."""
    return rows.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("copies"), F.min(id_column).alias("first_id")).filter("copies > 1")


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Position of each row among its copies (1 is the survivor); a hot group of copies is many tasks."""
    return running_before(rows, list(order), F.lit(1), "copy_no", KEY).withColumn("copy_no", (F.col("copy_no") + 1).cast("int"))


def unique_totals(rows: DataFrame) -> DataFrame:
    """Documents and bytes by licence after deduplication; copies are equal, so digests and lengths suffice and no text moves."""
    once = rows.groupBy(*KEY).agg(F.min(F.octet_length("text")).alias("bytes"))
    return once.groupBy("license").agg(F.count(F.lit(1)).alias("docs"), F.sum("bytes").alias("bytes"))


def totals(rows: DataFrame) -> DataFrame:
    """Seen, kept and duplicate rows."""
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("seen"), F.count(F.lit(1)).alias("kept"), (F.sum("n") - F.count(F.lit(1))).alias("duplicate"))
