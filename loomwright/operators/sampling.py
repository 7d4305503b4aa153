"""Deterministic held-out selection and budget samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import hashing, text

#: Defaults of the evaluation split and of calibration.
FRACTION, MAX_RECORDS, MAX_BYTES = 0.01, 256, 1 << 20
CALIBRATION_BYTES, CALIBRATION_SEED = 100_000, 42


def desired(n: int, fraction: float = FRACTION, most: int = MAX_RECORDS) -> int:
    """Records to hold out: the fraction, rounded up, one at least and never all."""
    from math import ceil

    return 0 if n < 2 or not fraction or not most else max(1, min(ceil(n * fraction), most, n - 1))


def scored(rows: DataFrame, key: str, seed: int) -> DataFrame:
    return rows.withColumn("score", hashing.evaluation_score(seed, F.col(key).cast("string")))


def _within_bytes(candidates: DataFrame, order: list[str], wanted: int, most: int) -> DataFrame:
    """Greedy byte budget in order: a record that is too large is skipped and the next one tried.

    The fold is sequential, but over ``MAX_RECORDS`` candidates at most, which were selected by a
    distributed top-k before.
    """
    listed = candidates.agg(F.array_sort(F.collect_list(F.struct(*order, "selection_id", "bytes"))).alias("all"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("ids"))

    def step(acc, x):
        fits = (acc["used"] + x["bytes"] <= most) & (F.size(acc["ids"]) < wanted)
        return F.when(fits, F.struct((acc["used"] + x["bytes"]).cast("bigint").alias("used"), F.concat(acc["ids"], F.array(x["selection_id"])).alias("ids"))).otherwise(acc)

    return listed.select(F.explode(F.aggregate("all", start, step)["ids"]).alias("selection_id"))


def held_out(rows: DataFrame, key: str, seed: int, fraction: float = FRACTION, most_records: int = MAX_RECORDS, most_bytes: int = MAX_BYTES) -> DataFrame:
    """(selection_id) of the records with the lowest seeded digests, within a byte budget."""
    wanted = desired(rows.count(), fraction, most_records)
    pool = scored(rows.select(F.col(key).cast("string").alias("selection_id"), F.octet_length("text").cast("bigint").alias("bytes")), "selection_id", seed)
    top = pool.orderBy("score", "selection_id").limit(most_records)
    return _within_bytes(top, ["score"], wanted, most_bytes)


def held_out_stratified(rows: DataFrame, key: str, corpus: str, seed: int, fraction: float = FRACTION, most_records: int = MAX_RECORDS, most_bytes: int = MAX_BYTES) -> DataFrame:
    """The same, round robin over the sorted corpora by each one's rank."""
    wanted = desired(rows.count(), fraction, most_records)
    pool = scored(rows.select(F.col(key).cast("string").alias("selection_id"), F.col(corpus).alias("corpus"), F.octet_length("text").cast("bigint").alias("bytes")), "selection_id", seed)
    rank = F.row_number().over(Window.partitionBy("corpus").orderBy("score", "selection_id"))
    top = pool.withColumn("rank", rank).filter(F.col("rank") <= most_records).orderBy("rank", "corpus").limit(most_records)
    return _within_bytes(top, ["rank", "corpus"], wanted, most_bytes)


def training_part(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    return rows.join(held.select(F.col("selection_id").alias("__s")), F.col(key).cast("string") == F.col("__s"), "left_anti")


def evaluation_part(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    return rows.join(held.select(F.col("selection_id").alias("__s")), F.col(key).cast("string") == F.col("__s"), "left_semi")


def evaluation_digest(held: DataFrame) -> DataFrame:
    return held.agg(hashing.ordered_digest(F.col("selection_id")).alias("evaluation_sha256"), F.count(F.lit(1)).alias("records"))


def calibration_order(shards: DataFrame, seed: int = CALIBRATION_SEED) -> DataFrame:
    """Unique shards in seeded order."""
    return shards.select("sha256").filter(F.col("sha256").isNotNull()).dropDuplicates(["sha256"]).withColumn("score", hashing.calibration_score(seed, F.col("sha256")))


def calibration_sample(rows: DataFrame, order: list[str], budget: int = CALIBRATION_BYTES) -> DataFrame:
    """Records in order until a byte budget is spent, the last one truncated at a character.

    A truncation can leave up to three bytes, which the next records' first characters may
    still fit; as a character takes four bytes at most, only records that start within the
    budget are looked at. Buckets of the order key are summed first, so no task sorts all rows:
    rows past the bucket in which the budget ends are dropped before the ordered window.
    """
    sized = rows.withColumn("bytes", F.octet_length("text").cast("bigint")).filter("bytes > 0")
    bucket = F.substring(order[0], 1, 3)
    starts = sized.groupBy(bucket.alias("bucket")).agg(F.sum("bytes").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = starts.withColumn("before", before).filter(F.col("before") < budget).select("bucket", "before")
    near = sized.withColumn("bucket", bucket).join(needed, "bucket")
    inner = F.coalesce(F.sum("bytes").over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = near.withColumn("start", F.col("before") + inner).filter(F.col("start") < budget)
    cut = text.truncate_utf8(F.col("text"), F.least(F.col("bytes"), F.lit(budget) - F.col("start")).cast("int"))
    return placed.withColumn("sample", cut).filter(F.octet_length("sample") > 0)
