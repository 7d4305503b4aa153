"""Forecasts of training resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Overhead of a run, share of memory that may be used, tokens a parameter.
OVERHEAD, MEMORY_SHARE, TOKENS_PER_PARAMETER = 1.08, 0.9, 20


def flops(parameters: Column, tokens: Column) -> Column:
    return F.lit(6.0) * parameters * tokens


def forecasts(runs: DataFrame, accelerators: DataFrame) -> DataFrame:
    """Seconds and memory fit of every run on every accelerator and GPU count; ``ordered_forecasts`` sorts them.

    The accelerator catalogue is the small side: a fixed list, checked by its size.
    """
    if accelerators.limit(1_001).count() > 1_000:
        raise ValueError("more than 1,000 accelerator profiles")
    both = runs.crossJoin(F.broadcast(accelerators))
    work = flops(F.col("parameters"), F.col("tokens"))
    default = work / (F.col("tflops") * 1e12 * F.col("gpus")) * OVERHEAD
    seconds = F.when(F.col("calibrated_flops_per_second") > 0, work / F.col("calibrated_flops_per_second")).otherwise(default)
    fits = F.col("parameters") * F.col("bytes_per_parameter") <= F.col("memory_bytes") * F.col("gpus") * MEMORY_SHARE
    return both.withColumn("seconds", seconds).withColumn("fits", fits)


def calibrations(evidence: DataFrame) -> DataFrame:
    """Achieved speed by accelerator and GPU count, with a digest of the ordered evidence."""
    row = F.struct("run_id", "flops", "seconds")
    return evidence.groupBy("accelerator", "gpus").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("flops").alias("flops"), F.sum("seconds").alias("seconds"), (F.sum("flops") / F.sum("seconds")).alias("flops_per_second"),
        # a set digest: sums of the rows' digests in 60-bit parts, so no group's evidence meets in one row
        F.sha2(F.concat_ws(":", *[F.sum(F.conv(F.substring(F.sha2(F.to_json(row), 256), 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]), 256).alias("evidence_sha256"),
    )


def calibrated(accelerators: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Profiles with the measured speed of their (accelerator, GPU count), 0 where none was measured."""
    measured = calibrations.select("accelerator", "gpus", F.col("flops_per_second").alias("__speed"))
    return accelerators.drop("calibrated_flops_per_second").join(measured, ["accelerator", "gpus"], "left").withColumn("calibrated_flops_per_second", F.coalesce("__speed", F.lit(0.0))).drop("__speed")


def ordered_forecasts(rows: DataFrame) -> DataFrame:
    """Slowest first, ties by manufacturer, accelerator and GPU count."""
    return rows.orderBy(F.desc("seconds"), *[c for c in ("manufacturer", "accelerator", "gpus") if c in rows.columns])


def recommended(presets: DataFrame, tokens: int) -> DataFrame:
    """The largest preset that the tokens suffice for."""
    return presets.filter(F.col("parameters") <= tokens // TOKENS_PER_PARAMETER).orderBy(F.desc("parameters"), "name").limit(1)
