"""Telemetry of runs: latest values, changes and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative changes of held-out loss from which advice is given.
STOP, INSPECT, NOTE = 0.25, 0.05, -0.05


def latest(series: DataFrame, by: list[str], at: list[str], values: list[str]) -> DataFrame:
    """Last present value of each column, and its first; map-side combinable."""
    order = F.struct(*at)
    present = lambda v: F.when(F.col(v).isNotNull(), order)
    return series.groupBy(*by).agg(*[F.max_by(v, present(v)).alias(f"last_{v}") for v in values], *[F.min_by(v, present(v)).alias(f"first_{v}") for v in values])


def relative_change(first: Column, last: Column) -> Column:
    return F.when(first != 0, (last - first) / first)


def advice(change: Column) -> Column:
    return F.when(change > STOP, "stop").when(change > INSPECT, "inspect").when(change < NOTE, "note").otherwise("none")


def held_out_loss(rows: DataFrame, by: list[str], loss: str = "loss", mask: str = "mask") -> DataFrame:
    """Mean loss over supervised targets, and its perplexity."""
    mean = F.sum(F.col(loss) * F.col(mask)) / F.nullif(F.sum(mask), F.lit(0))
    return rows.groupBy(*by).agg(mean.alias("loss")).withColumn("perplexity", F.exp(F.least(F.col("loss"), F.lit(80.0))))


def active_seconds(attempts: Column, run_start: Column, run_stop: Column) -> Column:
    """Positive spans of all attempts; the run's own span where there are none."""
    span = lambda a, b: F.greatest(b.cast("double") - a.cast("double"), F.lit(0.0))
    total = F.aggregate(attempts, F.lit(0.0), lambda acc, x: acc + F.coalesce(span(x["started"], x["finished"]), F.lit(0.0)))
    return F.when(total > 0, total).otherwise(span(run_start, run_stop))


#: What a run's state alone advises, and seconds without telemetry from which a run is looked at.
BASE_ADVICE = {"running": "let-run", "failed": "fix", "interrupted": "fix", "complete": "complete"}
SILENT_SECONDS = 600


def run_advice(runs: DataFrame, now: Column) -> DataFrame:
    """(run, action, findings) of runs with (run, state, loss, first_heldout, last_heldout, observed_at, step, planned_steps, error).

    A loss that is no number stops a run; a held-out loss that got much worse too; a smaller
    worsening, or silence, sends a look at a run that would be let run.
    """
    base = F.lit("wait")
    for state, action in BASE_ADVICE.items():
        base = F.when(F.col("state") == state, action).otherwise(base)
    broken = F.coalesce(F.isnan("loss") | F.col("loss").isin(float("inf"), float("-inf")), F.lit(False))
    change = F.when(F.col("first_heldout") > 0, F.col("last_heldout") / F.col("first_heldout") - 1)
    worse, watch, better = F.coalesce(change > STOP, F.lit(False)), F.coalesce((change > INSPECT) & (change <= STOP), F.lit(False)), F.coalesce(change < NOTE, F.lit(False))
    silent = F.coalesce((F.col("state") == "running") & (now.cast("double") - F.col("observed_at").cast("double") > SILENT_SECONDS), F.lit(False))
    action = F.when(broken | worse, "stop").when((base == "let-run") & (watch | silent), "inspect").otherwise(base)
    told = {
        "loss-not-finite": broken, "heldout-worse": worse, "heldout-slightly-worse": watch & (base == "let-run") & ~broken, "heldout-better": better,
        "no-telemetry": silent & ~broken & ~worse & ~watch, "progress": F.coalesce((F.col("step") > 0) & (F.col("planned_steps") > 0), F.lit(False)), "error": F.coalesce(F.col("error") != "", F.lit(False)),
    }
    findings = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in told.items()]), lambda x: x.isNotNull())
    progress = F.when(F.col("planned_steps") > 0, F.least(F.lit(100.0), 100.0 * F.col("step") / F.col("planned_steps")))
    return runs.select("run", action.alias("action"), F.array_join(findings, ",").alias("findings"), progress.alias("progress_percent"))


def observation_faults(observed: DataFrame) -> DataFrame:
    """(run, rule) of observations outside the bounds that their plan sets."""
    rules = {
        "steps": (F.col("steps") < 0) | (F.col("steps") > F.col("planned_steps")), "tokens": (F.col("consumed_tokens") < 0) | (F.col("consumed_tokens") > F.col("planned_tokens")),
        "loss": F.isnan("final_loss") | F.col("final_loss").isin(float("inf"), float("-inf")) | (F.col("final_loss") < 0), "times": F.col("finished_at") < F.col("started_at"),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return observed.select("run", F.explode(broken).alias("rule"))
