"""Run logs and resumable rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stage_durations(events: DataFrame, stage: str, at: str) -> DataFrame:
    """First and last stamp of each stage, how often it reported, and the microseconds between."""
    return events.groupBy(stage).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("updates"), (F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))).alias("micros"))


def resumable(rounds: DataFrame, run: str, number: str, first: int = 1) -> DataFrame:
    """The rounds of each run up to its first gap."""
    distinct = rounds.select(run, number).where(F.col(number) >= first).distinct()
    at = F.row_number().over(Window.partitionBy(run).orderBy(number)) + (first - 1)
    return distinct.withColumn("__at", at).where(F.col("__at") == F.col(number)).drop("__at")


def running_sizes(rounds: DataFrame, run: str, number: str, selected: str, seed: int) -> DataFrame:
    """Training set size before and after each round."""
    after = F.lit(seed) + F.sum(selected).over(Window.partitionBy(run).orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rounds.withColumn("size_after", after).withColumn("size_before", F.col("size_after") - F.col(selected))


def marginal_gain(series: DataFrame, by: str, budget: str, value: str) -> DataFrame:
    """Difference quotient of the value along the budget."""
    o = Window.partitionBy(by).orderBy(budget)
    return series.withColumn("gain", (F.lag(value).over(o) - F.col(value)) / (F.col(budget) - F.lag(budget).over(o)))


def relative_change(series: DataFrame, by: str, order: str, value: str) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return series.withColumn("change", F.abs(F.col(value) - before) / F.greatest(F.abs(before), F.lit(1e-30)))


def best_so_far(series: DataFrame, by: str, order: str, value: str, tolerance: float) -> DataFrame:
    """Least value up to each row, its improvement over the first one, and whether the last step gained under `tolerance`."""
    o = Window.partitionBy(by).orderBy(order)
    best = F.min(value).over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = series.withColumn("best", best).withColumn("improvement", 1.0 - F.col("best") / F.greatest(F.first(value).over(o), F.lit(1e-300)))
    return out.withColumn("converged", F.coalesce((F.lag("best").over(o) - F.col("best")) / F.greatest(F.lag("best").over(o), F.lit(1e-300)) < tolerance, F.lit(False)))
