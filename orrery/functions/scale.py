"""Scales from data: robust and plain unit scaling, frozen bounds, positive scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.quantiles import quantile_columns


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def percentile_bounds(df: DataFrame, x: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """One row: lo and hi, the percentiles of a reference batch of any size, to be frozen and used on others."""
    return quantile_columns(df, [], x, {"lo": low, "hi": high})


def scale_by(df: DataFrame, x: str, bounds: DataFrame, name: str) -> DataFrame:
    """x clipped to [lo, hi] of the one-row table `bounds` and scaled to [0, 1]; 0 where they are equal."""
    unit = F.least(F.greatest((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, F.when(F.col("hi") > F.col("lo"), unit).otherwise(F.lit(0.0))).drop("lo", "hi")


def robust_unit(df: DataFrame, x: str, name: str) -> DataFrame:
    return scale_by(df, x, percentile_bounds(df, x), name)


def minmax_unit(df: DataFrame, x: str, name: str) -> DataFrame:
    """Zeros if any value is not finite or the span is under 1e-30."""
    bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count_if(~F.coalesce(finite(F.col(x)), F.lit(False))).alias("odd"))
    unit = F.when((F.col("odd") == 0) & (F.col("hi") - F.col("lo") > 1e-30), (F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, unit).drop("lo", "hi", "odd")


def positive_scales(df: DataFrame, by: str, x: str, modes: dict[str, str]) -> DataFrame:
    """For each group, by name, the mode's scale: none (1), or median, p68 or p95 of the finite values from 0 on; their maximum, then 1, where that is 0."""
    share = {"median": 0.5, "p68": 0.68, "p95": 0.95}
    kept = df.where(finite(F.col(x)) & (F.col(x) >= 0)).withColumnRenamed(by, "__by")
    at = quantile_columns(kept, ["__by"], x, {f"__{m}": share[m] for m in {"median", *modes.values()} - {"none"}})
    most = kept.groupBy(F.col("__by").alias("__of")).agg(F.max(x).alias("__most"))
    groups = df.select(by).distinct()
    out = groups.join(at, groups[by].eqNullSafe(at["__by"]), "left").join(most, groups[by].eqNullSafe(most["__of"]), "left")
    pick = lambda m: F.lit(1.0) if m == "none" else F.coalesce(F.nullif(F.col(f"__{m}"), F.lit(0.0)), F.nullif("__most", F.lit(0.0)), F.lit(1.0))
    return out.select(by, *(pick(m).alias(n) for n, m in modes.items()))
