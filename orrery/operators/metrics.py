"""Accuracy metrics of predictions along an axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.scale import finite
from orrery.operators.quantiles import quantile_columns, running_total


def metric_block(x: str) -> list[Column]:
    q = lambda p: F.percentile(x, F.lit(p))
    return [F.avg(x).alias("mean"), q(0.5).alias("p50"), q(0.68).alias("p68"), q(0.95).alias("p95"), F.max(x).alias("max")]


def by_band_and_all(facts: DataFrame, band: str, block: list[Column]) -> DataFrame:
    """One pass with a row for each band and one, `all`, over everything."""
    return facts.groupingSets([[F.col(band)], []], F.col(band)).agg(F.grouping_id().alias("__all"), *block).withColumn(band, F.when(F.col("__all") == 0, F.col(band)).otherwise("all")).drop("__all")


def block_by_grouping_sets(facts: DataFrame, band: str, x: str, shares: dict[str, float]) -> DataFrame:
    """Mean and maximum of each band and of all in one pass of grouping sets, the percentiles without a buffer of a group's values."""
    plain = by_band_and_all(facts, band, [F.avg(x).alias("mean"), F.max(x).alias("max")])
    every = quantile_columns(facts, [], x, shares).select(F.lit("all").alias(band), *shares)
    at = quantile_columns(facts, [band], x, shares).unionByName(every).withColumnRenamed(band, "__band")
    return plain.join(at, plain[band].eqNullSafe(at["__band"])).drop("__band")


def block_by_band_and_all(facts: DataFrame, band: str, x: str, shares: dict[str, float]) -> DataFrame:
    """Mean, percentiles and maximum for each band and over all, for bands of any size: no group is ever held in a buffer."""
    both = facts.select(F.explode(F.array(F.col(band), F.lit("all"))).alias(band), x)
    plain = both.groupBy(band).agg(F.avg(x).alias("mean"), F.max(x).alias("max"))
    return plain.join(quantile_columns(both, [band], x, shares), band)


def signed_by_band_and_all(facts: DataFrame, band: str, x: str) -> DataFrame:
    """The signed block for bands of any size."""
    both = facts.select(F.explode(F.array(F.col(band), F.lit("all"))).alias(band), x)
    plain = both.groupBy(band).agg(F.avg(x).alias("mean"), F.max(F.abs(F.col(x))).alias("max_abs"))
    return plain.join(quantile_columns(both, [band], x, {"p16": 0.16, "p50": 0.5, "p84": 0.84, "p95": 0.95}), band)


def finite_by(rows: DataFrame, by: str, x: str) -> DataFrame:
    """Of the finite values of each group alone: count, min, p50, p68, p90, p95, max, mean; groups may be of any size."""
    kept = F.when(finite(F.col(x)), F.col(x))
    plain = rows.groupBy(by).agg(F.count(kept).alias("n"), F.min(kept).alias("min"), F.max(kept).alias("max"), F.avg(kept).alias("mean"))
    at = quantile_columns(rows.where(finite(F.col(x))), [by], x, {"p50": 0.5, "p68": 0.68, "p90": 0.9, "p95": 0.95}).withColumnRenamed(by, "__by")
    return plain.join(at, plain[by].eqNullSafe(at["__by"]), "left").drop("__by")


def windowed_curve(facts: DataFrame, sample: str, k: str, x: str, share: float, dex: float = 0.025) -> DataFrame:
    """For each k: the percentile over samples of each sample's mean within +-dex of log10 k."""
    # In whole billionths, as range frames over doubles take no Python bounds.
    near = Window.partitionBy(sample).orderBy("__logk").rangeBetween(-round(dex * 1e9), round(dex * 1e9))
    smooth = facts.withColumn("__logk", F.round(F.log10(k) * 1e9).cast("long")).withColumn("__mean", F.avg(x).over(near))
    return smooth.groupBy(k).agg(F.percentile("__mean", F.lit(share)).alias("value"))


def band_curve_stats(facts: DataFrame, band: str, k: str, x: str) -> DataFrame:
    """Over the curves in k of a band: mean, p95 and largest mean, and the largest p68 (not a pooled p68)."""
    curve = facts.groupBy(band, k).agg(F.avg(x).alias("m"), F.percentile(x, F.lit(0.68)).alias("q"))
    return curve.groupBy(band).agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.95)).alias("p95"), F.max("m").alias("max"), F.max("q").alias("max_p68"))


def weighted_per_sample(facts: DataFrame, sample: str, x: str, w: str) -> DataFrame:
    return facts.groupBy(sample).agg((F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("value"))


def accumulate(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """Mergeable sums: sum, sum of squares and count of each group."""
    return rows.groupBy(*by).agg(F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("s2"), F.count(x).alias("n"))


def merge(states: DataFrame, by: list[str]) -> DataFrame:
    return states.groupBy(*by).agg(F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.sum("n").alias("n"))


def estimate(states: DataFrame, designs: Column | None = None, usable: int = 10, confident: int = 20) -> DataFrame:
    """Mean, sample deviation (0 for one value, null for none), standard error, and how far to trust them."""
    n, mean = F.col("n"), F.col("s") / F.col("n")
    var = F.greatest((F.col("s2") - F.col("n") * mean * mean) / (n - 1), F.lit(0.0))
    std = F.when(n == 0, F.lit(None)).when(n == 1, F.lit(0.0)).otherwise(F.sqrt(var))
    out = states.withColumns({"mean": F.when(n > 0, mean), "std": std, "se": std / F.sqrt(n), "usable": n >= usable, "high_confidence": n >= confident})
    return out if designs is None else out.withColumn("fraction", n / designs)


def density_from(df: DataFrame, x: str, alpha: float, name: str, eps: float = 1e-12, share: float = 0.95) -> DataFrame:
    """Missing values become the median, large ones the given percentile; (max(x, 0) + eps)^alpha, with sum 1."""
    facts = quantile_columns(df.where(finite(F.col(x))), [], x, {"__mid": 0.5})
    filled = df.crossJoin(F.broadcast(facts)).withColumn("__x", F.coalesce(F.when(finite(F.col(x)), F.col(x)), F.col("__mid")))
    cap = quantile_columns(filled, [], "__x", {"__cap": share})
    mass = filled.crossJoin(F.broadcast(cap)).withColumn("__m", F.pow(F.greatest(F.least("__x", "__cap"), F.lit(0.0)) + eps, F.lit(alpha)))
    total = mass.agg(F.sum("__m").alias("__t"))
    return mass.crossJoin(F.broadcast(total)).withColumn(name, F.col("__m") / F.col("__t")).drop("__mid", "__x", "__cap", "__m", "__t")


def average_ranks(df: DataFrame, x: str, name: str) -> DataFrame:
    """Ranks from 1, equal values sharing the mean of theirs: from counts of distinct values, summed range by range."""
    counts = running_total(df.groupBy(x).agg(F.count("*").alias("__n")), x, "__n", "__upto")
    ranks = counts.select(x, (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(name))
    return df.join(ranks, x)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    both = average_ranks(average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y), x, "rx"), y, "ry")
    return both.agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def kish_size(w: str) -> Column:
    """Effective number of weighted values."""
    return F.pow(F.sum(w), F.lit(2.0)) / F.sum(F.col(w) * F.col(w))
