"""An ordered positive axis (wave numbers, sizes, budgets): weights, bands, grids, differences along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trapezoid_weights(axis: DataFrame, k: str = "k", by: tuple[str, ...] = ()) -> DataFrame:
    """`axis` with w, the trapezoid quadrature weight in log10 k. The axis is one row a point, so it is small."""
    order = Window.partitionBy(*(by or (F.lit(0),))).orderBy(k)
    x = F.log10(F.col(k))
    before, after = F.lag(x).over(order), F.lead(x).over(order)
    return axis.withColumn("w", F.greatest(0.5 * (F.coalesce(after, x) - F.coalesce(before, x)), F.lit(0.0)))


def band_of(k: Column, edges: list[float], names: list[str]) -> Column:
    """Half-open bands, open at both ends of the axis: below the first edge, between edges, from the last on."""
    out = F.when(k < edges[0], F.lit(names[0]))
    for edge, name in zip(edges[1:], names[1:], strict=False):
        out = out.when(k < edge, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def smooth_levels(k: Column, edges: list[float], levels: list[float], width: float) -> Column:
    """Band levels blended across the edges, one after the other, with a tanh step in log10 k."""
    out = F.lit(levels[0])
    for edge, level in zip(edges, levels[1:], strict=True):
        step = 0.5 * (1.0 + F.tanh((F.log10(k) - F.log10(F.lit(edge))) / width))
        out = (1.0 - step) * out + step * level
    return out


def log_grid(spark, lo: float, hi: float, count: int, last: bool = True) -> DataFrame:
    """`count` points from lo to hi, evenly in log10; without `last` the end point belongs to the next grid."""
    step = 1.0 / (count - 1 if last else count)
    i = F.col("id").cast("double")
    return spark.range(count).select(F.col("id").cast("int").alias("i"), F.round(F.pow(F.lit(10.0), F.log10(F.lit(lo)) + i * step * (F.log10(F.lit(hi)) - F.log10(F.lit(lo)))), 12).alias("k"))


def gradient(series: DataFrame, x: str, y: str, by: str, name: str) -> DataFrame:
    """The slope of y along x on a grid of any spacing: second order inside, one-sided at the ends."""
    order = Window.partitionBy(by).orderBy(x)
    xb, xa, yb, ya = F.lag(x).over(order), F.lead(x).over(order), F.lag(y).over(order), F.lead(y).over(order)
    hb, ha = F.col(x) - xb, xa - F.col(x)
    inner = (hb * hb * ya + (ha * ha - hb * hb) * F.col(y) - ha * ha * yb) / (hb * ha * (ha + hb))
    return series.withColumn(name, F.when(xb.isNull(), (ya - F.col(y)) / ha).when(xa.isNull(), (F.col(y) - yb) / hb).otherwise(inner))


def curvature_basis(series: DataFrame, k: str, y: str, by: str, pivot: float, centre: float, width: float, least: float = 1e-30) -> DataFrame:
    """Features of a curve along ln k: x, the log distance to the pivot; slope and curvature of ln y, both by uneven differences; and the slope in a Gaussian window of log10 k.

    Values of k or y below `least` count as `least`."""
    at_least = lambda c: F.greatest(F.col(c), F.lit(least))
    logs = series.withColumns({"x": F.log(at_least(k) / pivot), "log_k": F.log(at_least(k)), "log_y": F.log(at_least(y))})
    bent = gradient(gradient(logs, "log_k", "log_y", by, "slope"), "log_k", "slope", by, "curvature")
    z = (F.log10(at_least(k)) - centre) / width
    return bent.withColumn("windowed", F.exp(-0.5 * z * z) * F.col("slope")).drop("log_k", "log_y")
