"""Exact percentiles of groups of any size, and running totals over an order of any length.

Spark's `percentile` keeps a group's values in one buffer. Here the buffer never forms: an approximate
percentile brackets each wanted rank, one aggregate counts what lies below the brackets, and only values inside
one, a small share of the group, are ranked. Groups of under 2 * accuracy rows, where a share is less than a rank
or two, are bracketed by their least and largest value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
#: Ranges that an order is cut into; each range is a window of its own.
RANGES = 64


def exact_quantiles(df: DataFrame, by: list[str], x: str, shares: list[float], accuracy: int = ACCURACY, broadcast_groups: bool = True) -> DataFrame:
    """A row for each group and share: by, share, value; linear interpolation between ranks, nulls left out.

    The brackets are broadcast, a row for each group; broadcast_groups=False leaves their join to Spark where groups are many.
    """
    rows = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("x"))
    # The approximation's own error, as much again, and two ranks of any group that is bracketed by it.
    slack, few = 3.0 / accuracy, F.col("n") < 2 * accuracy
    wanted = [s for share in shares for s in (max(share - slack, 0.0), min(share + slack, 1.0))]
    bracket = rows.groupBy(*by).agg(F.percentile_approx("x", wanted, accuracy).alias("q"), F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    los = [F.when(few | F.lit(share <= slack), F.col("least")).otherwise(F.col("q")[2 * i]) for i, share in enumerate(shares)]
    his = [F.when(few | F.lit(share >= 1 - slack), F.col("most")).otherwise(F.col("q")[2 * i + 1]) for i, share in enumerate(shares)]
    ends = F.array(*(F.struct(F.lit(i).alias("i"), lo.alias("lo"), hi.alias("hi")) for i, (lo, hi) in enumerate(zip(los, his, strict=True))))
    bracket = bracket.select(*(F.col(c).alias(f"__{c}") for c in by), "n", ends.alias("ends"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by), F.lit(True))
    met = rows.join(F.broadcast(bracket) if broadcast_groups else bracket, same).select(*by, "n", "ends", "x")
    below = met.groupBy(*by).agg(F.array(*(F.count_if(F.col("x") < F.col("ends")[i]["lo"]) for i in range(len(shares)))).alias("below"))
    inside = met.select(*by, "n", "x", F.explode(F.filter("ends", lambda e: (F.col("x") >= e["lo"]) & (F.col("x") <= e["hi"]))).alias("e"))
    inside = inside.groupBy(*by, F.col("e.i").alias("i"), "n", "x").agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy(*by, "i").orderBy("x"))
    below = below.withColumnsRenamed({c: f"__{c}" for c in by})
    ranked = inside.withColumn("upto", upto).join(F.broadcast(below) if broadcast_groups else below, same)
    ranked = ranked.withColumn("share", F.array(*map(F.lit, map(float, shares)))[F.col("i")]).withColumn("before", F.col("below")[F.col("i")])
    place = F.col("share") * (F.col("n") - 1)
    holds = lambda rank: (rank >= F.col("before") + F.col("upto") - F.col("times")) & (rank < F.col("before") + F.col("upto"))
    low, high = F.min(F.when(holds(F.floor(place)), F.col("x"))), F.min(F.when(holds(F.ceil(place)), F.col("x")))
    return ranked.groupBy(*by, "share", "n").agg(low.alias("low"), high.alias("high")).select(*by, "share", (F.col("low") + (place - F.floor(place)) * (F.col("high") - F.col("low"))).alias("value"))


def quantile_columns(df: DataFrame, by: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """A row for each group (one in all for no `by`) with a column for each named share; none for groups without a value."""
    at = exact_quantiles(df, by, x, list(shares.values()))
    return at.groupBy(*by).agg(*(F.max(F.when(F.col("share") == float(s), F.col("value"))).alias(n) for n, s in shares.items()))


def running_total(counts: DataFrame, x: str, n: str, name: str, ranges: int = RANGES) -> DataFrame:
    """`counts` (distinct values x and how many) with the number of rows up to each value, without one window over all.

    Ends of ranges, at most `ranges` numbers, come to the driver; each range is summed in its own window and begins
    with what the ranges before it hold.
    """
    ends = counts.agg(F.percentile_approx(x, [i / ranges for i in range(1, ranges)], ACCURACY).alias("ends")).first()["ends"]
    ends = sorted(set(ends or []))
    part = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col(x))) if ends else F.lit(0)
    dealt = counts.withColumn("__part", part)
    held = dealt.groupBy("__part").agg(F.sum(n).alias("__held"))
    before = held.select("__part", (F.sum("__held").over(Window.orderBy("__part")) - F.col("__held")).alias("__before"))
    own = F.sum(n).over(Window.partitionBy("__part").orderBy(x))
    return dealt.join(F.broadcast(before), "__part").withColumn(name, own + F.col("__before")).drop("__part", "__before")
