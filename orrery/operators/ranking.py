"""Rankings: quota top-k, re-ranking of a prefix, guards, merges. Ties always go to the smaller id.

A ranking is a table with an explicit position rn from 1. One window over a table is only used where the table
is already cut to a top-k; a cut itself is an orderBy with a limit, which each partition does before any shuffle.
`whole_positions` numbers a table of any size, and `keep_tail` puts a re-ranked prefix back into such a ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.quantiles import ACCURACY, RANGES, quantile_columns, running_total


def top(df: DataFrame, score: str, n: int, by: str = "id") -> DataFrame:
    return df.orderBy(F.desc(score), by).limit(n)


def positions(df: DataFrame, *order: Column | str, name: str = "rn") -> DataFrame:
    """Positions in a table that is already small."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def whole_positions(df: DataFrame, score: str, by: str = "id", name: str = "rn", ranges: int = RANGES) -> DataFrame:
    """Positions by falling score, then by rising numeric `by`, in a table of any size; null and NaN scores come last.

    Rows are counted by score and range of `by`. Running totals of the counts say where such a cell begins, and only
    its own rows are numbered in one window, so many rows of one score are spread over the ranges.
    """
    ends = sorted(set(df.agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)], ACCURACY).alias("e")).first()["e"] or []))
    part = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col(by))) if ends else F.lit(0)
    last = F.col(score).isNull() | F.isnan(score)
    dealt = df.withColumn("__key", F.when(last, F.lit(float("inf"))).otherwise(-F.col(score).cast("double")) + 0.0).withColumn("__part", part)
    cells = dealt.groupBy("__key", "__part").agg(F.count("*").alias("__n"))
    upto = running_total(cells.groupBy("__key").agg(F.sum("__n").alias("__all")), "__key", "__all", "__upto")
    earlier = F.sum("__n").over(Window.partitionBy("__key").orderBy("__part")) - F.col("__n")
    begins = cells.withColumn("__earlier", earlier).join(upto, "__key").select("__key", "__part", (F.col("__upto") - F.col("__all") + F.col("__earlier")).alias("__begin"))
    nth = F.row_number().over(Window.partitionBy("__key", "__part").orderBy(by))
    return dealt.join(begins, ["__key", "__part"]).withColumn(name, F.col("__begin") + nth).drop("__key", "__part", "__begin")


def keep_tail(df: DataFrame, score: str, prefix: DataFrame) -> DataFrame:
    """The whole ranking by score, its first rows in the order of `prefix` (id, rn), a re-ranked top-k, which is broadcast."""
    again = F.broadcast(prefix.select("id", F.col("rn").alias("__new")))
    return whole_positions(df, score).join(again, "id", "left").withColumn("rn", F.coalesce("__new", "rn")).drop("__new")


def parted(df: DataFrame, first: Column, within: str, score: str, by: str = "id") -> DataFrame:
    """Positions rn in a table of any size: rows of `first` before the others, by falling `within`; the others by falling score."""
    marked = df.withColumn("__first", F.coalesce(first, F.lit(False)))
    many = F.broadcast(marked.agg(F.count_if("__first").alias("__many")))
    head = whole_positions(marked.where("__first"), within, by)
    tail = whole_positions(marked.where(~F.col("__first")), score, by).crossJoin(many).withColumn("rn", F.col("rn") + F.col("__many")).drop("__many")
    return head.unionByName(tail).drop("__first")


def near_top(df: DataFrame, score: str, ratio: float) -> DataFrame:
    """`df` with near: whether a row's score is within a ratio of the whole table's best; no place in a ranking decides it."""
    return df.crossJoin(F.broadcast(df.agg(F.max(score).alias("__best")))).withColumn("near", F.col(score) >= ratio * F.col("__best")).drop("__best")


def whole_tiebreak(df: DataFrame, score: str, gain: str, ratio: float) -> DataFrame:
    """All rows near the best by gain, then all others by score."""
    return parted(near_top(df, score, ratio), F.col("near"), gain, score)


def whole_guard(df: DataFrame, score: str, gain: str, share: float) -> DataFrame:
    """Rows whose gain reaches the table's own quantile first, then the others, both by score."""
    level = F.broadcast(quantile_columns(df, [], gain, {"__level": share}))
    return parted(df.crossJoin(level).withColumn("near", F.col(gain) >= F.col("__level")).drop("__level"), F.col("near"), score, score)


def whole_blend(df: DataFrame, terms: dict[str, float], name: str = "blend") -> DataFrame:
    """All rows by the weighted sum of their terms, each scaled to 0..1 over the table (0 where it doesn't vary)."""
    return whole_positions(_blended(df, terms, name), name)


def _blended(df: DataFrame, terms: dict[str, float], name: str, among: Column | None = None) -> DataFrame:
    """`df` with the sum of weights times terms, scaled to 0..1 among the rows of `among`, or all."""
    own = lambda c: F.when(among, F.col(c)) if among is not None else F.col(c)
    ends = df.agg(*(f(own(c)).alias(f"__{end}{i}") for i, c in enumerate(terms) for end, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(ends))
    unit = lambda i, c: F.when(F.col(f"__hi{i}") - F.col(f"__lo{i}") > 1e-30, (F.col(c) - F.col(f"__lo{i}")) / (F.col(f"__hi{i}") - F.col(f"__lo{i}"))).otherwise(0.0)
    return out.withColumn(name, F.round(sum((w * unit(i, c) for i, (c, w) in enumerate(terms.items())), F.lit(0.0)), 9)).drop(*ends.columns)


def whole_set_aware(df: DataFrame, score: str, terms: dict[str, float], ratio: float) -> DataFrame:
    """All rows near the best by the weighted sum of their terms, scaled among them, then all others by score."""
    near = near_top(df, score, ratio)
    return parted(_blended(near, terms, "__total", F.col("near")), F.col("near"), "__total", score).drop("__total")


def whole_rescored(df: DataFrame, score: str, exact: str, share: float) -> DataFrame:
    """The best share of the whole ranking by an exact score, the tail as it was."""
    size = F.broadcast(df.agg(F.ceil(share * F.count("*")).alias("__size")))
    placed = whole_positions(df, score, name="__place").crossJoin(size).withColumn("near", F.col("__place") <= F.col("__size"))
    return parted(placed.drop("__place", "__size"), F.col("near"), exact, score)


def quota_top(df: DataFrame, score: str, flag: Column, n: int, cap: float) -> DataFrame:
    """Top n of which at most floor(cap n) are flagged; if there are not enough others, flagged ones fill up."""
    quota = int(cap * n)
    marked = df.withColumn("__flag", flag)
    best = top(marked.where(~F.col("__flag")), score, n).unionAll(top(marked.where("__flag"), score, n))
    in_kind = F.row_number().over(Window.partitionBy("__flag").orderBy(F.desc(score), "id"))
    late = F.col("__flag") & (in_kind > quota)
    return positions(best.withColumn("__late", late), "__late", F.desc(score), "id").where(F.col("rn") <= n).drop("__flag", "__late")


def best_per_group(df: DataFrame, by: str, score: str) -> DataFrame:
    """The row with the largest score of each group; ties to the smaller id. One aggregate, no sort of groups."""
    columns = [c for c in df.columns if c != by]
    lead = F.min_by(F.struct(*columns), F.struct((-F.col(score)).alias("s"), "id"))
    return df.groupBy(by).agg(lead.alias("__r")).select(by, *(F.col(f"__r.{c}").alias(c) for c in columns))


def guard_first(ranking: DataFrame, passes: Column) -> DataFrame:
    """Rows that pass come first, both parts in their order."""
    return positions(ranking.withColumn("__ok", F.coalesce(passes, F.lit(False))), F.desc("__ok"), "rn", name="__new").drop("rn", "__ok").withColumnRenamed("__new", "rn")


def tiebreak(ranking: DataFrame, score: str, gain: str, ratio: float) -> DataFrame:
    """Rows within a ratio of the top score are ordered anew by gain; the others keep their order."""
    best = F.max(score).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = ranking.withColumn("__near", F.col(score) >= ratio * best)
    return positions(near, F.desc("__near"), F.when(F.col("__near"), -F.col(gain)), "rn", name="__new").drop("rn", "__near").withColumnRenamed("__new", "rn")


def rerank_prefix(ranking: DataFrame, k: int, exact: str) -> DataFrame:
    """The first k rows by an exact score, the tail as it was."""
    head = F.col("rn") <= k
    return positions(ranking, F.desc(head), F.when(head, -F.col(exact)), "rn", name="__new").drop("rn").withColumnRenamed("__new", "rn")


def set_aware(ranking: DataFrame, score: str, terms: dict[str, float], ratio: float) -> DataFrame:
    """Rows within a ratio of the top score come first, by the weighted sum of their terms, each scaled to 0..1 among them."""
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = ranking.withColumn("__near", F.col(score) >= ratio * F.max(score).over(everything))
    own = lambda c: F.when(F.col("__near"), F.col(c))
    bounds = {f"__{i}": (F.min(own(c)).over(everything), F.max(own(c)).over(everything)) for i, c in enumerate(terms)}
    near = near.withColumns({f"{n}{end}": x for n, (lo, hi) in bounds.items() for end, x in (("lo", lo), ("hi", hi))})
    unit = lambda n, c: F.when(F.col(f"{n}hi") - F.col(f"{n}lo") > 1e-30, (F.col(c) - F.col(f"{n}lo")) / (F.col(f"{n}hi") - F.col(f"{n}lo"))).otherwise(0.0)
    total = F.round(sum((w * unit(f"__{i}", c) for i, (c, w) in enumerate(terms.items())), F.lit(0.0)), 9)
    placed = positions(near, F.desc("__near"), F.when(F.col("__near"), -total), "rn", name="__new")
    return placed.select(*(c for c in ranking.columns if c != "rn"), F.col("__new").alias("rn"))


def ordered_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct ids of two rankings, in the order in which they first appear."""
    both = first.select("id", F.lit(0).alias("part"), "rn").unionAll(second.select("id", F.lit(1).alias("part"), "rn"))
    return positions(both.groupBy("id").agg(F.min(F.struct("part", "rn")).alias("__at")), "__at").drop("__at")


def largest_remainder(shares: DataFrame, total: int, share: str, least: str) -> DataFrame:
    """Whole counts that add up to total: minimums, then floors of the shares, then the largest remainders by position."""
    norm = F.sum(share).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    free = F.lit(total) - F.sum(least).over(everything)
    ideal = shares.withColumn("__ideal", free * F.col(share) / norm).withColumn("__floor", F.floor("__ideal"))
    left = F.lit(total) - F.sum(F.col(least) + F.col("__floor")).over(everything)
    order = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__ideal") - F.col("__floor"), 9)), "id"))
    return ideal.withColumn("count", (F.col(least) + F.col("__floor") + F.when(order <= left, 1).otherwise(0)).cast("long")).drop("__ideal", "__floor")


# Risk functionals over the errors of a candidate's probes, each an aggregate.
def quantile_drop(before: str, after: str, share: float = 0.68) -> Column:
    return F.percentile(before, F.lit(share)) - F.percentile(after, F.lit(share))


def shell_weight(error: Column, q: Column, width: float = 0.15, floor: float = 0.05) -> Column:
    """Most weight on errors near the quantile."""
    z = (error - q) / (width * q)
    return floor + (1 - floor) * F.exp(-0.5 * z * z)


def rank_window_weight(place: Column, centre: float = 0.68, half: float = 0.2, floor: float = 0.05) -> Column:
    """A raised cosine over rank places around the centre."""
    t = F.least(F.abs(place - centre) / half, F.lit(1.0))
    return floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * t))
