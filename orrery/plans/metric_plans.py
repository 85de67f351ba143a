"""Metric and curve queries over truth and prediction facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import axis, targets
from orrery.operators import metrics as m
from orrery.operators.quantiles import exact_quantiles, quantile_columns
from orrery.plans.common import BANDS, EDGES, FACTS_SQL, facts, rounded, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _q(x: str, p: float) -> str:
    return f"round(quantile_cont({x}, {p}), 6)"


_BLOCK = f"round(avg(err), 6) AS mean, {_q('err', 0.5)} AS p50, {_q('err', 0.68)} AS p68, {_q('err', 0.95)} AS p95, round(max(err), 6) AS max"


@query(f"WITH {FACTS_SQL} SELECT CASE WHEN grouping(band) = 1 THEN 'all' ELSE band END AS band, {_BLOCK} FROM facts GROUP BY GROUPING SETS ((band), ())")
def metric_block_by_band(spark, d):
    return rounded(m.block_by_band_and_all(facts(spark, d), "band", "err", {"p50": 0.5, "p68": 0.68, "p95": 0.95}))


@query(f"WITH {FACTS_SQL} SELECT CASE WHEN grouping(band) = 1 THEN 'all' ELSE band END AS band, {_BLOCK} FROM facts GROUP BY GROUPING SETS ((band), ())")
def metric_block_grouping_sets(spark, d):
    """The same with means and maxima in one pass of grouping sets."""
    return rounded(m.block_by_grouping_sets(facts(spark, d), "band", "err", {"p50": 0.5, "p68": 0.68, "p95": 0.95}))


@query(f"WITH {FACTS_SQL}, s AS (SELECT *, (pred / greatest(truth, 1e-30) - 1.0) * 100.0 AS e FROM facts) SELECT CASE WHEN grouping(band) = 1 THEN 'all' ELSE band END AS band, round(avg(e), 6) AS mean, {_q('e', 0.16)} AS p16, {_q('e', 0.5)} AS p50, {_q('e', 0.84)} AS p84, {_q('e', 0.95)} AS p95, round(max(abs(e)), 6) AS max_abs FROM s GROUP BY GROUPING SETS ((band), ())")
def signed_metrics_by_band(spark, d):
    f = facts(spark, d).withColumn("e", targets.signed_percent(F.col("pred"), F.col("truth")))
    return rounded(m.signed_by_band_and_all(f, "band", "e"))


@query(f"SELECT event_type, count(v) AS n, round(min(v), 6) AS min, {_q('v', 0.5)} AS p50, {_q('v', 0.68)} AS p68, {_q('v', 0.9)} AS p90, {_q('v', 0.95)} AS p95, round(max(v), 6) AS max, round(avg(v), 6) AS mean FROM (SELECT event_type, CASE WHEN isfinite(value) THEN value END AS v FROM events) GROUP BY event_type")
def finite_metric_block(spark, d):
    return rounded(m.finite_by(table(spark, d, "events"), "event_type", "value"))


_LADDER = [0.0, 0.05, 0.16, 0.25, 0.5, 0.75, 0.84, 0.95, 1.0]


@query("WITH q AS (SELECT unnest([0.0, 0.05, 0.16, 0.25, 0.5, 0.75, 0.84, 0.95, 1.0]) AS share) SELECT l_returnflag, CAST(share AS DOUBLE) AS share, round(CASE " + " ".join(f"WHEN share = {s} THEN quantile_cont(l_extendedprice, {s})" for s in _LADDER) + " END, 6) AS value FROM lineitem, q GROUP BY l_returnflag, share")
def quantile_ladder(spark, d):
    return rounded(exact_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", _LADDER))


@query(f"WITH {FACTS_SQL} SELECT k, count(*) AS n, round(avg(err), 6) AS mean, round(stddev_pop(err), 6) AS std, {_q('err', 0.68)} AS p68, {_q('err', 0.95)} AS p95 FROM facts GROUP BY k")
def per_k_error_curve(spark, d):
    return rounded(facts(spark, d).groupBy("k").agg(F.count("*").alias("n"), F.avg("err").alias("mean"), F.stddev_pop("err").alias("std"), F.percentile("err", F.lit(0.68)).alias("p68"), F.percentile("err", F.lit(0.95)).alias("p95")))


@query(f"WITH {FACTS_SQL} SELECT sample, {_q('err', 0.68)} AS p68, round(avg(err), 6) AS mean, round(max(err), 6) AS max FROM facts GROUP BY sample")
def per_sample_p68(spark, d):
    return rounded(facts(spark, d).groupBy("sample").agg(F.percentile("err", F.lit(0.68)).alias("p68"), F.avg("err").alias("mean"), F.max("err").alias("max")))


@query(f"WITH {FACTS_SQL}, s AS (SELECT k, avg(err) OVER (PARTITION BY sample ORDER BY round(log10(k), 12) RANGE BETWEEN 0.025 PRECEDING AND 0.025 FOLLOWING) AS v FROM facts) SELECT k, {_q('v', 0.68)} AS value FROM s GROUP BY k")
def windowed_p68_curve(spark, d):
    return rounded(m.windowed_curve(facts(spark, d), "sample", "k", "err", 0.68))


@query(f"WITH {FACTS_SQL}, c AS (SELECT band, k, avg(err) AS m, quantile_cont(err, 0.68) AS q FROM facts GROUP BY band, k) SELECT band, round(avg(m), 6) AS mean, {_q('m', 0.95)} AS p95, round(max(m), 6) AS max, round(max(q), 6) AS max_p68 FROM c GROUP BY band")
def band_curve_stats_max(spark, d):
    return rounded(m.band_curve_stats(facts(spark, d), "band", "k", "err"))


_AXIS = "axis AS (SELECT DISTINCT p_size AS k FROM part)"
_W = "greatest(0.5 * (coalesce(lead(log10(k)) OVER (ORDER BY k), log10(k)) - coalesce(lag(log10(k)) OVER (ORDER BY k), log10(k))), 0.0)"


def _axis(spark, d):
    return table(spark, d, "part").select(F.col("p_size").alias("k")).distinct()


@query(f"WITH {_AXIS} SELECT k, round({_W}, 9) AS w FROM axis")
def trapezoid_weights(spark, d):
    return axis.trapezoid_weights(_axis(spark, d)).select("k", F.round("w", 9).alias("w"))


_LEVELS = [1.0, 2.0, 4.0, 1.5]


def _smooth_sql() -> str:
    out = "1.0"
    for e, v in zip(EDGES, _LEVELS[1:], strict=True):
        s = f"(0.5 * (1.0 + ((exp(2.0 * (log10(k) - log10({e})) / 0.1) - 1.0) / (exp(2.0 * (log10(k) - log10({e})) / 0.1) + 1.0))))"
        out = f"((1.0 - {s}) * {out} + {s} * {v})"
    return out


@query(f"WITH {_AXIS}, w AS (SELECT k, {_W} AS w, {_smooth_sql()} AS level FROM axis) SELECT k, round(level / (sum(w * level) OVER () / sum(w) OVER ()), 6) AS weight, round(w * level / sum(w * level) OVER (), 6) AS share FROM w")
def smooth_band_curve(spark, d):
    w = axis.trapezoid_weights(_axis(spark, d)).withColumn("level", axis.smooth_levels(F.col("k"), EDGES, _LEVELS, 0.1))
    total = w.agg(F.sum(F.col("w") * F.col("level")).alias("wl"), F.sum("w").alias("sw"))
    out = w.crossJoin(F.broadcast(total)).select("k", (F.col("level") / (F.col("wl") / F.col("sw"))).alias("weight"), (F.col("w") * F.col("level") / F.col("wl")).alias("share"))
    return rounded(out)


@query(f"WITH {FACTS_SQL}, {_AXIS}, w AS (SELECT k, {_W} AS w FROM axis), s AS (SELECT sample, sum(w * err) / sum(w) AS v FROM facts JOIN w USING (k) WHERE k >= 5 GROUP BY sample) SELECT round(avg(v), 6) AS mean, {_q('v', 0.5)} AS p50, {_q('v', 0.68)} AS p68, {_q('v', 0.95)} AS p95, round(max(v), 6) AS max FROM s")
def logk_integrated_error(spark, d):
    weights = F.broadcast(axis.trapezoid_weights(_axis(spark, d)))
    per = m.weighted_per_sample(facts(spark, d).where("k >= 5").join(weights, "k"), "sample", "err", "w")
    return rounded(per.agg(*m.metric_block("value")))


@query(f"WITH {FACTS_SQL}, w AS (SELECT sample, err, CASE WHEN k >= 5 AND k < 20 THEN 2.0 ELSE 1.0 END AS w FROM facts) SELECT sample, round(sum(w * err) / sum(w), 6) AS value FROM w GROUP BY sample")
def midband_step_weights(spark, d):
    f = facts(spark, d).withColumn("w", F.when((F.col("k") >= 5) & (F.col("k") < 20), 2.0).otherwise(1.0))
    return rounded(m.weighted_per_sample(f, "sample", "err", "w"))


@query(f"WITH {FACTS_SQL}, b AS (SELECT unnest(['low', 'mid', 'focus_high', 'tail', 'beyond']) AS band) SELECT band, round(coalesce(avg(err), 0.0), 6) AS error, count(err) AS n FROM b LEFT JOIN facts USING (band) GROUP BY band")
def band_relative_errors(spark, d):
    bands = spark.createDataFrame([(b,) for b in [*BANDS, "beyond"]], "band string")
    per = facts(spark, d).groupBy("band").agg(F.avg("err").alias("e"), F.count("err").alias("c"))
    return rounded(bands.join(per, "band", "left").select("band", F.coalesce("e", F.lit(0.0)).alias("error"), F.coalesce("c", F.lit(0)).alias("n")))


@query(f"WITH {FACTS_SQL}, f AS (SELECT unnest(['0p07_3', '0p1_5', 'k_le_1']) AS focus, unnest([2.0, 5.0, 0.0]) AS lo, unnest([30.0, 30.0, 10.0]) AS hi) SELECT focus, count(*) AS n, {_q('err', 0.68)} AS p68, round(avg(err), 6) AS mean FROM facts JOIN f ON k >= lo AND k <= hi GROUP BY focus")
def focus_band_metrics(spark, d):
    focus = spark.createDataFrame([("0p07_3", 2.0, 30.0), ("0p1_5", 5.0, 30.0), ("k_le_1", 0.0, 10.0)], "focus string, lo double, hi double")
    f = facts(spark, d)
    met = f.join(F.broadcast(focus), (f["k"] >= F.col("lo")) & (f["k"] <= F.col("hi")))
    plain = met.groupBy("focus").agg(F.count("*").alias("n"), F.avg("err").alias("mean"))
    return rounded(plain.join(quantile_columns(met, ["focus"], "err", {"p68": 0.68}), "focus", "left"))


@query(f"WITH {FACTS_SQL}, p AS (SELECT k, (pred / greatest(truth, 1e-30) - 1.0) * 100.0 AS v FROM facts), q AS (SELECT k, median(v) AS med, quantile_cont(abs(v), 0.68) AS mag FROM p GROUP BY k) SELECT p.k, round(any_value(med), 6) AS median, round(arg_min(v, {{'d': round(abs(abs(v) - mag), 9), 'v': v}}), 6) AS centre FROM p JOIN q USING (k) GROUP BY p.k")
def signed_center_curve(spark, d):
    f = facts(spark, d).withColumn("v", targets.signed_percent(F.col("pred"), F.col("truth")))
    q = f.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("med"), F.percentile(F.abs("v"), F.lit(0.68)).alias("mag"))
    near = F.min_by("v", F.struct(F.round(F.abs(F.abs("v") - F.col("mag")), 9), "v"))
    return rounded(f.join(F.broadcast(q), "k").groupBy("k").agg(F.first("med").alias("median"), near.alias("centre")))


_CURVE = f"WITH {FACTS_SQL}, c AS (SELECT k, avg(err) AS m FROM facts GROUP BY k)"


@query(_CURVE + " SELECT k, round(avg(m) OVER (ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth, round((sum(m) OVER (ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(0, 2 - (row_number() OVER (ORDER BY k) - 1)) * first_value(m) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + greatest(0, 2 - (count(*) OVER () - row_number() OVER (ORDER BY k))) * last_value(m) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 5, 6) AS padded FROM c")
def moving_average(spark, d):
    c = facts(spark, d).groupBy("k").agg(F.avg("err").alias("m"))  # one row for each point of the axis
    order = Window.orderBy("k")
    near, everything = order.rowsBetween(-2, 2), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.row_number().over(order), F.count("*").over(everything)
    padded = (F.sum("m").over(near) + F.greatest(F.lit(0), 3 - i) * F.first("m").over(everything) + F.greatest(F.lit(0), 2 - (n - i)) * F.last("m").over(everything)) / 5
    return rounded(c.select("k", F.avg("m").over(near).alias("smooth"), padded.alias("padded")))


@query(_CURVE + ", g AS (SELECT k, log10(k) AS x, m, lag(log10(k)) OVER o AS xb, lead(log10(k)) OVER o AS xa, lag(m) OVER o AS yb, lead(m) OVER o AS ya FROM c WINDOW o AS (ORDER BY k)) SELECT k, round(CASE WHEN xb IS NULL THEN (ya - m) / (xa - x) WHEN xa IS NULL THEN (m - yb) / (x - xb) ELSE ((x - xb) * (x - xb) * ya + ((xa - x) * (xa - x) - (x - xb) * (x - xb)) * m - (xa - x) * (xa - x) * yb) / ((x - xb) * (xa - x) * ((xa - x) + (x - xb))) END, 6) AS slope FROM g")
def axis_gradient(spark, d):
    c = facts(spark, d).groupBy("k").agg(F.avg("err").alias("m")).withColumn("x", F.log10("k")).withColumn("one", F.lit(1))
    return rounded(axis.gradient(c, "x", "m", "one", "slope").select("k", "slope"))


@query(f"WITH {FACTS_SQL}, t AS (SELECT sample, k, ln(greatest(pred, 1e-30)) AS lp, ln(greatest(pred, 1e-30)) - ln(greatest(truth, 1e-30)) AS ld, pred / greatest(truth, 1e-30) - 1.0 AS ra FROM facts) SELECT k, round(avg(lp), 6) AS direct, round(avg(ld), 6) AS logdiff, round(avg(ra), 6) AS ratio FROM t GROUP BY k")
def logdiff_target(spark, d):
    f, p, a = facts(spark, d), F.col("pred"), F.col("truth")
    return rounded(f.groupBy("k").agg(F.avg(targets.target(p, None, "")).alias("direct"), F.avg(targets.target(p, a, "logdiff")).alias("logdiff"), F.avg(targets.target(p, a, "ratio")).alias("ratio")))


@query(f"WITH {FACTS_SQL} SELECT k, count(*) AS n, round(avg(pred), 6) AS by_ratio, round(avg(pred), 6) AS by_logdiff, round(avg(pred * 2), 6) AS moved FROM facts WHERE truth > 0 GROUP BY k")
def ratio_target_roundtrip(spark, d):
    """Predictions made into targets and back, both ways; and back against an anchor of twice the size."""
    f, p, a = facts(spark, d).where("truth > 0"), F.col("pred"), F.col("truth")
    back = {f"by_{kind}": F.avg(targets.power_of(targets.target(p, a, kind), a, kind)).alias(f"by_{kind}") for kind in ("ratio", "logdiff")}
    return rounded(f.groupBy("k").agg(F.count("*").alias("n"), *back.values(), F.avg(targets.power_of(targets.target(p, a, "logdiff"), a * 2, "logdiff")).alias("moved")))


def _slope_sql(x: str, y: str) -> str:
    """Differences on an uneven axis, in a window named o."""
    xb, xa, yb, ya = (f"{f}({c}) OVER o" for c in (x, y) for f in ("lag", "lead"))
    inner = f"(({x} - {xb}) * ({x} - {xb}) * {ya} + (({xa} - {x}) * ({xa} - {x}) - ({x} - {xb}) * ({x} - {xb})) * {y} - ({xa} - {x}) * ({xa} - {x}) * {yb}) / (({x} - {xb}) * ({xa} - {x}) * ({xa} - {xb}))"
    return f"CASE WHEN {xb} IS NULL THEN ({ya} - {y}) / ({xa} - {x}) WHEN {xa} IS NULL THEN ({y} - {yb}) / ({x} - {xb}) ELSE {inner} END"


@query(f"WITH {FACTS_SQL}, c AS (SELECT sample % 3 AS part, k, ln(k) AS x, ln(avg(truth)) AS y FROM facts GROUP BY 1, 2), s AS (SELECT *, {_slope_sql('x', 'y')} AS slope FROM c WINDOW o AS (PARTITION BY part ORDER BY x)), t AS (SELECT *, {_slope_sql('x', 'slope')} AS curvature FROM s WINDOW o AS (PARTITION BY part ORDER BY x)) SELECT CAST(part AS BIGINT) AS part, k, round(ln(k / 10.0), 6) AS x, round(slope, 6) AS slope, round(curvature, 6) AS curvature, round(exp(-0.5 * pow((log10(k) - 1) / 0.45, 2)) * slope, 6) AS windowed FROM t")
def curvature_basis(spark, d):
    c = facts(spark, d).groupBy((F.col("sample") % 3).cast("long").alias("part"), "k").agg(F.avg("truth").alias("y"))
    return rounded(axis.curvature_basis(c, "k", "y", "part", 10.0, 1.0, 0.45).select("part", "k", "x", "slope", "curvature", "windowed"))
