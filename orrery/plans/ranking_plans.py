"""Scoring, ranking, set and split queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import box, scale, targets
from orrery.operators import discrepancy, sets
from orrery.operators import ranking as rk
from orrery.operators.lineage import checkpointed
from orrery.operators.quantiles import quantile_columns
from orrery.plans.common import FACTS_SQL, POINTS_SQL, facts, points, rounded, table
from orrery.plans.metric_plans import SQL, query


@query("WITH b AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events) SELECT event_id, round(CASE WHEN hi > lo THEN least(greatest((value - lo) / (hi - lo), 0.0), 1.0) ELSE 0.0 END, 6) AS unit FROM events, b")
def robust_unit_scale(spark, d):
    return rounded(scale.robust_unit(table(spark, d, "events").select("event_id", "value"), "value", "unit").select("event_id", "unit"))


@query("WITH b AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier) SELECT s_suppkey, round(CASE WHEN hi - lo > 1e-30 THEN (s_acctbal - lo) / (hi - lo) ELSE 0.0 END, 6) AS unit FROM supplier, b")
def minmax_scale(spark, d):
    return rounded(scale.minmax_unit(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "unit").select("s_suppkey", "unit"))


@query("WITH b AS (SELECT quantile_cont(c_acctbal, 0.05) AS lo, quantile_cont(c_acctbal, 0.95) AS hi FROM customer) SELECT s_suppkey, round(CASE WHEN hi > lo THEN least(greatest((s_acctbal - lo) / (hi - lo), 0.0), 1.0) ELSE 0.0 END, 6) AS unit FROM supplier, b")
def frozen_bounds_scale(spark, d):
    bounds = scale.percentile_bounds(table(spark, d, "customer"), "c_acctbal")
    return rounded(scale.scale_by(table(spark, d, "supplier"), "s_acctbal", bounds, "unit").select("s_suppkey", "unit"))


@query("SELECT event_type, " + ", ".join(f"round(coalesce(nullif(quantile_cont(value, {p}) FILTER (WHERE value >= 0), 0.0), nullif(max(value) FILTER (WHERE value >= 0), 0.0), 1.0), 6) AS {n}" for n, p in (("med", 0.5), ("p68", 0.68), ("p95", 0.95))) + " FROM events GROUP BY event_type")
def positive_score_scale(spark, d):
    return rounded(scale.positive_scales(table(spark, d, "events"), "event_type", "value", {"med": "median", "p68": "p68", "p95": "p95"}))


@query("WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, round(least(greatest((p_retailprice - lo) / greatest(hi - lo, 1e-12), 0.0), 1.0), 6) AS unit, round((p_retailprice * 1.5 - lo) / greatest(hi - lo, 1e-12), 6) AS unclipped FROM part, b")
def unit_box_normalize(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    bounds = F.broadcast(part.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")))
    x, lo, hi = F.col("p_retailprice"), F.col("lo"), F.col("hi")
    return rounded(part.crossJoin(bounds).select("p_partkey", box.normalize(x, lo, hi).alias("unit"), box.normalize(x * 1.5, lo, hi, clip=False).alias("unclipped")))


@query("WITH f AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_quantity AS b, l_discount AS c FROM lineitem), q AS (SELECT quantile_cont(a, 0.05) AS a0, quantile_cont(a, 0.95) AS a1, quantile_cont(b, 0.05) AS b0, quantile_cont(b, 0.95) AS b1, quantile_cont(c, 0.05) AS c0, quantile_cont(c, 0.95) AS c1 FROM f) SELECT l_orderkey, l_linenumber, round(0.5 * least(greatest((a - a0) / (a1 - a0), 0), 1) + 0.3 * least(greatest((b - b0) / (b1 - b0), 0), 1) - 0.2 * least(greatest((c - c0) / (c1 - c0), 0), 1), 6) + 0.0 AS score FROM f, q")
def acquisition_score(spark, d):
    """A weighted sum of robustly scaled terms, the boundary term taken off."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount")
    terms = ("l_extendedprice", "l_quantity", "l_discount")
    bounds = reduce(DataFrame.crossJoin, (quantile_columns(li, [], c, {f"{c}_lo": 0.05, f"{c}_hi": 0.95}) for c in terms))
    unit = lambda c: box.clip_unit((F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo")))
    both = li.crossJoin(F.broadcast(bounds))
    score = 0.5 * unit("l_extendedprice") + 0.3 * unit("l_quantity") - 0.2 * unit("l_discount")
    return both.select("l_orderkey", "l_linenumber", (F.round(score, 6) + 0.0).alias("score"))


@query(f"WITH {FACTS_SQL}, s AS (SELECT sample, var_samp(pred) AS v, avg(pred - truth) AS b FROM facts GROUP BY sample), q AS (SELECT quantile_cont(v, 0.68) AS sv, quantile_cont(abs(b), 0.68) AS sb FROM s) SELECT sample, round(sqrt(pow(v / sv, 2) + pow(0.7 * b / sb, 2)), 6) AS both, round(abs(0.7 * b / sb), 6) AS bias_only FROM s, q")
def variance_bias_score(spark, d):
    per = facts(spark, d).groupBy("sample").agg(F.var_samp("pred").alias("v"), F.avg(F.col("pred") - F.col("truth")).alias("b"))
    off = per.withColumn("off", F.abs("b"))
    scales = F.broadcast(quantile_columns(off, [], "v", {"sv": 0.68}).crossJoin(quantile_columns(off, [], "off", {"sb": 0.68})))
    score = lambda mode: targets.variance_bias_score(F.col("v"), F.col("b"), F.col("sv"), F.col("sb"), 0.7, mode)
    return rounded(per.crossJoin(scales).select("sample", score("variance_bias").alias("both"), score("bias_only").alias("bias_only")))


@query("WITH n AS (SELECT p_brand, count(*) AS c, CAST(2 AS BIGINT) AS least, row_number() OVER (ORDER BY p_brand) AS id FROM part GROUP BY p_brand), i AS (SELECT *, (200 - sum(least) OVER ()) * c / sum(c) OVER () AS ideal FROM n), f AS (SELECT *, floor(ideal) AS fl FROM i) SELECT p_brand, CAST(least + fl + CASE WHEN row_number() OVER (ORDER BY round(ideal - fl, 9) DESC, id) <= 200 - sum(least + fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS count FROM f")
def largest_remainder_allocation(spark, d):
    brands = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("c"))
    numbered = rk.positions(brands, "p_brand", name="id").withColumn("least", F.lit(2).cast("long"))
    return rk.largest_remainder(numbered, 200, "c", "least").select("p_brand", "count")


_SCORED = f"{POINTS_SQL}, s AS (SELECT id, round(list_sum(u) - u[2], 9) AS score, list_min(list_transform(u, lambda x: least(x, 1.0 - x))) AS edge, label FROM points)"


def _scored(spark, d):
    p = points(spark, d)
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x) - F.get("u", F.lit(1))
    return p.select("id", F.round(total, 9).alias("score"), box.boundary_distance(F.col("u")).alias("edge"), "label", "u")


@query(f"WITH {_SCORED}, f AS (SELECT id, score, edge < 0.2 AS flag, row_number() OVER (PARTITION BY edge < 0.2 ORDER BY score DESC, id) AS n FROM s), o AS (SELECT id, row_number() OVER (ORDER BY flag AND n > 6, score DESC, id) AS rn FROM f) SELECT id, CAST(rn AS INTEGER) AS rn FROM o WHERE rn <= 20")
def boundary_quota_topk(spark, d):
    return rk.quota_top(_scored(spark, d), "score", F.col("edge") < 0.2, 20, 0.3).select("id", "rn")


@query(f"WITH {_SCORED} SELECT label, arg_max(id, {{'s': score, 'i': -id}}) AS id, max(score) AS score FROM s GROUP BY label")
def best_per_simplex(spark, d):
    return rk.best_per_group(_scored(spark, d).select("id", "score", "label"), "label", "score").select("label", "id", "score")


def _own_sql(u: str) -> str:
    return f"list_product(list_transform({u}, lambda x: 1 + 0.5 * abs(x - 0.5) - 0.5 * abs(x - 0.5) * abs(x - 0.5)))"


def _pair_sql(u: str, v: str) -> str:
    return f"list_product(list_transform(list_zip({u}, {v}), lambda z: 1 + 0.5 * abs(z[1] - 0.5) + 0.5 * abs(z[2] - 0.5) - 0.5 * abs(z[1] - z[2])))"


#: Every point with its score, its risk and what it would take off the discrepancy of the design (label 0).
_GAINS = f"""{_SCORED}, d AS (SELECT id, u FROM points WHERE label = 0), n AS (SELECT count(*) AS n, sum({_own_sql("u")}) AS s1 FROM d),
two AS (SELECT sum({_pair_sql("a.u", "b.u")}) AS s2 FROM d a, d b), k AS (SELECT a.id, sum({_pair_sql("a.u", "b.u")}) AS k FROM points a, d b GROUP BY a.id),
r AS (SELECT p.id, s.score, p.u[4] AS risk, round(s2 / (n * n) - 2.0 / n * s1 + 2.0 / (n + 1) * (s1 + {_own_sql("p.u")}) - (s2 + 2 * k + {_pair_sql("p.u", "p.u")}) / ((n + 1) * (n + 1)), 12) + 0.0 AS gain
    FROM points p JOIN s USING (id) JOIN k USING (id), n, two)"""


def _gains(spark, d):
    p = _scored(spark, d).withColumn("risk", F.get("u", F.lit(3)))
    found = discrepancy.gains(p, p.where("label = 0"))
    # Written once: rankings read it several times.
    return checkpointed(found.select("id", "score", "risk", (F.round("gain", 12) + 0.0).alias("gain")))


@query(f"WITH {_GAINS} SELECT id, round(gain * 1e6, 3) + 0.0 AS gain FROM r")
def discrepancy_gain(spark, d):
    """In millionths: what each point would take off the squared discrepancy of the design."""
    return _gains(spark, d).select("id", (F.round(F.col("gain") * 1e6, 3) + 0.0).alias("gain"))


def _parted_sql(near: str, within: str, more: str = "") -> str:
    return f"WITH {_GAINS}{more}, m AS (SELECT *, {near} AS near FROM r) SELECT id, CAST(row_number() OVER (ORDER BY near DESC, CASE WHEN near THEN -{within} ELSE -score END, id) AS BIGINT) AS rn FROM m"


def _report(name: str) -> str:
    """The first 50 rows of a whole ranking."""
    return f"SELECT * FROM ({SQL[name]}) WHERE rn <= 50"


@query(_parted_sql("gain >= (SELECT quantile_cont(gain, 0.5) FROM r)", "score"))
def guard_partition_whole(spark, d):
    return rk.whole_guard(_gains(spark, d), "score", "gain", 0.5).select("id", "rn")


@query(_parted_sql("score >= 0.9 * (SELECT max(score) FROM r)", "gain"))
def spacefill_tiebreak_whole(spark, d):
    return rk.whole_tiebreak(_gains(spark, d), "score", "gain", 0.9).select("id", "rn")


@query(f"WITH {_GAINS}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place, ceil(0.1 * count(*) OVER ()) AS size FROM r) SELECT id, CAST(row_number() OVER (ORDER BY place <= size DESC, CASE WHEN place <= size THEN -gain ELSE -score END, id) AS BIGINT) AS rn FROM o")
def rerank_prefix_exact_whole(spark, d):
    """The best tenth of the table, however many rows, in the order of another score."""
    return rk.whole_rescored(_gains(spark, d), "score", "gain", 0.1).select("id", "rn")


_TERMS = {"score": 0.7, "gain": 0.3}


def _unit_sql(c: str) -> str:
    return f"CASE WHEN {c}_hi - {c}_lo > 1e-30 THEN ({c} - {c}_lo) / ({c}_hi - {c}_lo) ELSE 0.0 END"


def _ends_sql(terms, among: str = "") -> str:
    return ", ".join(f"min({c}) {among} OVER () AS {c}_lo, max({c}) {among} OVER () AS {c}_hi" for c in terms)


def _total_sql(terms) -> str:
    return f"round({' + '.join(f'{w} * {_unit_sql(c)}' for c, w in terms.items())}, 9)"


@query(f"WITH {_GAINS}, e AS (SELECT *, {_ends_sql(_TERMS)} FROM r), b AS (SELECT *, {_total_sql(_TERMS)} AS blend FROM e) SELECT id, round(blend, 6) AS blend, CAST(row_number() OVER (ORDER BY blend DESC, id) AS BIGINT) AS rn FROM b")
def spacefill_blend_whole(spark, d):
    return rounded(rk.whole_blend(_gains(spark, d), _TERMS).select("id", "blend", "rn"))


_SET_TERMS = {"score": 0.4, "risk": 0.3, "gain": 0.3}


@query(f"WITH {_GAINS}, m AS (SELECT *, score >= 0.8 * (SELECT max(score) FROM r) AS near FROM r), e AS (SELECT *, {_ends_sql(_SET_TERMS, 'FILTER (WHERE near)')} FROM m), t AS (SELECT *, {_total_sql(_SET_TERMS)} AS total FROM e) SELECT id, CAST(row_number() OVER (ORDER BY near DESC, CASE WHEN near THEN -total ELSE -score END, id) AS BIGINT) AS rn FROM t")
def set_aware_rerank_whole(spark, d):
    return rk.whole_set_aware(_gains(spark, d), "score", _SET_TERMS, 0.8).select("id", "rn")


@query(_report("guard_partition_whole"))
def guard_partition(spark, d):
    return guard_partition_whole(spark, d).where("rn <= 50")


@query(_report("spacefill_tiebreak_whole"))
def spacefill_tiebreak(spark, d):
    return spacefill_tiebreak_whole(spark, d).where("rn <= 50")


@query(_report("rerank_prefix_exact_whole"))
def rerank_prefix_exact(spark, d):
    return rerank_prefix_exact_whole(spark, d).where("rn <= 50")


@query(_report("spacefill_blend_whole"))
def spacefill_blend(spark, d):
    return spacefill_blend_whole(spark, d).where("rn <= 50")


@query(_report("set_aware_rerank_whole"))
def set_aware_rerank(spark, d):
    return set_aware_rerank_whole(spark, d).where("rn <= 50")


@query(f"WITH {_SCORED}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rn FROM s ORDER BY score DESC, id LIMIT 30), b AS (SELECT id, row_number() OVER (ORDER BY edge DESC, id) AS rn FROM s ORDER BY edge DESC, id LIMIT 30), f AS (SELECT id, min({{'p': part, 'r': rn}}) AS pos FROM (SELECT id, 0 AS part, rn FROM a UNION ALL SELECT id, 1, rn FROM b) GROUP BY id) SELECT id, CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS rn FROM f")
def ordered_union(spark, d):
    p = _scored(spark, d)
    first = rk.positions(rk.top(p, "score", 30), F.desc("score"), "id")
    return rk.ordered_union(first, rk.positions(rk.top(p, "edge", 30), F.desc("edge"), "id"))


@query("WITH r AS (SELECT l_suppkey AS cand, l_extendedprice / 1000 AS before, l_extendedprice * (1 - l_discount) / 1000 AS after FROM lineitem), q AS (SELECT cand, quantile_cont(before, 0.68) AS q FROM r GROUP BY cand), w AS (SELECT r.cand, before, after, q, before - after AS gain, (row_number() OVER (PARTITION BY r.cand ORDER BY before, after) - 0.5) / count(*) OVER (PARTITION BY r.cand) AS place FROM r JOIN q USING (cand)), x AS (SELECT *, 0.05 + 0.95 * exp(-0.5 * pow((before - q) / (0.15 * q), 2)) AS shell, 0.05 + 0.95 * 0.5 * (1 + cos(3.141592653589793 * least(abs(place - 0.68) / 0.2, 1.0))) AS body FROM w) SELECT cand, round(quantile_cont(before, 0.68) - quantile_cont(after, 0.68), 6) AS quantile_proxy, round(coalesce(avg(gain) FILTER (WHERE abs(before - q) <= 0.15 * q), 0.0), 6) AS quantile_shell, round(sum(shell * gain) / sum(shell), 6) AS soft_quantile, round(sum(body * gain) / sum(body), 6) AS rank_body, round(avg(greatest(before - q, 0.0)) - avg(greatest(after - q, 0.0)), 6) AS exceedance FROM x GROUP BY cand")
def risk_functionals(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cand"), (F.col("l_extendedprice") / 1000).alias("before"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("after"))
    q = li.groupBy("cand").agg(F.percentile("before", F.lit(0.68)).alias("q"))
    place = (F.row_number().over(Window.partitionBy("cand").orderBy("before", "after")) - 0.5) / F.count("*").over(Window.partitionBy("cand"))
    x = li.join(q, "cand").withColumn("gain", F.col("before") - F.col("after")).withColumn("place", place)
    x = x.withColumn("shell", rk.shell_weight(F.col("before"), F.col("q"))).withColumn("body", rk.rank_window_weight(F.col("place")))
    over = lambda c: F.avg(F.greatest(F.col(c) - F.col("q"), F.lit(0.0)))
    near = F.abs(F.col("before") - F.col("q")) <= 0.15 * F.col("q")
    mean = lambda w: F.sum(F.col(w) * F.col("gain")) / F.sum(w)
    return rounded(x.groupBy("cand").agg(rk.quantile_drop("before", "after").alias("quantile_proxy"), F.coalesce(F.avg(F.when(near, F.col("gain"))), F.lit(0.0)).alias("quantile_shell"), mean("shell").alias("soft_quantile"), mean("body").alias("rank_body"), (over("before") - over("after")).alias("exceedance")))


@query("SELECT p_brand, arg_min(p_partkey, {'p': p_retailprice, 'k': p_partkey}) AS part, min(p_retailprice) AS price FROM part WHERE p_size > 10 GROUP BY p_brand")
def argmin_under_predicate(spark, d):
    part = table(spark, d, "part").where("p_size > 10")
    return part.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("part"), F.min("p_retailprice").alias("price"))


@query("WITH c AS (SELECT o_orderpriority AS case_id, o_orderstatus AS candidate, avg(o_totalprice) AS score, count(*) / 1000.0 AS cost FROM orders GROUP BY 1, 2) SELECT case_id, arg_max(candidate, {'u': round(score - cost, 6), 'c': -ascii(candidate)}) AS candidate, round(max(score - cost), 6) AS utility FROM c GROUP BY case_id")
def utility_argmax(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("case_id"), F.col("o_orderstatus").alias("candidate")).agg(F.avg("o_totalprice").alias("score"), (F.count("*") / 1000.0).alias("cost"))
    utility = F.col("score") - F.col("cost")
    best = F.max_by("candidate", F.struct(F.round(utility, 6).alias("u"), (-F.ascii("candidate")).alias("c")))
    return rounded(c.groupBy("case_id").agg(best.alias("candidate"), F.max(utility).alias("utility")))


@query("WITH m AS (SELECT o_orderpriority AS budget, o_orderstatus AS mode, avg(o_totalprice) AS value FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2) SELECT a.budget, round(f.value - a.value, 6) AS gain_abs, round(CASE WHEN f.value <> 0 THEN (f.value - a.value) / f.value * 100.0 ELSE 0.0 END, 6) AS gain_pct FROM m a JOIN m f ON a.budget = f.budget AND a.mode = 'O' AND f.mode = 'F'")
def paired_gain(spark, d):
    m = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O")).groupBy(F.col("o_orderpriority").alias("budget")).pivot("o_orderstatus", ["F", "O"]).agg(F.avg("o_totalprice")).where("F is not null and O is not null")
    return rounded(m.select("budget", (F.col("F") - F.col("O")).alias("gain_abs"), targets.improvement_percent(F.col("F"), F.col("O")).alias("gain_pct")))


@query(f"WITH {FACTS_SQL}, m AS (SELECT band, sample % 2 AS side, avg(err) AS mean, quantile_cont(err, 0.68) AS p68, max(err) AS most FROM facts GROUP BY 1, 2), u AS (SELECT band, side, metric, value FROM m UNPIVOT (value FOR metric IN (mean, p68, most))) SELECT a.band, a.metric, round(a.value - b.value, 6) AS delta, round((a.value - b.value) / greatest(abs(b.value), 1e-30), 6) AS relative_delta, CASE WHEN a.value < b.value THEN 'a' WHEN a.value > b.value THEN 'b' ELSE 'tie' END AS better FROM u a JOIN u b ON a.band = b.band AND a.metric = b.metric AND a.side = 0 AND b.side = 1")
def metric_compare_unpivot(spark, d):
    m = facts(spark, d).groupBy("band", (F.col("sample") % 2).alias("side")).agg(F.avg("err").alias("mean"), F.percentile("err", F.lit(0.68)).alias("p68"), F.max("err").alias("most"))
    u = m.unpivot(["band", "side"], ["mean", "p68", "most"], "metric", "value")
    a, b = (u.where(F.col("side") == i).select("band", "metric", F.col("value").alias(n)) for i, n in ((0, "a"), (1, "b")))
    delta = F.col("a") - F.col("b")
    better = F.when(delta < 0, "a").when(delta > 0, "b").otherwise("tie")
    return rounded(a.join(b, ["band", "metric"]).select("band", "metric", delta.alias("delta"), (delta / F.greatest(F.abs("b"), F.lit(1e-30))).alias("relative_delta"), better.alias("better")))


@query(f"WITH {FACTS_SQL}, m AS (SELECT sample, count(*) AS budget, quantile_cont(err, 0.68) AS p68 FROM facts GROUP BY sample) SELECT a.sample AS design, b.sample AS baseline, round(1.0 - a.p68 / greatest(b.p68, 1e-300), 6) AS improvement FROM m a JOIN m b ON a.budget = b.budget AND a.sample <> b.sample AND b.sample % 2 = 0 AND a.sample % 2 = 1")
def same_budget_comparison(spark, d):
    m = facts(spark, d).groupBy("sample").agg(F.count("*").alias("budget"), F.percentile("err", F.lit(0.68)).alias("p68"))
    a = m.where("sample % 2 = 1").select(F.col("sample").alias("design"), "budget", F.col("p68").alias("value"))
    b = m.where("sample % 2 = 0").select(F.col("sample").alias("baseline"), "budget", F.col("p68").alias("base"))
    return rounded(a.join(b, "budget").select("design", "baseline", targets.improvement(F.col("base"), F.col("value")).alias("improvement")))


@query(f"WITH {POINTS_SQL}, k AS (SELECT id, list_transform(u, lambda x: round_even(x, 1)) AS k, label FROM points) SELECT min(id) AS id FROM k WHERE k NOT IN (SELECT k FROM k WHERE label = 0) GROUP BY k")
def rounded_distinct(spark, d):
    p = points(spark, d)
    return sets.first_distinct(p, "u", 1, p.where("label = 0")).select("id")


@query(f"WITH {POINTS_SQL}, k AS (SELECT id, label, list_transform(u, lambda x: round_even(x, 1)) AS k FROM points), f AS (SELECT k, min({{'l': label, 'i': id}}) AS f FROM k GROUP BY k) SELECT f.l AS role, count(*) AS n, CAST(min(f.i) AS BIGINT) AS first_id FROM f GROUP BY f.l")
def disjoint_roles(spark, d):
    roles = sets.disjoint_roles(points(spark, d).withColumn("role", F.col("label")), "u", 1)
    return roles.groupBy("role").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"WITH {_SCORED}, c AS (SELECT id FROM s ORDER BY score DESC, id LIMIT 25) SELECT id FROM points WHERE id NOT IN (SELECT id FROM c)")
def pool_except_chosen(spark, d):
    p = _scored(spark, d)
    return p.select("id").join(rk.top(p, "score", 25).select("id"), "id", "left_anti")


@query("SELECT count(DISTINCT round(l_extendedprice, 0)) FILTER (WHERE l_returnflag = 'A') AS a, count(DISTINCT round(l_extendedprice, 0)) FILTER (WHERE l_returnflag <> 'A') AS b, count(DISTINCT round(l_extendedprice, 0)) AS either FROM lineitem")
def distinct_row_counts(spark, d):
    key, a = F.round("l_extendedprice", 0), F.col("l_returnflag") == "A"
    return table(spark, d, "lineitem").agg(F.count_distinct(F.when(a, key)).alias("a"), F.count_distinct(F.when(~a, key)).alias("b"), F.count_distinct(key).alias("either"))


@query("SELECT design, count(*) AS n, min(v) AS lo, max(v) AS hi FROM (SELECT 'seed' AS design, p_retailprice AS v FROM part WHERE p_size <= 10 UNION ALL SELECT 'active', p_retailprice FROM part WHERE p_size <= 10 OR p_size > 40 UNION ALL SELECT 'tail', p_retailprice FROM part WHERE p_size > 25) GROUP BY design")
def named_designs(spark, d):
    part, size = table(spark, d, "part").select("p_size", F.col("p_retailprice").alias("v")), F.col("p_size")
    designs = F.array(*(F.when(test, F.lit(name)) for name, test in (("seed", size <= 10), ("active", (size <= 10) | (size > 40)), ("tail", size > 25))))
    return part.select(F.explode(F.array_compact(designs)).alias("design"), "v").groupBy("design").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("SELECT p_partkey, sha256(CAST(p_size AS VARCHAR) || '|' || p_brand || '|' || p_type)[1:16] AS digest FROM part")
def row_digest(spark, d):
    return table(spark, d, "part").select("p_partkey", F.substring(F.sha2(F.concat_ws("|", F.col("p_size").cast("string"), "p_brand", "p_type"), 256), 1, 16).alias("digest"))
