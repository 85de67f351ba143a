"""Queries by distance: designs and candidates are five coordinates of the vectors, split by label."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import box
from orrery.operators import cells, discrepancy
from orrery.operators import spatial as s
from orrery.operators.metrics import spearman as spearman_of
from orrery.operators.quantiles import quantile_columns
from orrery.plans.common import POINTS_SQL, points, rounded, table
from orrery.plans.metric_plans import query

DIST = "sqrt(list_sum(list_transform(list_zip(a.u, b.u), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
DIST2 = "list_sum(list_transform(list_zip(a.u, b.u), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _parts(spark, d):
    """Candidates and the design they are compared with."""
    p = points(spark, d)
    return p.where("label <> 0"), p.where("label = 0")


@query(f"WITH {POINTS_SQL} SELECT id, round(list_min(list_transform(u, lambda x: least(x, 1.0 - x))), 6) AS edge, round(list_sum(list_transform(u, lambda x: x * 1.2 - 0.6)), 6) AS raw_sum FROM points")
def boundary_distance(spark, d):
    p = points(spark, d)
    raw = F.transform("u", lambda x: box.denormalize(x, F.lit(-0.6), F.lit(0.6)))
    return rounded(p.select("id", box.boundary_distance(F.col("u")).alias("edge"), F.aggregate(raw, F.lit(0.0), lambda a, x: a + x).alias("raw_sum")))


@query(f"WITH {POINTS_SQL}, q AS (SELECT a.id, min({DIST}) AS dist FROM points a, points b WHERE a.label <> 0 AND b.label = 0 GROUP BY a.id) SELECT id, round(dist, 6) AS dist FROM q")
def nearest_distance(spark, d):
    c, design = _parts(spark, d)
    return rounded(s.nearest_distance(c, design, "u", "dist").select("id", "dist"))


@query(f"WITH {POINTS_SQL}, q AS (SELECT a.id, min({DIST}) AS dist FROM points a, points b WHERE a.label = 0 AND b.label = 0 AND a.id <> b.id GROUP BY a.id) SELECT round(min(dist), 6) AS least, round(avg(dist), 6) AS mean, round(max(dist), 6) AS most FROM q")
def self_nn_stats(spark, d):
    design = _parts(spark, d)[1]
    near = s.nearest_distance(design, design, "u", "dist", other_than_self=True)
    return rounded(near.agg(F.min("dist").alias("least"), F.avg("dist").alias("mean"), F.max("dist").alias("most")))


@query(f"WITH {POINTS_SQL} SELECT a.id FROM points a WHERE a.label <> 0 AND NOT EXISTS (SELECT 1 FROM points b WHERE b.label = 0 AND {DIST} <= 0.15)")
def novelty_antijoin(spark, d):
    c, design = _parts(spark, d)
    return s.farther_than(c, design, 0.15).select("id")


_NEAR = f"""r AS (SELECT id, u, list_sum(u) / 5 AS value, CAST(1 + id % 30 AS BIGINT) AS n FROM points WHERE label = 0),
n AS (SELECT a.id, b.value, b.n, {DIST} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS rn FROM points a, r b WHERE a.label <> 0)"""


@query(f"WITH {POINTS_SQL}, {_NEAR}, k AS (SELECT *, max(dist) OVER (PARTITION BY id) AS dk FROM n WHERE rn <= 16), w AS (SELECT *, least(1.0, n / 20.0) * exp(-0.5 * pow(dist / greatest(dk, 1e-12), 2)) AS w FROM k) SELECT id, round(CASE WHEN min(dist) <= 1e-7 THEN arg_min(value, rn) ELSE sum(w * value) / sum(w) END, 6) AS value, round(CASE WHEN min(dist) <= 1e-7 THEN 1.0 ELSE least(1.0, pow(sum(w), 2) / sum(w * w) / 16) END, 6) AS confidence FROM w GROUP BY id")
def knn_reliability_smoother(spark, d):
    c, design = _parts(spark, d)
    ref = design.select("id", "u", (F.aggregate("u", F.lit(0.0), lambda a, x: a + x) / 5).alias("value"), (1 + F.col("id") % 30).alias("n"))
    return rounded(s.reliability_smoother(c, ref, 16))


@query(f"WITH {POINTS_SQL}, p AS (SELECT id, u, abs(u[1] - u[2]) AS err FROM points WHERE label = 0), h AS (SELECT * FROM p WHERE err >= (SELECT quantile_cont(err, 0.68) FROM p)) SELECT a.id, round(sum(exp(-{DIST2} / (2 * 0.2 * 0.2)) * b.err) / sum(exp(-{DIST2} / (2 * 0.2 * 0.2))), 6) AS score FROM points a, h b WHERE a.label <> 0 GROUP BY a.id")
def rbf_hotspot_score(spark, d):
    c, design = _parts(spark, d)
    probes = design.withColumn("err", F.abs(F.get("u", F.lit(0)) - F.get("u", F.lit(1))))
    level = F.broadcast(quantile_columns(probes, [], "err", {"level": 0.68}))
    hot = probes.crossJoin(level).where("err >= level")
    return rounded(s.kernel_mean(c, hot, "err", 0.2, "score").select("id", "score"))


@query(f"WITH {POINTS_SQL}, r AS (SELECT id, u, u[3] AS risk FROM points WHERE label = 0) SELECT a.id, round(sum(exp(-{DIST2} / (2 * 0.15 * 0.15)) * b.risk) / sum(exp(-{DIST2} / (2 * 0.15 * 0.15))), 6) AS risk FROM points a, r b GROUP BY a.id")
def kernel_regression(spark, d):
    p = points(spark, d)
    ref = p.where("label = 0").withColumn("risk", F.get("u", F.lit(2)))
    return rounded(s.kernel_mean(p, ref, "risk", 0.15, "risk").select("id", "risk"))


@query(f"WITH {POINTS_SQL}, k AS (SELECT id, label, list_transform(u, lambda x: round_even(x, 2)) AS k FROM points), a AS (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM k WHERE label <> 0), b AS (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM k WHERE label < 5) SELECT a.id AS left_id, b.id AS right_id FROM a JOIN b USING (k, n)")
def rounded_row_match(spark, d):
    p = points(spark, d)
    return s.match_rows(p.where("label <> 0"), p.where("label < 5"), 2)


@query(f"WITH {POINTS_SQL}, v AS (SELECT id, list_transform(u, lambda x: x + 1e-9) AS u FROM points WHERE label <> 0) SELECT a.id, coalesce(min(b.id), -1) AS match_id FROM v a LEFT JOIN points b ON b.label < 5 AND len(list_filter(list_zip(a.u, b.u), lambda z: abs(z[1] - z[2]) > 1e-8)) = 0 GROUP BY a.id")
def tolerance_match(spark, d):
    p = points(spark, d)
    moved = p.where("label <> 0").withColumn("u", F.transform("u", lambda x: x + 1e-9))
    return s.within_tolerance(moved, p.where("label < 5"), 1e-8).withColumn("match_id", F.coalesce("match_id", F.lit(-1).cast("long")))


@query("WITH s AS (SELECT value FROM events WHERE event_type = (SELECT min(event_type) FROM events)) SELECT event_id, round((SELECT count(*) FROM s WHERE s.value <= e.value) / (SELECT count(*) FROM s), 9) AS q FROM events e")
def rank_quantile(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    first = F.broadcast(e.agg(F.min("event_type").alias("event_type")))
    out = s.rank_quantile(e, e.join(first, "event_type"), "value", "q")
    return out.select("event_id", F.round("q", 9).alias("q"))


@query("WITH x AS (SELECT value, user_id, (2 * rank() OVER (ORDER BY value) + count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rx, (2 * rank() OVER (ORDER BY user_id) + count(*) OVER (PARTITION BY user_id) - 1) / 2.0 AS ry FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL) SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM x")
def spearman(spark, d):
    return rounded(spearman_of(table(spark, d, "events"), "value", "user_id"))


@query("WITH b AS (SELECT least(CAST(floor(l_discount / 0.02) AS INTEGER), 4) AS bin, l_quantity AS a, l_extendedprice AS e FROM lineitem), t AS (SELECT quantile_cont(l_extendedprice, 0.75) AS top FROM lineitem) SELECT bin, count(*) AS n, round(avg(a), 6) AS mean_a, round(quantile_cont(e, 0.25), 6) AS q25, round(median(e), 6) AS med, round(quantile_cont(e, 0.75), 6) AS q75, round(avg(CASE WHEN e >= top THEN 1.0 ELSE 0.0 END), 6) AS top_share, round(avg(CASE WHEN e >= top THEN 1.0 ELSE 0.0 END) / 0.25, 6) AS lift FROM b, t GROUP BY bin")
def enrichment_bins(spark, d):
    li = table(spark, d, "lineitem").select(F.least(F.floor(F.col("l_discount") / 0.02).cast("int"), F.lit(4)).alias("bin"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("e"))
    top = F.broadcast(quantile_columns(li, [], "e", {"top": 0.75}))
    share = F.avg(F.when(F.col("e") >= F.col("top"), 1.0).otherwise(0.0))
    per = li.crossJoin(top).groupBy("bin").agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), share.alias("top_share"), (share / 0.25).alias("lift"))
    return rounded(per.join(quantile_columns(li, ["bin"], "e", {"q25": 0.25, "med": 0.5, "q75": 0.75}), "bin"))


_KNOTS = "knots AS (SELECT floor(p_size / 5.0) * 5.0 AS x, avg(p_retailprice) AS y FROM part GROUP BY 1)"


def _knots(spark, d):
    """A coarse axis of every fifth size, to be read at the fine one."""
    return table(spark, d, "part").groupBy((F.floor(F.col("p_size") / 5.0) * 5.0).alias("x")).agg(F.avg("p_retailprice").alias("y"))


def _asked(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"))


@query(f"WITH {_KNOTS}, s AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM knots) SELECT l_orderkey, l_linenumber, round(y + (l_quantity - x) / (x1 - x) * (y1 - y), 6) AS value FROM lineitem JOIN s ON l_quantity >= x AND l_quantity < x1")
def asof_linear_interp(spark, d):
    met = s.brackets(_asked(spark, d), _knots(spark, d), "x", ["y"]).where("before is not null and after is not null")
    value = s.linear(F.col("x"), F.col("before.x"), F.col("before.y"), F.col("after.x"), F.col("after.y"))
    return rounded(met.select("l_orderkey", "l_linenumber", value.alias("value")))


@query(f"""WITH {_KNOTS}, a AS (SELECT x, y, lead(x) OVER o - x AS h, (lead(y) OVER o - y) / (lead(x) OVER o - x) AS d FROM knots WINDOW o AS (ORDER BY x)),
b AS (SELECT *, lag(h) OVER o AS hb, lag(d) OVER o AS db, lead(h) OVER o AS ha, lead(d) OVER o AS da, lag(h, 2) OVER o AS hbb, lag(d, 2) OVER o AS dbb FROM a WINDOW o AS (ORDER BY x)),
e AS (SELECT *, ((2 * h + ha) * d - h * da) / (h + ha) AS mf, ((2 * hb + hbb) * db - hb * dbb) / (hb + hbb) AS ml FROM b),
m AS (SELECT x, y, CASE WHEN hb IS NULL THEN CASE WHEN sign(mf) <> sign(d) THEN 0.0 WHEN sign(d) <> sign(da) AND abs(mf) > 3 * abs(d) THEN 3 * d ELSE mf END
  WHEN h IS NULL THEN CASE WHEN sign(ml) <> sign(db) THEN 0.0 WHEN sign(db) <> sign(dbb) AND abs(ml) > 3 * abs(db) THEN 3 * db ELSE ml END
  WHEN d * db > 0 THEN ((2 * h + hb) + (h + 2 * hb)) / ((2 * h + hb) / db + (h + 2 * hb) / d) ELSE 0.0 END AS m FROM e),
s AS (SELECT x, y, m, lead(x) OVER o AS x1, lead(y) OVER o AS y1, lead(m) OVER o AS m1 FROM m WINDOW o AS (ORDER BY x)),
t AS (SELECT l_orderkey, l_linenumber, (l_quantity - x) / (x1 - x) AS t, x1 - x AS h, y, m, y1, m1 FROM lineitem JOIN s ON l_quantity >= x AND l_quantity < x1)
SELECT l_orderkey, l_linenumber, round((1 + 2 * t) * (1 - t) * (1 - t) * y + t * (1 - t) * (1 - t) * h * m + t * t * (3 - 2 * t) * y1 + t * t * (t - 1) * h * m1, 6) AS value FROM t""")
def pchip_interp(spark, d):
    knots = s.pchip_knots(_knots(spark, d), "x", "y")
    met = s.brackets(_asked(spark, d), knots, "x", ["y", "slope"]).where("before is not null and after is not null")
    b, a = "before.", "after."
    value = s.hermite(F.col("x"), *(F.col(p + c) for p in (b, a) for c in ("x", "y", "slope")))
    return rounded(met.select("l_orderkey", "l_linenumber", value.alias("value")))


@query("SELECT p_partkey, round(p_retailprice * 1.1, 6) AS truth FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def accepted_support_semijoin(spark, d):
    accepted = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    kept = table(spark, d, "part").select("p_partkey", "p_retailprice").join(accepted, "p_partkey", "left_semi")
    return rounded(kept.select("p_partkey", (F.col("p_retailprice") * 1.1).alias("truth")))


@query(f"WITH {POINTS_SQL} SELECT round(sum(pow({DIST2} + 1e-4, -0.5)), 4) AS energy FROM points a, points b WHERE a.label = 0 AND b.label = 0 AND a.id < b.id")
def riesz_energy(spark, d):
    design = _parts(spark, d)[1]
    total = s.pair_sum(design, lambda d2: (d2 + 1e-4) ** -0.5)
    return total.select(F.round("value", 4).alias("energy"))


@query(f"WITH {POINTS_SQL}, p AS (SELECT a.id, unnest(range(5)) AS dim, {DIST2} AS d2, a.u AS au, b.u AS bu FROM points a, points b WHERE a.label = 0 AND b.label = 0 AND a.id <> b.id) SELECT id, CAST(dim AS INTEGER) AS dim, round(0.01 * sum(exp(-d2 / (2 * 0.2 * 0.2)) / (d2 + 0.05 * 0.05) * (au[dim + 1] - bu[dim + 1])), 6) AS force FROM p GROUP BY id, dim")
def repulsion_step(spark, d):
    return rounded(s.repulsion(_parts(spark, d)[1], 0.01, 0.2, 0.05))


_ABS = "list_transform(u, lambda x: abs(x - 0.5))"


@query(f"""WITH {POINTS_SQL}, p AS (SELECT id, u, {_ABS} AS c FROM points WHERE label = 0), n AS (SELECT count(*) AS n FROM p),
one AS (SELECT sum(list_product(list_transform(c, lambda x: 1 + 0.5 * x - 0.5 * x * x))) AS s FROM p),
two AS (SELECT sum(list_product(list_transform(list_zip(a.c, b.c, a.u, b.u), lambda z: 1 + 0.5 * z[1] + 0.5 * z[2] - 0.5 * abs(z[3] - z[4])))) AS s FROM p a, p b)
SELECT round(sqrt(pow(13.0 / 12, 5) - 2.0 / n * one.s + two.s / (n * n)), 6) AS discrepancy FROM one, two, n""")
def centered_discrepancy(spark, d):
    return rounded(discrepancy.discrepancy(_parts(spark, d)[1]))


@query(f"WITH {POINTS_SQL} SELECT id, u[1] > 0.4 AND u[2] > 0.4 AND (1 - u[1]) + (1 - u[2]) > 0.8 AS inside, round(greatest(abs((u[1] - 0.4) / 0.4 - 1.0 / 3), abs((u[2] - 0.4) / 0.4 - 1.0 / 3), abs(1 - (u[1] - 0.4) / 0.4 - (u[2] - 0.4) / 0.4 - 1.0 / 3)), 6) AS deviation FROM points")
def barycentric_in_triangle(spark, d):
    """Points in the triangle (0.4, 0.4), (0.8, 0.4), (0.4, 0.8): inside or not, and how far from its centre."""
    p = points(spark, d)
    a, b = (F.get("u", F.lit(0)) - 0.4) / 0.4, (F.get("u", F.lit(1)) - 0.4) / 0.4
    u0, u1 = F.get("u", F.lit(0)), F.get("u", F.lit(1))
    inside = (u0 > 0.4) & (u1 > 0.4) & ((1 - u0) + (1 - u1) > 0.8)
    return rounded(p.select("id", inside.alias("inside"), F.greatest(*(F.abs(x - 1.0 / 3) for x in (a, b, 1 - a - b))).alias("deviation")))


@query("SELECT CAST(floor(l_quantity / 10) AS INTEGER) AS bx, CAST(floor(l_discount / 0.025) AS INTEGER) AS by, count(*) AS n, round(median(l_extendedprice), 6) AS med FROM lineitem GROUP BY 1, 2")
def binned_median_plane(spark, d):
    li = table(spark, d, "lineitem").select(F.floor(F.col("l_quantity") / 10).cast("int").alias("bx"), F.floor(F.col("l_discount") / 0.025).cast("int").alias("by"), F.col("l_extendedprice").alias("x"))
    return rounded(li.groupBy("bx", "by").agg(F.count("*").alias("n")).join(quantile_columns(li, ["bx", "by"], "x", {"med": 0.5}), ["bx", "by"]))


@query("""WITH a AS (SELECT l_extendedprice AS x, (sqrt(3.0) / 3 * (l_quantity / 10) - (l_discount * 40) / 3) / 0.5 AS q, 2.0 / 3 * (l_discount * 40) / 0.5 AS r FROM lineitem),
b AS (SELECT x, q, r, -q - r AS s, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM a),
c AS (SELECT *, abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - s) AS fq, abs(rr - r) > abs(rs - s) AS fr FROM b)
SELECT CAST(CASE WHEN fq THEN -rr - rs ELSE rq END AS BIGINT) AS hq, CAST(CASE WHEN NOT fq AND fr THEN -rq - rs ELSE rr END AS BIGINT) AS hr, count(*) AS n, round(median(x), 6) AS med FROM c GROUP BY 1, 2""")
def hexagon_median_plane(spark, d):
    """Medians in hexagons of a plane, exact whatever the number of rows in one."""
    li = table(spark, d, "lineitem").select(cells.hexagon(F.col("l_quantity") / 10, F.col("l_discount") * 40, 0.5).alias("h"), F.col("l_extendedprice").alias("x")).select(F.col("h.q").alias("hq"), F.col("h.r").alias("hr"), "x")
    return rounded(li.groupBy("hq", "hr").agg(F.count("*").alias("n")).join(quantile_columns(li, ["hq", "hr"], "x", {"med": 0.5}), ["hq", "hr"]))


@query(f"WITH {POINTS_SQL}, p AS (SELECT a.id AS left_id, b.id AS right_id, list_max(list_transform(list_zip(a.u, b.u), lambda z: abs(z[1] - z[2]))) AS d FROM points a, points b WHERE a.label % 2 = 0 AND b.label % 2 = 1), n AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY d, right_id) AS l, row_number() OVER (PARTITION BY right_id ORDER BY d, left_id) AS r FROM p WHERE d <= 0.05) SELECT left_id, right_id FROM n WHERE l = 1 AND r = 1")
def mutual_nearest_rows(spark, d):
    """The first round of one-to-one matching: rows of even and of odd labels that are each other's nearest within a tolerance."""
    p = points(spark, d)
    return cells.mutual(cells.tolerance_pairs(p.where("label % 2 = 0"), p.where("label % 2 = 1"), 0.05))


@query()
def one_to_one_match(spark, d):
    """Rows of even and of odd labels, each used once: equal after rounding, then nearest of those that are left within a tolerance."""
    p = points(spark, d)
    left, right = p.where("label % 2 = 0"), p.where("label % 2 = 1")
    return cells.match_rows(left, right, s.match_rows(left, right, 2), 0.05)
