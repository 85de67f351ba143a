"""Coordinate, candidate, binding and check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import coordinates as co
from orrery.operators import candidates as c
from orrery.plans.common import FACTS_SQL, POINTS_SQL, facts, points, rounded, table
from orrery.plans.metric_plans import query


@query("WITH r AS (SELECT p_brand, avg(p_retailprice) / 1000 AS ref FROM part GROUP BY p_brand), s AS (SELECT p_partkey, ref, ref * sqrt(p_retailprice / 1000.0) AS s8 FROM part JOIN r USING (p_brand)) SELECT p_partkey, round(s8, 6) AS sigma8, CAST(-1.0 AS DOUBLE) AS w, CAST(0.0 AS DOUBLE) AS wa, CAST(0.06 AS DOUBLE) AS mnu, round(1000.0 * pow(s8 / ref, 2), 6) AS amplitude FROM s")
def coordinate_change(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    own = part.join(part.groupBy("p_brand").agg((F.avg("p_retailprice") / 1000).alias("ref")), "p_brand")
    own = co.extended(own.withColumn("sigma8", co.sigma8(F.col("p_retailprice"), F.col("ref"), 1000.0)), {"w": -1.0, "wa": 0.0, "mnu": 0.06})
    return rounded(own.select("p_partkey", "sigma8", "w", "wa", "mnu", co.amplitude(F.col("sigma8"), F.col("ref"), 1000.0).alias("amplitude")))


@query("SELECT p_partkey, CAST(CASE WHEN p_size <= 10 THEN 0 ELSE least(greatest(ceil((p_size - 10) / 32.0 * 7), 1), 7) END AS BIGINT) AS n FROM part")
def fractional_counts(spark, d):
    return table(spark, d, "part").select("p_partkey", co.stage_count(F.lit(7), (F.col("p_size") - 10) / 32.0).alias("n"))


@query("WITH a AS (SELECT p_retailprice AS p, p_size AS s FROM part ORDER BY p_partkey LIMIT 1) SELECT p_partkey, round(ln(p_retailprice / p), 6) AS dlog_p_retailprice, CAST(p_size - s AS INTEGER) AS d_p_size FROM part, a")
def anchor_deltas(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    return rounded(co.anchor_deltas(part, part.orderBy("p_partkey").limit(1), ["p_retailprice"], ["p_size"]).select("p_partkey", "dlog_p_retailprice", "d_p_size"))


@query("WITH f AS (SELECT s_suppkey AS id, 'bal' AS feature, s_acctbal / 10000 AS value FROM supplier UNION ALL SELECT s_suppkey, 'nat', s_nationkey / 25.0 FROM supplier), k AS (SELECT r_regionkey AS k, 'bal' AS feature, 0.1 * (r_regionkey + 1) AS coefficient FROM region UNION ALL SELECT r_regionkey, 'nat', 0.05 * r_regionkey - 0.1 FROM region), s AS (SELECT id, k, sum(coefficient * value) AS s FROM f JOIN k USING (feature) GROUP BY id, k) SELECT id, k, round((1.0 + k) * exp(s), 6) AS value FROM s")
def basis_model(spark, d):
    sup, region = table(spark, d, "supplier"), table(spark, d, "region")
    two = lambda df, *rows: df.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), x.cast("double").alias("x")) for n, x in rows))).alias("f"))
    features = two(sup, ("bal", F.col("s_acctbal") / 10000), ("nat", F.col("s_nationkey") / 25.0)).select(F.col("s_suppkey").alias("id"), "f.feature", F.col("f.x").alias("value"))
    k = F.col("r_regionkey")
    coefficients = two(region, ("bal", 0.1 * (k + 1)), ("nat", 0.05 * k - 0.1)).select(k.alias("k"), "f.feature", F.col("f.x").alias("coefficient"))
    return rounded(c.basis_model(features, coefficients, region.select(k.alias("k"), (1.0 + k).alias("anchor"))))


@query("SELECT event_id, CAST(event_id % 20 > 1 AND (event_id % 20 - 1) % 3 = 0 AS BOOLEAN) AS due FROM events WHERE event_id % 7 <> 0 AND NOT contains(lower(event_type), 'click') AND json_valid(props) AND value IS NOT NULL")
def center_candidates(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "props", F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("p68"))
    return c.center_candidates(rows, "p68", "event_type", "props", "click").select("event_id", c.update_due(F.col("event_id") % 20, 3).alias("due"))


@query("WITH k AS (SELECT p_brand, p_type, avg(p_retailprice) AS a FROM part GROUP BY ALL) SELECT p_partkey, round(coalesce(CASE WHEN p_size % 3 = 0 THEN p_retailprice END, a), 6) AS anchor FROM part JOIN k USING (p_brand, p_type)")
def bound_anchors(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice", F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice")).alias("own"))
    known = part.groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("anchor"))
    return rounded(c.bound_anchors(part, known, ["p_brand", "p_type"], "own", "anchor").select("p_partkey", "anchor"))


@query(f"WITH {POINTS_SQL}, m AS (SELECT id, label, CASE WHEN id % 37 = label THEN list_transform(u, lambda x: x + 0.5) ELSE u END AS u FROM points WHERE id % 2 = 0) SELECT m.label, count(*) AS n, coalesce(bool_and(list_max(list_transform(list_zip(m.u, p.u), lambda z: abs(z[1] - z[2]))) <= 1e-9), true) AS same FROM m LEFT JOIN points p USING (id) GROUP BY m.label")
def same_prefix(spark, d):
    """For each label, whether a copy of every other point, some of them moved, still equals the points."""
    p = points(spark, d)
    moved = p.where("id % 2 = 0").withColumn("u", F.when(F.col("id") % 37 == F.col("label"), F.transform("u", lambda x: x + 0.5)).otherwise(F.col("u")))
    return c.same_prefix(moved, p.drop("label"), "id", "u", 1e-9, by=("label",))


@query(f"WITH {FACTS_SQL}, p AS (SELECT sample, band, avg(err) AS m FROM facts GROUP BY sample, band), o AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY m DESC, band) AS rn FROM p) SELECT sample, max(band) FILTER (WHERE rn = 1) AS dominant, round(max(m), 6) AS mean, round(sum(m), 6) AS total FROM o GROUP BY sample")
def dominant_band(spark, d):
    return rounded(c.dominant(facts(spark, d), "sample", "band", "err"))


@query(f"WITH {FACTS_SQL}, p AS (SELECT sample, band, avg(err) AS m FROM facts GROUP BY sample, band), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY band ORDER BY m DESC, sample) AS INTEGER) AS place FROM p) SELECT sample, band, round(m, 6) AS m, place FROM o WHERE place <= 5")
def top_components_by_band(spark, d):
    return rounded(c.top_per_band(facts(spark, d), "sample", "band", "err"))


@query(f"WITH {POINTS_SQL}, n AS (SELECT id, label, len(list_filter(u, lambda x: least(x, 1 - x) < 0.3)) AS near, len(u) AS dims FROM points), t AS (SELECT sum(near) AS near, sum(dims) AS dims FROM n WHERE label = 0) SELECT id, round(greatest((t.near + n.near) / greatest(1, t.dims + n.dims) - 0.05, 0.0) + 0.1 * n.near / n.dims, 9) AS penalty FROM n, t WHERE label <> 0")
def boundary_penalty(spark, d):
    p = points(spark, d)
    return c.boundary_penalty(p.where("label <> 0"), p.where("label = 0"), 0.3, 0.05).select("id", F.round("penalty", 9).alias("penalty"))


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / greatest(stddev_pop(p_size) OVER (), 1e-12), 6) AS z_p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / greatest(stddev_pop(p_retailprice) OVER (), 1e-12), 6) AS z_p_retailprice FROM part")
def zscore_embedding(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(c.embedding(part, ["p_size", "p_retailprice"]).select("p_partkey", "z_p_size", "z_p_retailprice"))


@query("SELECT p_partkey, round(CASE WHEN p_brand = 'Brand#13' THEN p_retailprice * 1.5 ELSE p_retailprice END, 6) AS score FROM part ORDER BY 2 DESC, 1 LIMIT 50")
def collection_scale(spark, d):
    ranking = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("score"))
    scaled = c.scaled_collection(ranking, "p_brand", "Brand#13", 1.5)
    return rounded(scaled.orderBy(F.desc(F.round("score", 6)), "p_partkey").limit(50).select("p_partkey", "score"))


@query("SELECT o_custkey, min(o_orderkey) FILTER (WHERE rn = 1) AS primary FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_orderkey) AS rn FROM orders) GROUP BY o_custkey")
def primary_design(spark, d):
    return c.primary(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey", ["P", "F"])


_MIX = [f"list_sum(list_transform(list_zip(v, w), lambda z: z[1][{i}] * z[2]))" for i in (1, 2, 3)]


@query(f"WITH {POINTS_SQL}, s AS (SELECT id // 3 AS simplex, list(u ORDER BY id) AS v FROM points GROUP BY 1 HAVING count(*) = 3), g AS (SELECT a.i, b.j, 4 - a.i - b.j AS l FROM (SELECT unnest(range(5)) AS i) a, (SELECT unnest(range(5)) AS j) b WHERE a.i + b.j <= 4), p AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS probe, [i / 4.0, j / 4.0, l / 4.0] AS w FROM g), x AS (SELECT simplex, probe, sin(3 * {_MIX[0]}) + {_MIX[1]} - pow({_MIX[2]} - 0.5, 2) AS score FROM s, p) SELECT simplex, round(max(score), 6) AS score FROM x GROUP BY simplex")
def simplex_search(spark, d):
    """The best lattice point of each simplex of three points."""
    p = points(spark, d).groupBy(F.floor(F.col("id") / 3).cast("long").alias("simplex")).agg(F.array_sort(F.collect_list(F.struct("id", "u"))).alias("v")).where(F.size("v") == 3)
    simplices = p.select("simplex", F.transform("v", lambda v: v["u"]).alias("vertices"))
    score = lambda u: F.sin(3 * F.get(u, F.lit(0))) + F.get(u, F.lit(1)) - F.pow(F.get(u, F.lit(2)) - 0.5, F.lit(2.0))
    return rounded(c.best_in_simplices(simplices, c.lattice(spark, 3, 4), score).select("simplex", "score"))


@query("WITH p AS (SELECT l_suppkey AS design, count(*) AS n FROM lineitem WHERE l_discount <= 0.02 GROUP BY 1) SELECT design, n, CAST(sum(n) OVER (ORDER BY design) - n AS BIGINT) AS \"offset\" FROM p")
def accepted_pair_offsets(spark, d):
    pairs = table(spark, d, "lineitem").where("l_discount <= 0.02").select(F.col("l_suppkey").alias("design"), F.col("l_partkey").alias("ref"))
    return c.pair_offsets(pairs, "design")


@query("WITH a AS (SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE value IS NULL) AS missing, count(DISTINCT user_id) AS users FROM events GROUP BY 1), n AS (SELECT avg(users) AS u FROM a) SELECT event_type, CAST(4 AS BIGINT) AS checks, CAST(1 + CAST(missing = 0 AS INTEGER) + CAST(users = round(u) AS INTEGER) AS BIGINT) AS passed, (3.0 + 5.0 * CAST(missing = 0 AS INTEGER) + CAST(users = round(u) AS INTEGER)) / 10.0 AS score FROM a, n")
def weighted_checks(spark, d):
    """Checks of each type of event: its rows against a count of its ids, no missing value, as many users as types have on average, a figure that is nowhere."""
    e = table(spark, d, "events")
    facts_ = e.groupBy("event_type").agg(F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_distinct("user_id").alias("users"))
    wanted = e.groupBy("event_type").agg(F.count_distinct("event_id").alias("rows")).crossJoin(facts_.agg(F.round(F.avg("users")).cast("long").alias("users")))
    as_text = lambda df, names: df.unpivot(["event_type"], names, "name", "value").withColumn("value", F.col("value").cast("string"))
    expected = as_text(wanted.withColumns({"missing": F.lit(0).cast("long"), "figures": F.lit(7).cast("long")}), ["rows", "missing", "users", "figures"])
    weight = F.create_map(*(F.lit(x) for pair in {"rows": 3.0, "missing": 5.0, "users": 1.0, "figures": 1.0}.items() for x in pair))
    return c.weighted_checks(as_text(facts_, ["rows", "missing", "users"]), expected.withColumn("weight", weight[F.col("name")]), by=("event_type",))
