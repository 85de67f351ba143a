"""Model, generator, geometry and solver queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions.axis import band_of, trapezoid_weights
from orrery.operators import generators as g
from orrery.operators import ascent, components, emulator, geometry, hulls, models, solvers, spatial
from orrery.plans.common import BANDS, EDGES, FACTS_SQL, POINTS_SQL, facts, points, rounded, table
from orrery.plans.metric_plans import query

LENGTHS = [0.5] * 5


def _curves(spark, d):
    """The mean log ratio of each sample at each point of the axis."""
    return facts(spark, d).groupBy("sample", "k").agg(F.avg(F.log(F.col("pred") / F.col("truth"))).alias("y"))


@query()
def pca_scores(spark, d):
    c = _curves(spark, d)
    return rounded(models.scores(c, models.principal_components(c, "sample", "k", "y", 3), "sample", "k", "y"))


@query()
def pca_band_sensitivity(spark, d):
    c = _curves(spark, d)
    loadings = models.principal_components(c, "sample", "k", "y", 3)
    axis = trapezoid_weights(c.select("k").distinct()).select(F.col("k").cast("double").alias("axis"), "w", band_of(F.col("k"), EDGES, BANDS).alias("k_band"))
    return rounded(models.band_sensitivity(loadings, axis, "k_band"))


@query("WITH s AS (SELECT avg(p_size) AS mx, stddev_pop(p_size) AS sx, avg(p_retailprice) AS my, covar_pop(p_retailprice, p_size) AS c, count(*) AS n FROM part) SELECT p_partkey, round(my + (n * c / sx) / (n + 1.0) * (p_size - mx) / sx, 6) AS predicted FROM part, s")
def ridge_calibrator(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(models.predict_ridge(part, models.fit_ridge(part, ["p_size"], "p_retailprice"), "predicted").select("p_partkey", "predicted"))


@query()
def component_layouts(spark, d):
    """Global components with components of each band on what these leave: rms error of each sample's rebuilt curve."""
    c = _curves(spark, d)
    bands = c.select(F.col("k").cast("double").alias("axis"), band_of(F.col("k"), EDGES, BANDS).alias("band")).distinct()
    state, samples = components.state_of(c, "sample", "k", "y"), components.curves(c, "sample", "k", "y")
    loadings = components.layout(state, bands, 2, 2)
    out = components.rebuilt(components.coordinates(samples, state, loadings), state, loadings)
    truth = samples.select("sample", F.explode(F.arrays_zip("axis", "v")).alias("z")).select("sample", "z.axis", F.col("z.v").alias("y"))
    return rounded(out.join(truth, ["sample", "axis"]).groupBy("sample").agg(F.sqrt(F.avg(F.pow(F.col("value") - F.col("y"), F.lit(2.0)))).alias("rms")))


@query(f"WITH {FACTS_SQL}, y AS (SELECT sample, k, avg(ln(pred / truth)) AS y FROM facts GROUP BY ALL), w AS (SELECT sample FROM y GROUP BY sample HAVING count(*) = (SELECT count(DISTINCT k) FROM y)), o AS (SELECT sample, k, y FROM y JOIN w USING (sample)) SELECT a.k AS i, b.k AS j, round(covar_samp(a.y, b.y), 6) AS cov FROM o a JOIN o b ON a.sample = b.sample AND a.k <= b.k GROUP BY a.k, b.k")
def appended_covariance(spark, d):
    """The covariance of all samples' curves, from the state of the even ones to which the odd ones are appended."""
    c = _curves(spark, d)
    points_ = c.select(F.col("k").cast("double").alias("axis")).distinct()
    even = components.merged(components.states(components.curves(c.where("sample % 2 = 0"), "sample", "k", "y", points_)))
    state = components.appended(even, c.where("sample % 2 = 1"), "sample", "k", "y")
    cells = state.select("n", "axis", F.posexplode("scatter").alias("at", "x"))
    i, j = (F.get("axis", x.cast("int")).cast("int") for x in (F.floor(F.col("at") / F.size("axis")), F.col("at") % F.size("axis")))
    return rounded(cells.select(i.alias("i"), j.alias("j"), (F.col("x") / (F.col("n") - 1)).alias("cov")).where("i <= j"))


#: Consecutive ids that make up one small design, where many are compared.
SMALL_DESIGN = 40


#: Simplices and fans for each point of a small design in three dimensions, about.
SIMPLICES = 7


def _designs(p):
    return p.select(F.floor(F.col("id") / SMALL_DESIGN).cast("long").alias("design"), "id", "u")


def _design(spark, d):
    p = points(spark, d).withColumn("y", F.sin(3 * F.get("u", F.lit(0))) + F.get("u", F.lit(1)))
    return p, p.where("label = 0")


@query()
def gp_predict(spark, d):
    p, design = _design(spark, d)
    return rounded(models.gp_predict(design, p, LENGTHS))


@query()
def loo_residual(spark, d):
    p = _design(spark, d)[0]
    return rounded(models.loo_residuals(p.select(F.floor(F.col("id") / SMALL_DESIGN).cast("long").alias("design"), "id", "u", "y"), LENGTHS))


@query()
def alc_variance_reduction(spark, d):
    p, design = _design(spark, d)
    probes = p.where("label = 1").withColumn("w", F.lit(1.0))
    return rounded(models.variance_reduction(design, p.where("label > 1"), probes, LENGTHS))


@query("WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT p_brand, CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS halves FROM b")
def sobol_points(spark, d):
    """A design for each brand, of as many points as it has parts, from one sequence: neighbours in it lie in different halves of the first coordinate."""
    sized = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    points_ = g.sobol_for(sized, "p_brand", "n", 5)
    pair = F.floor(F.col("id") / 2)
    halves = points_.groupBy("p_brand", pair.alias("pair")).agg(F.count_distinct(F.floor(F.get("u", F.lit(0)) * 2)).alias("h"))
    return halves.groupBy("p_brand").agg(F.sum("h").alias("halves")).join(sized, "p_brand").select("p_brand", "n", "halves")


@query("WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT p_brand, CAST(dim AS INTEGER) AS dim, CAST(n AS BIGINT) AS slices, CAST(n AS BIGINT) AS held FROM b, range(3) t(dim)")
def latin_hypercube_slices(spark, d):
    """A design for each brand, of as many points as it has parts: in every dimension every slice holds one."""
    sized = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    u = g.latin_hypercube_for(sized, "p_brand", "n", 3, seed=7).select("p_brand", "n", F.posexplode("u").alias("dim", "x"))
    return u.groupBy("p_brand", "dim").agg(F.first("n").alias("slices"), F.count_distinct(F.floor(F.col("x") * F.col("n"))).alias("held"))


@query(f"WITH {POINTS_SQL}, c AS (SELECT id, list_transform(u[1:3], lambda x: CASE WHEN x >= 0.5 THEN 1.0 ELSE 0.0 END) AS c, u[1:3] AS u FROM points) SELECT id, CAST(c[1] + 2 * c[2] + 4 * c[3] AS BIGINT) AS code, round(sqrt(list_sum(list_transform(list_zip(u, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS dist FROM c")
def corner_support_points(spark, d):
    """The corner of the cube nearest to each point, of the support points' corners."""
    corners = g.support_points(spark, 3, "axis_corner_hybrid").where("id >= 6")
    p = points(spark, d).select("id", F.slice("u", 1, 3).alias("u"))
    code = F.aggregate(F.transform("ref_corner", lambda x, i: (x * F.pow(F.lit(2.0), i)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rounded(spatial.nearest_k(p, corners.withColumn("corner", F.col("u")), 1, ["corner"]).select("id", code.alias("code"), F.col("d").alias("dist")))


@query()
def dirichlet_barycentric(spark, d):
    return rounded(g.dirichlet(points(spark, d)).select("id", F.array_min("bary").alias("least"), F.aggregate("bary", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query()
def hotspot_jitter(spark, d):
    return g.jitter(points(spark, d).where("label = 0"), 0.05, seed=3, copies=4).groupBy("id").agg(F.count("*").alias("n"), F.min(F.array_min("u")).alias("least"), F.max(F.array_max("u")).alias("most"))


def _plane(spark, d):
    return points(spark, d).select("id", "label", F.slice("u", 1, 2).alias("u"))


@query()
def accepted_geometry(spark, d):
    """Reference points and how many designs hold and accept each, in three dimensions."""
    solid = points(spark, d).select("id", F.slice("u", 1, 3).alias("u"))
    references = g.sobol(spark, 256, 3)
    found = geometry.geometry_batch(_designs(solid), references)
    kept = geometry.accepted(found, geometry.thresholds(found), 0.3).groupBy("ref_id").agg(F.count("*").alias("accepted"))
    held = found.groupBy("ref_id").agg(F.count("*").alias("inside"))
    both = references.select(F.col("id").alias("ref_id")).join(held, "ref_id", "left").join(kept, "ref_id", "left")
    return both.select("ref_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("inside", "accepted")))


@query()
def delaunay_simplices(spark, d):
    """For each design of consecutive ids in four dimensions: simplices, their volume together, and facets of the hull."""
    designs = points(spark, d).select(F.floor(F.col("id") / SMALL_DESIGN).cast("long").alias("design"), "id", F.slice("u", 1, 4).alias("u"))
    cells = hulls.triangulated(designs).withColumn("volume", hulls.volume_of(F.col("vertices"))).groupBy("design").agg(F.count("*").alias("simplices"), F.sum("volume").alias("volume"))
    return rounded(cells.join(hulls.hull_facets(designs).groupBy("design").agg(F.count("*").alias("facets")), "design"), 9)


@query()
def hull_fans(spark, d):
    """Simplices that join the faces of the cube with each design's hull, in three dimensions."""
    designs = points(spark, d).select(F.floor(F.col("id") / SMALL_DESIGN).cast("long").alias("design"), "id", F.slice("u", 1, 3).alias("u"))
    return hulls.fans(designs, hulls.structured_support(3)).groupBy("design").agg(F.count_distinct("support").alias("supports"), F.count("*").alias("fans"))


_SIDE = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(f"WITH {POINTS_SQL}, s AS (SELECT id // 3 AS simplex, list(u[1:2] ORDER BY id) AS v FROM points GROUP BY 1 HAVING count(*) = 3), e AS (SELECT simplex, {_SIDE.format('v[2]', 'v[3]')} AS a, {_SIDE.format('v[1]', 'v[3]')} AS b, {_SIDE.format('v[1]', 'v[2]')} AS c FROM s), w AS (SELECT simplex, a * (b + c - a) AS x, b * (a + c - b) AS y, c * (a + b - c) AS z FROM e) SELECT simplex, CASE WHEN least(x, y, z) >= 0 THEN round(x / (x + y + z), 6) END AS w0, CASE WHEN least(x, y, z) >= 0 THEN round(y / (x + y + z), 6) END AS w1 FROM w")
def circumcentres(spark, d):
    """Where the circumcentre of three consecutive points in the plane lies, if in their triangle."""
    v = _plane(spark, d).groupBy(F.floor(F.col("id") / 3).cast("long").alias("simplex")).agg(F.array_sort(F.collect_list(F.struct("id", "u"))).alias("v")).where(F.size("v") == 3)
    found = hulls.circumcentres(v.select("simplex", F.transform("v", lambda x: x["u"]).alias("vertices")))
    return rounded(found.select("simplex", F.get("weights", F.lit(0)).alias("w0"), F.get("weights", F.lit(1)).alias("w1")))


@query()
def simplex_ascent(spark, d):
    """In each Delaunay simplex of all designs, and of the fans about them, the point of which the first design says least."""
    p = points(spark, d).select(F.floor(F.col("id") / SMALL_DESIGN).cast("long").alias("design"), "id", F.slice("u", 1, 3).alias("u"))
    cells = hulls.triangulated(p).select((F.col("design") * 100_000 + F.col("simplex")).alias("simplex"), "vertices")
    fan = hulls.fans(p, hulls.structured_support(3)).select((-1 - F.col("design") * 100_000 - F.col("support") * 100 - F.col("fan")).alias("simplex"), "vertices")
    best = ascent.best_points(cells.unionAll(fan), p.where(F.col("design") == 0), LENGTHS[:3], expected=SIMPLICES * p.count())
    return rounded(best.select("simplex", "start", "value"))


@query()
def farthest_points(spark, d):
    return solvers.farthest_points(points(spark, d), 12)


@query()
def diverse_batch(spark, d):
    p = points(spark, d).withColumn("score", F.get("u", F.lit(2)))
    return solvers.diverse_batch(p, 8, 0.4)


@query()
def greedy_dedup(spark, d):
    score = F.get("u", F.lit(2))
    # The whole table is the ranking: its place in it is an order, not a number.
    return solvers.greedy_dedup(points(spark, d).withColumn("rn", F.struct(score.isNull().alias("last"), (-score).alias("score"), "id")), 8, 0.1)


@query()
def glass_relaxation(spark, d):
    return rounded(solvers.relax(_designs(_plane(spark, d))).groupBy("design").agg(F.count("*").alias("n"), F.first("energy").alias("energy")), 3)


@query(f"WITH {FACTS_SQL}, e AS (SELECT band, avg(err) AS e FROM facts GROUP BY band), t AS (SELECT band, sqrt(greatest(e, 1e-12)) / avg(sqrt(greatest(e, 1e-12))) OVER () AS t FROM e), a AS (SELECT band, least(greatest(0.7 * 1.0 + 0.3 * t, 0.5), 2.0) AS w FROM t), b AS (SELECT band, least(greatest(w / avg(w) OVER (), 0.5), 2.0) AS w FROM a) SELECT band, round(w / avg(w) OVER (), 6) AS weight FROM b")
def weight_ema_update(spark, d):
    errors = facts(spark, d).groupBy("band").agg(F.avg("err").alias("e")).withColumn("previous", F.lit(1.0))
    return rounded(solvers.balanced_weights(errors, "e", "previous", 0.5, 0.3, 0.5, 2.0).select("band", "weight"))


@query()
def active_learning(spark, d):
    p = points(spark, d)
    return rounded(solvers.active_learning(p, p.where("label = 0").orderBy("id").limit(16), rounds=3, batch=8))


def _nations(spark, d):
    """A design of the nations (25 points at most, however many suppliers), its log ratios along the axis, and the suppliers as queries."""
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("nation"), ((F.col("s_acctbal") + 1000) / 11000).alias("bal"))
    ratio = facts(spark, d).join(sup, "sample").groupBy("nation", "k").agg(F.avg(F.log(F.col("pred") / F.col("truth"))).alias("y"))
    design = sup.groupBy("nation").agg(F.array(F.avg("bal"), F.first("nation") / 25.0).alias("u"))
    return ratio, design, sup.select(F.col("sample").alias("id"), F.array("bal", F.col("nation") / 25.0).alias("u"))


@query()
def emulator_predict(spark, d):
    """Ratios along the axis for all suppliers, learned from the nations."""
    return rounded(emulator.emulate(*_nations(spark, d), "nation", "k", "y", 3))


@query()
def emulator_anchored(spark, d):
    """Predicted spectra: ratios times the mean spectrum of the axis, with their deviations."""
    anchor = facts(spark, d).groupBy(F.col("k").cast("double").alias("axis")).agg(F.avg("truth").alias("anchor"))
    return rounded(emulator.anchored(emulator.emulate(*_nations(spark, d), "nation", "k", "y", 3, deviations=True), anchor, ["axis"]))
