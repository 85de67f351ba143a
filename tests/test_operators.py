"""Invariants of operators on literal fixtures, against numpy where SQL has no word for them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import box, scale, targets
from orrery.operators import generators, geometry, metrics, models, progress, ranking, sets, solvers, spatial, textops
from orrery.operators.quantiles import exact_quantiles


def vectors(spark, x, **more):
    names = ["id", "u", *more]
    return spark.createDataFrame([(i, [float(v) for v in row], *(m[i] for m in more.values())) for i, row in enumerate(x)], names)


def test_accumulator_golden(spark):
    rows = spark.createDataFrame([(0, 1.0), (2, 3.0), (3, 4.0), (0, 3.0), (1, 8.0), (3, 6.0)], "ref int, v double")
    out = {r["ref"]: r for r in metrics.estimate(metrics.accumulate(rows, ["ref"], "v"), usable=1, confident=2).collect()}
    assert [out[i]["mean"] for i in range(4)] == [2, 8, 3, 5]
    assert [out[i]["n"] for i in range(4)] == [2, 1, 1, 2]
    assert [out[i]["high_confidence"] for i in range(4)] == [True, False, False, True]
    assert out[1]["std"] == 0


def test_accumulator_merges_like_one_pass(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("ref"), (F.col("id") % 3).alias("part"), F.sin("id").alias("v"))
    once = metrics.accumulate(rows, ["ref"], "v").orderBy("ref").toPandas()
    merged = metrics.merge(metrics.accumulate(rows, ["ref", "part"], "v"), ["ref"]).orderBy("ref").toPandas()
    assert np.allclose(once, merged)


def test_exact_quantiles_with_ties_and_nulls(spark):
    x = [None, 1.0, 1.0, 1.0, 2.0, 5.0, 5.0, 9.0]
    df = spark.createDataFrame([("a", v) for v in x] + [("b", 3.0)], "g string, x double")
    got = {(r["g"], r["share"]): r["value"] for r in exact_quantiles(df, ["g"], "x", [0.0, 0.3, 0.68, 1.0]).collect()}
    for s in (0.0, 0.3, 0.68, 1.0):
        assert got["a", s] == pytest.approx(np.percentile([v for v in x if v is not None], 100 * s))
        assert got["b", s] == 3.0


def test_exact_quantiles_of_every_size(spark):
    """Groups of 1 to 2,000 rows and larger, evenly spread and skewed: no value is null."""
    sizes = [*range(1, 60), *range(60, 2001, 97), 1999, 2000, 2001, 5000]
    rng = np.random.default_rng(9)
    data = {(n, kind): np.arange(n, dtype=float) if kind == 0 else np.exp(3 * rng.normal(size=n)) for n in sizes for kind in (0, 1)}
    df = spark.createDataFrame([(n * 2 + kind, float(v)) for (n, kind), x in data.items() for v in x], "g long, x double")
    shares = [0.05, 0.5, 0.68, 0.95]
    got = {(r["g"], r["share"]): r["value"] for r in exact_quantiles(df, ["g"], "x", shares).collect()}
    for (n, kind), x in data.items():
        for s in shares:
            assert got[n * 2 + kind, s] == pytest.approx(np.percentile(x, 100 * s)), (n, kind, s)


def test_density_sums_to_one(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 4.0), (4, -1.0)], "id int, x double")
    mass = [r["p"] for r in metrics.density_from(df, "x", 0.5, "p").collect()]
    assert sum(mass) == pytest.approx(1) and min(mass) > 0


def test_project_to_simplex(spark):
    df = spark.createDataFrame([([0.2, 0.9, -3.0],), ([5.0, 5.0, 5.0],), ([0.1, 0.2, 0.7],)], "v array<double>")
    got = np.array([r[0] for r in df.select(box.project_to_simplex(F.col("v"))).collect()])
    assert np.allclose(got.sum(axis=1), 1) and (got >= 0).all()
    assert np.allclose(got, [[0.15, 0.85, 0], [1 / 3] * 3, [0.1, 0.2, 0.7]])


def test_box_round_trip_and_points(spark):
    df = spark.createDataFrame([(2.0, [0.1, 0.5]), (9.0, [0.2, float("nan")])], "x double, u array<double>")
    lo, hi = F.lit(1.0), F.lit(5.0)
    out = df.select(box.denormalize(box.normalize(F.col("x"), lo, hi, clip=False), lo, hi), box.normalize(F.col("x"), lo, hi), box.is_point(F.col("u"), 2)).collect()
    assert [tuple(r) for r in out] == [(2.0, 0.25, True), (9.0, 1.0, False)]


def test_target_names(spark):
    for kind in ("ratio", "logdiff"):
        row = spark.range(1).select(targets.target_parts(F.lit(targets.target_name(kind, "linear"))).alias("p")).first()["p"]
        assert (row["kind"], row["anchor"]) == (kind, "linear")


def test_minmax_is_zero_where_a_value_is_not_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),)], "x double")
    assert [r["u"] for r in scale.minmax_unit(df, "x", "u").collect()] == [0, 0]


def test_smoother_gives_knots_their_values(spark):
    x = [[0, 0], [1, 0], [0, 1], [1, 1], [0.5, 0.5]]
    ref = vectors(spark, x, value=[1.0, 2.0, 3.0, 4.0, 2.5], n=[20, 20, 20, 20, 5])
    got = {r["id"]: r for r in spatial.reliability_smoother(vectors(spark, [*x, [0.4, 0.6]]), ref, 4).collect()}
    assert [got[i]["value"] for i in range(5)] == [1, 2, 3, 4, 2.5]
    assert 1 < got[5]["value"] < 4 and 0 < got[5]["confidence"] <= 1


def test_nearest_distance_without_reference_is_infinite(spark):
    p = vectors(spark, [[0, 0], [3, 4]])
    assert [r["d"] for r in spatial.nearest_distance(p, p.where("id < 0"), "u", "d").collect()] == [float("inf")] * 2
    assert {r["d"] for r in spatial.nearest_distance(p, p, "u", "d", other_than_self=True).collect()} == {5.0}


def test_quota_and_backfill(spark):
    rows = [(i, float(100 - i), i < 20) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, score double, edge boolean")
    got = ranking.quota_top(df, "score", F.col("edge"), 16, 0.25).orderBy("rn").collect()
    assert len(got) == 16 and sum(r["edge"] for r in got) == 4
    few = ranking.quota_top(df.where("id < 22"), "score", F.col("edge"), 16, 0.25).collect()
    assert len(few) == 16 and sum(not r["edge"] for r in few) == 2


def test_whole_positions_with_ties_and_a_kept_tail(spark):
    scores = [None if i % 17 == 0 else float("nan") if i % 19 == 0 else 5.0 if i % 3 == 0 else float(i % 7) - 3.0 for i in range(600)]
    df = spark.createDataFrame([(i * 7 % 600, s) for i, s in enumerate(scores)], "id long, score double")
    key = lambda r: (math.inf if r["score"] is None or math.isnan(r["score"]) else -r["score"], r["id"])
    want = [r["id"] for r in sorted(df.collect(), key=key)]
    got = ranking.whole_positions(df, "score", ranges=8).orderBy("rn").collect()
    assert [r["id"] for r in got] == want and [r["rn"] for r in got] == list(range(1, 601))
    assert ranking.whole_positions(df.where("id < 0"), "score").count() == 0
    prefix = spark.createDataFrame([(want[2], 1), (want[0], 2), (want[1], 3)], "id long, rn int")
    kept = [r["id"] for r in ranking.keep_tail(df, "score", prefix).orderBy("rn").collect()]
    assert kept == [want[2], want[0], want[1], *want[3:]]


def test_set_aware_orders_near_rows_by_their_terms(spark):
    rows = [(1, 10.0, 0.0, 7.0, 1), (2, 9.5, 1.0, 7.0, 2), (3, 9.0, 0.5, 7.0, 3), (4, 2.0, 9.0, 7.0, 4)]
    df = spark.createDataFrame(rows, "id long, score double, risk double, flat double, rn int")
    got = ranking.set_aware(df, "score", {"score": 0.1, "risk": 1.0, "flat": 5.0}, 0.8).orderBy("rn").collect()
    assert [r["id"] for r in got] == [2, 3, 1, 4] and ranking.set_aware(df.where("id < 0"), "score", {"risk": 1.0}, 0.8).count() == 0


def test_allocation_adds_up(spark):
    df = spark.createDataFrame([(1, 0.31, 1), (2, 0.31, 1), (3, 0.38, 0)], "id int, share double, least long")
    got = [r["count"] for r in ranking.largest_remainder(df, 10, "share", "least").orderBy("id").collect()]
    assert sum(got) == 10 and min(got) >= 1


def test_disjoint_splits(spark):
    p = vectors(spark, [[0.1, 0.2], [0.1, 0.2], [0.3, 0.4]], role=["b", "a", "b"])
    out = sets.disjoint_roles(p, "u").collect()
    assert sorted((r["role"], r["id"]) for r in out) == [("a", 1), ("b", 2)]
    drawn = sets.draw_disjoint(lambda n, i: generators.sobol(spark, n, 2, seed=i), 20, p, "u")
    assert drawn.count() == 20 and sets.overlap(drawn, p, "u").first()["shared"] == 0


def test_sobol_is_stratified(spark):
    u = np.array([r["u"] for r in generators.sobol(spark, 256, 5).collect()])
    for d in range(5):
        assert (np.bincount((u[:, d] * 256).astype(int), minlength=256) == 1).all()
    pairs = np.bincount((u[:, 0] * 16).astype(int) * 16 + (u[:, 1] * 16).astype(int), minlength=256)
    assert (pairs == 1).all()
    moved = np.array([r["u"] for r in generators.sobol(spark, 256, 5, seed=3).collect()])
    assert (np.bincount((moved[:, 4] * 256).astype(int), minlength=256) == 1).all()


def test_gp_and_leave_one_out_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x, y, q = rng.random((12, 2)), rng.random(12), rng.random((5, 2))
    k = lambda a, b: np.exp(-0.5 * (((a[:, None] - b[None]) / 0.4) ** 2).sum(axis=2))
    inverse = np.linalg.inv(k(x, x) + 1e-4 * np.eye(12))
    got = models.gp_predict(vectors(spark, x, y=y.tolist()), vectors(spark, q), [0.4, 0.4]).orderBy("id").toPandas()
    assert np.allclose(got["mean"], k(q, x) @ inverse @ (y - y.mean()) + y.mean(), atol=1e-6)
    assert np.allclose(got["std"], np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", k(q, x), inverse, k(q, x)), 0)), atol=1e-5)
    res = models.loo_residuals(vectors(spark, x, y=y.tolist(), design=[7] * 12), [0.4, 0.4]).orderBy("id").toPandas()["residual"]
    i = 3
    rest = np.arange(12) != i
    alone = np.linalg.inv(k(x[rest], x[rest]) + 1e-4 * np.eye(11))
    assert res[i] == pytest.approx(abs(y[i] - y.mean() - k(x[[i]], x[rest]) @ alone @ (y[rest] - y.mean()))[0], rel=1e-4)
    gain = models.variance_reduction(vectors(spark, x), vectors(spark, q), vectors(spark, q, w=[1.0] * 5), [0.4, 0.4]).toPandas()["gain"]
    assert np.isfinite(gain).all() and (gain >= 0).all()


def test_models_use_every_design_point_and_probe(spark, tmp_path):
    """Over 256 rows of labels 0 and 1 each: the queries are fits over all of them."""
    from orrery.plans import QUERIES, model_plans

    x = np.random.default_rng(6).random((640, 5))
    rows = [(i, [float(v) * 1.2 - 0.6 for v in x[i]], i % 2 if i < 600 else 2) for i in range(640)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    p = model_plans.points(spark, str(tmp_path)).withColumn("y", F.sin(3 * F.get("u", F.lit(0))) + F.get("u", F.lit(1)))
    design, probes, lengths = p.where("label = 0"), p.where("label = 1").withColumn("w", F.lit(1.0)), model_plans.LENGTHS
    got, want = QUERIES["gp_predict"](spark, str(tmp_path)), models.gp_predict(design, p, lengths)
    assert np.allclose(got.orderBy("id").toPandas(), want.orderBy("id").toPandas(), atol=1e-5)
    got, want = QUERIES["alc_variance_reduction"](spark, str(tmp_path)), models.variance_reduction(design, p.where("label > 1"), probes, lengths)
    assert np.allclose(got.orderBy("id").toPandas(), want.orderBy("id").toPandas(), atol=1e-5)


def test_factor_in_blocks_equals_numpy(monkeypatch):
    monkeypatch.setattr(models, "BLOCK", 4)
    x, q = np.random.default_rng(7).random((11, 3)), np.random.default_rng(8).random((5, 3))
    factor = models._Factor(x, np.array([0.4] * 3), 1.0, 1e-4)
    k = factor.kernel(x, x) + 1e-4 * np.eye(11)
    assert np.allclose(factor.at(q), np.linalg.solve(np.linalg.cholesky(k), factor.kernel(x, q)))
    assert np.allclose(factor.solve_back(factor.at(q)), np.linalg.solve(k, factor.kernel(x, q)))


def test_components_equal_svd(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(30, 4)) @ np.diag([3, 2, 1, 0.1])
    facts = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(30) for j in range(4)], "s int, k int, y double")
    got = models.principal_components(facts, "s", "k", "y", 2).orderBy("pc", "axis").toPandas()
    values, vectors_ = np.linalg.eigh(np.cov(m.T))
    assert np.allclose(sorted(got["explained"].unique(), reverse=True), values[::-1][:2])
    assert abs(got[got["pc"] == 0]["loading"].to_numpy() @ vectors_[:, -1]) == pytest.approx(1)


def test_greedy_choices_equal_numpy(spark):
    x = np.random.default_rng(4).random((40, 3))
    near, chosen = np.full(40, np.inf), [0]
    for _ in range(5):
        near = np.minimum(near, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(axis=1)))
        chosen.append(int(near.argmax()))
    assert [r["id"] for r in solvers.farthest_points(vectors(spark, x), 6).orderBy("rank").collect()] == chosen
    rn = vectors(spark, x).withColumn("rn", F.col("id") + 1)
    kept = []
    for i in range(40):
        if all(np.linalg.norm(x[i] - x[j]) > 0.3 for j in kept):
            kept.append(i)
    assert [r["id"] for r in solvers.greedy_dedup(rn, 5, 0.3).orderBy("rank").collect()] == kept[:5]
    with pytest.raises(ValueError):
        solvers.greedy_dedup(rn, 5, 9.0)


def test_greedy_dedup_goes_down_the_whole_table(spark, tmp_path):
    """More copies of the best vector than any fixed prefix holds; the other points come after them."""
    from orrery.plans import QUERIES

    rows = [(i, [0.0, 0.0, 0.6, 0.0, 0.0], 0) for i in range(300)] + [(300 + i, [0.0, 0.0, 0.45 - 0.15 * i, 0.0, 0.0], 0) for i in range(8)]
    spark.createDataFrame([*rows, (999, None, 0)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["greedy_dedup"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, *range(300, 307)]


def test_long_greedy_choices_and_probes_in_parts(spark):
    """More choices than are made between writes; probes summed in parts as in one."""
    x = np.random.default_rng(12).random((60, 3))
    near, chosen = np.full(60, np.inf), [0]
    for _ in range(19):
        near = np.minimum(near, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(axis=1)))
        chosen.append(int(near.argmax()))
    assert [r["id"] for r in solvers.farthest_points(vectors(spark, x), 20).orderBy("rank").collect()] == chosen
    score, near, taken = x[:, 2], np.ones(60), []
    for _ in range(20):
        total = np.where(np.isin(np.arange(60), taken), -np.inf, np.round(0.6 * score + 0.4 * near, 12))
        taken.append(int(total.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[taken[-1]], axis=1))
    got = solvers.diverse_batch(vectors(spark, x).withColumn("score", F.get("u", F.lit(2))), 20, 0.4, guard=-1.0)
    assert [r["id"] for r in got.orderBy("rank").collect()] == taken
    probes = vectors(spark, x[20:]).withColumn("w", F.col("id") + 1.0)
    gains = [{r["id"]: r["gain"] for r in models.variance_reduction(vectors(spark, x[:9]), vectors(spark, x), probes, [0.5] * 3, probes_at_once=n).collect()} for n in (1 << 16, 7)]
    assert len(gains[0]) == 60 and all(gains[1][i] == pytest.approx(g) for i, g in gains[0].items())


def test_relaxation_spreads_points(spark):
    x = np.random.default_rng(5).random((16, 2)) * 0.2
    for boundary in ("periodic", "reflective"):
        out = np.array([r["u"] for r in solvers.relax(vectors(spark, x, design=[1] * 16), boundary).collect()])
        gap = lambda p: np.sort(np.linalg.norm(p[:, None] - p[None], axis=2) + 9 * np.eye(16), axis=1)[:, 0].mean()
        assert gap(out) > 2 * gap(x) and ((out >= 0) & (out <= 1)).all()


def test_resume_stops_at_gap(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2)], "run string, n int")
    assert sorted((r["run"], r["n"]) for r in progress.resumable(df, "run", "n").collect()) == [("a", 1), ("a", 2)]


def test_text_checks(spark):
    df = spark.createDataFrame([(1, "# T\n\nA \\(x  +\ny\\tag{1}\\) b\n| a |\n> q\n汉字")], "doc_id int, text string")
    assert df.select(textops.display_math(F.col("text")).alias("m"), textops.han_count(F.col("text")).alias("h")).first() == (["\\(x + y\\)"], 2)
    assert [r["kind"] for r in textops.blocks(df).orderBy("block").collect()] == ["heading", "paragraph", "table", "blockquote", "paragraph"]


def test_shuffle_partitions_do_not_matter(spark):
    from orrery.plans import QUERIES

    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return QUERIES["metric_block_by_band"](spark, "/root/testdata/sf0.001").orderBy("band").collect()

    try:
        assert run(1) == run(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_quantiles_and_running_totals_of_large_groups(spark):
    """Groups beyond 2 * accuracy rows are bracketed by approximations; totals cross the ends of ranges."""
    import numpy as np

    from orrery.operators.quantiles import running_total

    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=60_000), "b": np.round(rng.normal(size=25_000), 1), "c": np.full(21_000, 3.0)}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), (None, 1.0), (None, 2.0)], "g string, x double")
    shares = [0.0, 0.001, 0.16, 0.5, 0.68, 0.95, 1.0]
    for broadcast in (True, False):
        got = {(r["g"], r["share"]): r["value"] for r in exact_quantiles(rows, ["g"], "x", shares, broadcast_groups=broadcast).collect()}
        assert len(got) == 4 * len(shares) and got[None, 0.5] == 1.5
        for g, vs in values.items():
            assert np.allclose([got[g, s] for s in shares], np.quantile(vs, shares))
    counts = rows.where("g = 'a' and x is not null").groupBy("x").count()
    total = running_total(counts, "x", "count", "upto").toPandas().sort_values("x")
    assert (total["upto"].to_numpy() == total["count"].cumsum().to_numpy()).all()
    assert running_total(counts.where("x > 99"), "x", "count", "upto").count() == 0


def test_emulator_fits_and_predicts(spark):
    """The gradient against differences; smooth spectra at points that the design doesn't hold; the numpy way back."""
    import numpy as np

    from orrery.operators import emulator

    rng = np.random.default_rng(6)
    x, logs = rng.random((25, 2)), np.log([0.4, 0.8, 1.3, 1e-2])
    y = np.sin(4 * x[:, 0]) + 0.3 * x[:, 1]
    value, gradient = emulator.likelihood(x, y, logs)
    for i in range(4):
        step = np.zeros(4)
        step[i] = 1e-5
        assert abs((emulator.likelihood(x, y, logs + step)[0] - emulator.likelihood(x, y, logs - step)[0]) / 2e-5 - gradient[i]) < 1e-3 * max(1, abs(gradient[i]))
    found = emulator.fit(x, (y - y.mean()) / y.std())
    assert emulator.likelihood(x, (y - y.mean()) / y.std(), found)[0] > emulator.likelihood(x, (y - y.mean()) / y.std(), logs)[0]
    assert np.exp(found[1]) > np.exp(found[0])  # the smoother dimension gets the longer scale

    k = np.linspace(0, 1, 7)
    u = rng.random((60, 2))
    truth = np.sin(3 * u[:, [0]] + k) + u[:, [1]] * k**2
    facts = spark.createDataFrame([(i, float(kk), float(v)) for i in range(60) for kk, v in zip(k, truth[i], strict=True)], "sample long, k double, y double")
    points = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(u)], "sample long, u array<double>")
    out = emulator.emulate(facts, points.where("sample < 40"), points.withColumnRenamed("sample", "id"), "sample", "k", "y", 4).toPandas()
    assert len(out) == 60 * 7
    error = np.abs(out["value"].to_numpy() / np.exp(truth[out["id"], np.round(out["axis"] * 6).astype(int)]) - 1)
    assert np.quantile(error[out["id"] >= 40], 0.68) < 0.02 and np.quantile(error[out["id"] < 40], 0.95) < 0.02
    with __import__("pytest").raises(ValueError):
        emulator.fit_components(spark.range(emulator.MOST_FIT + 1).selectExpr("id as sample", "array(0.5D) as u"), facts, "sample")
