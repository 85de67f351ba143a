"""Steps that held too much or were refused on larger tables."""

import numpy as np
from pyspark.sql import functions as F

from orrery.operators import ascent, cells, generators, hulls, models
from orrery.plans import QUERIES

DATA = "/root/testdata/sf0.001"


def test_a_large_design_is_fitted_through_its_spanning_points(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x, q = rng.random((700, 2)), rng.random((60, 2)) * 1.4 - 0.2
    frame = lambda rows: spark.createDataFrame([(i, u.tolist(), float(np.sin(3 * u[0]) + u[1]), 1.0 + i) for i, u in enumerate(rows)], "id long, u array<double>, y double, w double")
    exact = models.gp_predict(frame(x), frame(q), [0.5] * 2).orderBy("id").toPandas()
    gain = models.variance_reduction(frame(x).drop("w"), frame(q), frame(q[:40]), [0.5] * 2).orderBy("id").toPandas()
    monkeypatch.setattr(models, "FACTORED", 100, raising=False)
    monkeypatch.setattr(models, "ROUND", 50, raising=False)
    monkeypatch.setattr(models, "MOST_POINTS", 400)
    assert np.allclose(models.gp_predict(frame(x), frame(q), [0.5] * 2).orderBy("id").toPandas(), exact, atol=1e-6)
    assert np.allclose(models.variance_reduction(frame(x).drop("w"), frame(q), frame(q[:40]), [0.5] * 2).orderBy("id").toPandas(), gain, atol=1e-6)


def test_no_percentile_buffer_in_blocks(spark):
    for name in ("metric_block_grouping_sets", "focus_band_metrics"):
        assert "percentile(" not in QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString(), name


def test_simplices_are_dealt_before_they_are_climbed(spark, monkeypatch):
    monkeypatch.setattr(ascent, "ROWS", 4, raising=False)
    rng = np.random.default_rng(1)
    rows = [(i, rng.random((3, 2)).tolist()) for i in range(12)]
    design = spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(rng.random((9, 2)))], "id long, u array<double>")
    best = ascent.best_points(spark.createDataFrame(rows, "simplex long, vertices array<array<double>>").coalesce(1), design, [0.5] * 2)
    assert best.rdd.getNumPartitions() == 3 and best.count() == 12


def test_expected_simplices_are_not_counted(spark, monkeypatch):
    monkeypatch.setattr(ascent, "ROWS", 4, raising=False)
    rng, asked = np.random.default_rng(1), spark.sparkContext.accumulator(0)

    def made(batches):
        for rows in batches:
            asked.add(len(rows))
            yield rows

    rows = [(i, rng.random((3, 2)).tolist()) for i in range(12)]
    shape = "simplex long, vertices array<array<double>>"
    design = spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(rng.random((9, 2)))], "id long, u array<double>")
    best = ascent.best_points(spark.createDataFrame(rows, shape).mapInPandas(made, shape), design, [0.5] * 2, expected=9)
    assert len(best.collect()) == 12 and asked.value == 12 and best.rdd.getNumPartitions() == 3


def test_small_designs_are_dealt_by_their_points(spark, monkeypatch):
    monkeypatch.setattr(hulls, "ROWS", 30, raising=False)
    x = np.random.default_rng(3).random((90, 2))
    designs = spark.createDataFrame([(i // 9, i, u.tolist()) for i, u in enumerate(x)], "design long, id long, u array<double>").coalesce(1)
    for found in (hulls.triangulated(designs), hulls.hull_facets(designs), hulls.fans(designs, hulls.structured_support(2))):
        assert found.rdd.getNumPartitions() == 3 and found.select("design").distinct().count() == 10


def test_crowded_cells_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(cells, "GROUP", 3, raising=False)
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(60, 2)) * 0.1, rng.normal(size=(50, 2)) * 0.1
    frame = lambda x: spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(x)], "id long, u array<double>")
    pairs = cells.tolerance_pairs(frame(a), frame(b), 0.1)
    d = np.abs(a[:, None] - b[None]).max(axis=2)
    assert sorted((r["left_id"], r["right_id"]) for r in pairs.collect()) == [(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 0.1), strict=True)]
    assert "explode(refs" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_a_hypercube_is_not_gathered_again(spark, monkeypatch):
    monkeypatch.setattr(generators, "CHUNK", 7, raising=False)
    out = generators.latin_hypercube_for(spark.createDataFrame([("a", 30), ("b", 0), ("c", 7)], "b string, n long"), "b", "n", 2, seed=7)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.select("b", "n", "id", F.posexplode("u").alias("dim", "x")).collect()
    assert {(r["b"], r["dim"], int(r["x"] * r["n"])) for r in rows} == {(b, d, i) for b, n in (("a", 30), ("c", 7)) for d in (0, 1) for i in range(n)}
    assert len({(r["b"], r["id"]) for r in rows}) == 37
