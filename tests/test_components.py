"""Covariance states, layouts by band and rebuilt curves, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import components as c


def facts(spark, m, first=0):
    return spark.createDataFrame([(first + i, float(j), float(x)) for i, row in enumerate(m) for j, x in enumerate(row)], "s long, k double, y double").repartition(5)


def state_arrays(state):
    r = state.first()
    return r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(len(r["axis"]), -1)


def test_state_equals_numpy_and_grows_without_its_rows(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(90, 6)) @ rng.normal(size=(6, 6)) + 1000.0
    state = c.state_of(facts(spark, m[:30]), "s", "k", "y")
    for lo, hi in ((30, 31), (31, 60), (60, 90)):
        row = state.collect()
        state = c.appended(spark.createDataFrame(row, c.STATE), facts(spark, m[lo:hi], lo), "s", "k", "y")
        n, mean, scatter = state_arrays(state)
        assert n == hi and np.allclose(mean, m[:hi].mean(axis=0), rtol=1e-12)
        assert np.allclose(scatter / (hi - 1), np.cov(m[:hi].T), rtol=1e-9, atol=1e-9)


def test_odd_samples_do_not_count(spark):
    m = np.random.default_rng(1).normal(size=(12, 3))
    rows = [(i, float(j), float(x)) for i, r in enumerate(m) for j, x in enumerate(r)]
    odd = [(50, 0.0, 1.0), (51, 0.0, None), (51, 1.0, 2.0), (51, 2.0, 2.0), (52, 0.0, float("nan")), (52, 1.0, 0.0), (52, 2.0, 0.0), (0, 0.0, float(m[0, 0]))]
    n, mean, scatter = state_arrays(c.state_of(spark.createDataFrame(rows + odd, "s long, k double, y double"), "s", "k", "y"))
    assert n == 12 and np.allclose(mean, m.mean(axis=0)) and np.allclose(scatter, np.cov(m.T) * 11)
    none = c.state_of(spark.createDataFrame([], "s long, k double, y double"), "s", "k", "y")
    assert none.count() == 0 and c.layout(none, None, 2, 0).count() == 0


def test_layouts_equal_deflation_and_rebuild_exactly(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(40, 7)) @ rng.normal(size=(7, 7))
    f = facts(spark, m)
    state = c.state_of(f, "s", "k", "y")
    bands = spark.createDataFrame([(float(j), "low" if j < 3 else "high") for j in range(7)], "axis double, band string")
    cov = np.cov(m.T)
    values, vectors = np.linalg.eigh(cov)
    v = vectors[:, ::-1][:, :2].T
    left = (np.eye(7) - v.T @ v) @ cov @ (np.eye(7) - v.T @ v)
    got = c.layout(state, bands, 2, 2).toPandas()
    assert np.allclose(sorted(got[got["band"] == "all"]["explained"].unique())[::-1], values[::-1][:2])
    for name, at in (("low", slice(0, 3)), ("high", slice(3, 7))):
        own = got[got["band"] == name]
        assert np.allclose(sorted(own["explained"].unique())[::-1], np.linalg.eigvalsh(left[at, at])[::-1][:2], atol=1e-9)
        assert set(own["axis"]) == set(np.arange(7.0)[at])
    samples = c.curves(f, "s", "k", "y")
    for everywhere, each in ((7, 0), (2, 4), (0, 4)):
        loadings = c.layout(state, bands, everywhere, each)
        out = c.rebuilt(c.coordinates(samples, state, loadings), state, loadings).toPandas()
        assert len(out) == 280 and np.allclose(out.sort_values(["sample", "axis"])["value"].to_numpy().reshape(40, 7), m)
    few = c.layout(state, bands, 1, 1)
    out = c.rebuilt(c.coordinates(samples, state, few), state, few).toPandas().sort_values(["sample", "axis"])["value"].to_numpy().reshape(40, 7)
    one = c.layout(state, bands, 1, 0)
    less = c.rebuilt(c.coordinates(samples, state, one), state, one).toPandas().sort_values(["sample", "axis"])["value"].to_numpy().reshape(40, 7)
    assert 0 < np.square(out - m).sum() < np.square(less - m).sum()


def test_scores_of_loadings_keep_their_samples(spark):
    m = np.random.default_rng(3).normal(size=(9, 4))
    f = facts(spark, m).withColumn("extra", F.lit(1)).withColumn("axis", F.lit("clash"))
    state = c.state_of(f, "s", "k", "y")
    out = c.coordinates(c.curves(f, "s", "k", "y"), state, c.layout(state, None, 4, 0)).toPandas()
    assert len(out) == 36 and out.groupby("sample")["score"].apply(lambda s: (s**2).sum()).to_numpy() == pytest.approx(((m - m.mean(axis=0)) ** 2).sum(axis=1))
