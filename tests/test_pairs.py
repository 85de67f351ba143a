"""Sums and neighbours over all pairs of larger tables: against numpy, and in a time that expressions row by row did not keep."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.operators import discrepancy, spatial

N, M = 20_000, 4_000


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    q, r = rng.random((N, 5)), rng.random((M, 5))
    r[:3] = q[:3]
    make = lambda x: spark.createDataFrame([(i, u.tolist(), float(u[0]), 1 + i % 30) for i, u in enumerate(x)], "id long, u array<double>, value double, n long").localCheckpoint()
    return q, r, make(q), make(r)


def within(seconds, df):
    begun = time.time()
    rows = {r["id"]: r for r in df.collect()}
    assert time.time() - begun < seconds
    return rows


def test_gains_over_all_pairs(cloud):
    q, r, queries, reference = cloud
    got = within(60, discrepancy.gains(queries, reference))
    pair = lambda x: (1 + 0.5 * np.abs(x - 0.5) + 0.5 * np.abs(r - 0.5) - 0.5 * np.abs(x - r)).prod(axis=1).sum()
    own = lambda x: (1 + 0.5 * np.abs(x - 0.5) - 0.5 * np.abs(x - 0.5) ** 2).prod(axis=-1)
    s1, s2 = own(r).sum(), sum(pair(x) for x in r)
    assert len(got) == N
    for i in range(0, N, 997):
        after = -2 / (M + 1) * (s1 + own(q[i])) + (s2 + 2 * pair(q[i]) + (1 + np.abs(q[i] - 0.5)).prod()) / (M + 1) ** 2
        assert got[i]["gain"] == pytest.approx(-2 / M * s1 + s2 / M**2 - after, abs=1e-11)


def test_kernel_means_forces_and_neighbours_over_all_pairs(cloud, monkeypatch):
    q, r, queries, reference = cloud
    for wide in (1 << 16, 1000):
        monkeypatch.setattr(spatial, "WIDE", wide)
        mean, near = within(60, spatial.kernel_mean(queries, reference, "value", 0.2, "m")), within(60, spatial.nearest_distance(queries, reference, "u", "d"))
        k = within(60, spatial.nearest_k(queries, reference, 4, ["value"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "ref_id", "ref_value"))).alias("k")))
        force = within(60, spatial.repulsion(reference, 1.0, 0.2, 0.05).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dim", "force"))).alias("f")))
        assert len(mean) == len(near) == len(k) == N and len(force) == M
        for i in (0, 1, 777, 19_999):
            d = np.sqrt(((q[i] - r) ** 2).sum(axis=1))
            w, order = np.exp(-(d**2) / 0.08), np.argsort(d, kind="stable")[:4]
            assert mean[i]["m"] == pytest.approx(w @ r[:, 0] / w.sum()) and near[i]["d"] == pytest.approx(d.min())
            assert [x["ref_id"] for x in k[i]["k"]] == order.tolist() and [x["ref_value"] for x in k[i]["k"]] == r[order, 0].tolist()
        for i in (0, 3999):
            d = ((r[i] - r) ** 2).sum(axis=1)
            assert np.allclose([x["force"] for x in force[i]["f"]], (np.exp(-d / 0.08) / (d + 0.0025)) @ (r[i] - r))


def test_neighbours_among_copies_go_to_smaller_ids(spark):
    rows = [(i, [0.5, 0.5]) for i in range(40)] + [(i, [0.25 * (i % 3), 1.0]) for i in range(40, 50)]
    points = spark.createDataFrame(rows, "id long, u array<double>")
    got = spatial.nearest_k(points, points, 3, []).where("id < 40").groupBy("id").agg(F.array_sort(F.collect_list("ref_id")).alias("k")).collect()
    assert len(got) == 40 and {tuple(x["k"]) for x in got} == {(0, 1, 2)}


def test_neighbours_hold_no_more_than_they_return(spark, monkeypatch):
    met = []
    monkeypatch.setattr(spatial, "against", lambda queries, held, work, schema: met.append(work) or spark.createDataFrame([], schema))
    points = spark.createDataFrame([(i, [0.1 * i, 0.5]) for i in range(3)], "id long, u array<double>")
    spatial.nearest_k(points, points, 4, [])
    rng = np.random.default_rng(1)
    column = lambda u: pa.array(u.tolist(), pa.list_(pa.float64()))
    q, r = rng.random((1500, 2)), rng.random((spatial.PAIRS // 4, 2))
    rows, refs = pa.table({"id": np.arange(len(q)), "u": column(q)}), pa.StructArray.from_arrays([pa.array(np.arange(len(r))), column(r)], ["id", "u"])
    tracemalloc.start()
    found = met[0](rows, refs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 4 * len(q) and most < 20e6  # 200 MB with every row's places of all references
    d = np.sqrt(((q[7] - r) ** 2).sum(axis=1))
    assert sorted(found["ref_id"].to_pylist()[28:32]) == sorted(np.argsort(d)[:4].tolist())
