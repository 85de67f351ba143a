"""Triangulations, fans, circumcentres and climbs: against their definitions, in several dimensions."""

from itertools import product

import numpy as np
import pytest

from orrery.operators import ascent, geometry, hulls

VECTORS = "design long, id long, u array<double>"


def frame(spark, designs):
    return spark.createDataFrame([(d, 10 * i + d, [float(x) for x in u]) for d, points in designs.items() for i, u in enumerate(points)], VECTORS)


@pytest.mark.parametrize("dim", [2, 3, 4, 5])
def test_simplices_are_delaunay_and_cover_the_hull_once(dim):
    rng = np.random.default_rng(dim)
    for n in (dim + 1, dim + 2, 30):
        x = rng.random((n, dim))
        cells, facets = hulls.delaunay(x)
        v = x[cells]
        edges = v[:, 1:] - v[:, :1]
        centre = v[:, 0] + np.linalg.solve(2 * edges, (edges**2).sum(axis=2)[:, :, None])[:, :, 0]
        radius = np.linalg.norm(centre - v[:, 0], axis=1)
        assert (np.linalg.norm(x[None] - centre[:, None], axis=2) >= radius[:, None] * (1 - 1e-6)).all()
        inside = x.mean(axis=0) + 0.3 * (rng.dirichlet(np.ones(n), 200) @ x - x.mean(axis=0))
        assert (hulls.holds(v, inside).sum(axis=0) == 1).all()
        # Cones from an inner point over the hull's facets fill what the simplices fill.
        cones = np.concatenate([np.broadcast_to(x.mean(axis=0), (len(facets), 1, dim)), x[facets]], axis=1)
        assert hulls.volumes(cones).sum() == pytest.approx(hulls.volumes(v).sum())


def test_points_on_common_spheres_and_flat_or_repeated_points(spark):
    for dim in (2, 3, 4):
        grid = np.array(list(product([0.0, 0.5, 1.0][: 3 if dim < 4 else 2], repeat=dim)))
        cells = hulls.delaunay(grid)[0]
        assert hulls.volumes(grid[cells]).sum() == pytest.approx(np.ptp(grid, axis=0).prod())
    x = np.random.default_rng(0).random((9, 3))
    twice, once = hulls.delaunay(np.concatenate([x, x]))[0], hulls.delaunay(x)[0]
    assert sorted(map(sorted, twice.tolist())) == sorted(map(sorted, once.tolist()))
    assert len(hulls.delaunay(x[:3])[0]) == 0
    assert len(hulls.delaunay(np.column_stack([x[:, :2], np.zeros(9)]))[0]) == 0
    rows = hulls.triangulated(frame(spark, {1: x, 2: x[:2], 3: np.concatenate([x, x])})).groupBy("design").count().collect()
    assert {r["design"]: r["count"] for r in rows} == {1: len(once), 3: len(once)}
    assert hulls.triangulated(frame(spark, {1: x}).where("id < 0")).count() == 0


def test_located_points_equal_numpy(spark):
    rng = np.random.default_rng(4)
    designs = {d: rng.random((12, 3)) for d in range(4)}
    refs = rng.random((300, 3))
    got = geometry.geometry_batch(frame(spark, designs), spark.createDataFrame([(i, [float(a) for a in u]) for i, u in enumerate(refs)], "id long, u array<double>")).collect()
    expected = {(d, int(r)) for d, x in designs.items() for r in np.flatnonzero(hulls.holds(x[hulls.delaunay(x)[0]], refs).any(axis=0))}
    assert {(r["design"], r["ref_id"]) for r in got} == expected and len(got) == len(expected)
    for r in got[:40]:
        x = designs[r["design"]]
        v = x[hulls.delaunay(x)[0]]
        bary = hulls.barycentric(v, refs[[r["ref_id"]]])[:, 0]
        own = v[(bary >= -1e-9).all(axis=1).argmax()]
        assert r["condition"] == pytest.approx(np.linalg.cond(own[1:] - own[0])) and r["boundary"] == pytest.approx(np.minimum(refs[r["ref_id"]], 1 - refs[r["ref_id"]]).min())


def test_fans_join_outer_points_with_independent_neighbours(spark):
    x = np.random.default_rng(5).random((15, 3)) * 0.6 + 0.2
    support = hulls.structured_support(3)
    assert len(support) == 6 + 12 + 8
    rows = hulls.fans(frame(spark, {0: x}), support, fanout=3).collect()
    cells = x[hulls.delaunay(x)[0]]
    outside = {int(i) for i in np.flatnonzero(~hulls.holds(cells, support).any(axis=0))}
    assert {r["support"] for r in rows} == outside
    seen = {(r["support"], tuple(sorted(r["ids"]))) for r in rows}
    assert len(seen) == len(rows) == 3 * len(outside)
    for r in rows:
        v = np.array(r["vertices"])
        assert np.allclose(v[0], support[r["support"]]) and abs(np.linalg.det(v[1:] - v[0])) > 1e-12
    first = [r for r in rows if r["fan"] == 0][0]
    near = np.argsort(np.linalg.norm(x - support[first["support"]], axis=1))
    assert first["ids"][0] == 10 * near[0]


def test_circumcentres(spark):
    x = np.random.default_rng(6).random((40, 4, 3))
    x[0, 3] = x[0, 0] + x[0, 1] - x[0, 2]  # flat
    rows = hulls.circumcentres(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "simplex long, vertices array<array<double>>")).collect()
    assert len(rows) == 40 and any(r["weights"] for r in rows) and next(r for r in rows if r["simplex"] == 0)["weights"] is None
    for r in rows:
        v = x[r["simplex"]]
        if r["weights"]:
            away = np.linalg.norm(v - np.array(r["weights"]) @ v, axis=1)
            assert np.ptp(away) < 1e-9 and min(r["weights"]) >= 0
        elif r["simplex"]:
            e = v[1:] - v[0]
            centre = v[0] + np.linalg.solve(2 * e, (e**2).sum(axis=1))
            assert hulls.barycentric(v[None], centre[None]).min() < 0


def test_gradient_of_the_variance():
    rng = np.random.default_rng(7)
    f = ascent.PosteriorVariance(rng.random((30, 3)), np.array([0.3, 0.5, 0.9]))
    p = rng.random((6, 3))
    value, slope = f(p)
    assert (value > 0).all()
    for i in range(3):
        step = np.zeros(3)
        step[i] = 1e-6
        assert np.allclose((f(p + step)[0] - f(p - step)[0]) / 2e-6, slope[:, i], atol=1e-5)


@pytest.mark.parametrize("dim", [2, 3, 5])
def test_climbs_never_fall_and_reach_a_dense_lattice(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.random((25, dim))
    cells = np.concatenate([x[hulls.delaunay(x)[0]][:20], rng.random((10, dim + 1, dim))])
    design = spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(x)], "id long, u array<double>")
    rows = ascent.best_points(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cells)], "simplex long, vertices array<array<double>>"), design, [0.4] * dim).collect()
    f = ascent.PosteriorVariance(x, np.full(dim, 0.4))
    dense = rng.dirichlet(np.full(dim + 1, 0.7), 20_000)
    for r in rows:
        assert r["value"] >= r["start"] - 1e-12
        assert min(r["weights"]) >= 0 and sum(r["weights"]) == pytest.approx(1)
        assert np.allclose(np.array(r["weights"]) @ cells[r["simplex"]], r["u"]) and f(np.array([r["u"]]))[0][0] == pytest.approx(r["value"], abs=1e-9)
        assert r["value"] >= f(dense @ cells[r["simplex"]])[0].max() - 1e-3


def test_projection_onto_the_simplex():
    w = np.random.default_rng(8).normal(size=(50, 4))
    p = ascent.onto_simplex(w)
    assert (p >= 0).all() and np.allclose(p.sum(axis=1), 1)
    for other in np.random.default_rng(9).dirichlet(np.ones(4), 200):
        assert (np.linalg.norm(w - p, axis=1) <= np.linalg.norm(w - other, axis=1) + 1e-9).all()


@pytest.mark.parametrize("scale", [1.0, 1e-6])
def test_small_functions_are_climbed_as_fast_as_large_ones(scale):
    rng = np.random.default_rng(10)
    v, seen = rng.random((40, 4, 3)), []
    inner = np.einsum("sw,swd->sd", rng.dirichlet(np.ones(4), 40), v)
    bend = np.array([1.0, 3.0, 0.5])
    begin = ascent.starts(4)
    tops = np.repeat(inner, len(begin), axis=0)
    for lo in range(0, len(tops), len(begin)):  # one function for each simplex

        def hill(p, top=tops[lo]):
            seen.append(len(p))
            return scale * (1 - ((p - top) ** 2 * bend).sum(axis=1)), -2 * scale * bend * (p - top)

        w, value = ascent.climb(np.repeat(v[lo // len(begin)][None], len(begin), axis=0), begin, hill)
        assert np.abs(w @ v[lo // len(begin)] - tops[lo]).max() < 1e-3 and value.min() > scale * (1 - 1e-6)
    assert sum(seen) < 25 * len(tops)


def test_a_top_beside_a_start_is_not_passed_over():
    # Along an edge: a narrow top at 0.09 above all else, beside a start at 0.2 and an end at 0, and a slope up to the other end.
    def edge(p):
        x, hump = p[:, 0], np.exp(-(((p[:, 0] - 0.09) / 0.1) ** 2))
        return 0.8 * x**4 + hump, (3.2 * x**3 - hump * 2 * (x - 0.09) / 0.1**2)[:, None]

    w, value = ascent.climb(np.array([[[0.0], [1.0]]] * 2), np.array([[0.8, 0.2], [1.0, 0.0]]), edge)
    assert np.allclose(w[:, 1], 0.09, atol=1e-3) and value.min() > 0.999
