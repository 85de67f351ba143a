"""Joins through cells, one-to-one matches, hexagons, discrepancy and whole-table re-rankings, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import cells, discrepancy, ranking, spatial

POINT = "id long, u array<double>"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in u]) for i, u in enumerate(x)], POINT)


@pytest.mark.parametrize("dim", [1, 2, 5])
def test_nearest_through_cells_equals_numpy(spark, dim):
    rng = np.random.default_rng(dim)
    q, r = rng.normal(size=(60, dim)), np.concatenate([rng.normal(size=(50, dim)), np.tile(rng.normal(size=(1, dim)), (30, 1)), np.full((1, dim), 40.0)])
    q[0] = r[0]
    d = np.linalg.norm(q[:, None] - r[None], axis=2)
    got = spatial.nearest_distance(frame(spark, q), frame(spark, r, 1000), "u", "near", most=0).orderBy("id").collect()
    assert np.allclose([x["near"] for x in got], d.min(axis=1))
    own = np.linalg.norm(r[:, None] - r[None], axis=2) + np.where(np.eye(len(r)), np.inf, 0)
    got = spatial.nearest_distance(frame(spark, r), frame(spark, r), "u", "near", other_than_self=True, most=0).orderBy("id").collect()
    assert np.allclose([x["near"] for x in got], own.min(axis=1))
    far = {x["id"] for x in spatial.farther_than(frame(spark, q), frame(spark, r), 0.5, most=0).collect()}
    assert far == {x["id"] for x in spatial.farther_than(frame(spark, q), frame(spark, r), 0.5).collect()} == {int(i) for i in np.flatnonzero(d.min(axis=1) > 0.5)}
    assert spatial.nearest_distance(frame(spark, q), frame(spark, r).where("id < 0"), "u", "near").where("near < 1e300").count() == 0


def test_tolerance_through_cells_equals_blocks(spark):
    rng = np.random.default_rng(1)
    r = rng.integers(-4, 5, size=(300, 4)) * 0.25
    q = r[:80] + rng.choice([0.0, 0.25, -0.25, 1e-9], size=(80, 4))
    for atol, rtol in ((0.25, 0.0), (1e-8, 0.0), (0.1, 0.2)):
        both = [{x["id"]: x["match_id"] for x in spatial.within_tolerance(frame(spark, q), frame(spark, r), atol, rtol, most=most).collect()} for most in (0, 10_000)]
        assert both[0] == both[1] and len(both[0]) == 80


def test_each_row_is_matched_once(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random((70, 3)), rng.random((80, 3))
    a[:10] = b[:10]
    a[10:14] = a[14]  # equal rows on one side
    got = [(r["left_id"], r["right_id"]) for r in cells.one_to_one(frame(spark, a), frame(spark, b), 0.2).collect()]
    d = np.abs(a[:, None] - b[None]).max(axis=2)
    expected, left, right = [], set(range(70)), set(range(80))
    for x, i, j in sorted((d[i, j], i, j) for i in range(70) for j in range(80) if d[i, j] <= 0.2):
        if i in left and j in right:
            expected.append((i, j))
            left.discard(i)
            right.discard(j)
    assert sorted(got) == sorted(expected) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    exact = spatial.match_rows(frame(spark, a), frame(spark, b), 12)
    assert exact.count() == 10
    assert cells.match_rows(frame(spark, a), frame(spark, b), exact, 1e-6).count() == 10
    assert cells.one_to_one(frame(spark, a).where("id < 0"), frame(spark, b), 0.2).count() == 0


def test_hexagons_hold_their_points(spark):
    rng = np.random.default_rng(3)
    xy = rng.normal(size=(400, 2)) * 4
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double").select("id", cells.hexagon(F.col("x"), F.col("y"), 0.7).alias("h")).collect()
    centre = lambda q, r: np.stack([0.7 * 3**0.5 * (q + r / 2), 0.7 * 1.5 * r], axis=-1)
    q, r = np.meshgrid(np.arange(-40, 41), np.arange(-40, 41))
    every = centre(q.ravel(), r.ravel())
    for row in rows:
        own = np.linalg.norm(xy[row["id"]] - centre(row["h"]["q"], row["h"]["r"]))
        assert own <= np.linalg.norm(every - xy[row["id"]], axis=1).min() + 1e-9


def centred(x):
    c = np.abs(x - 0.5)
    one = (1 + 0.5 * c - 0.5 * c * c).prod(axis=1).sum()
    two = (1 + 0.5 * c[:, None] + 0.5 * c[None] - 0.5 * np.abs(x[:, None] - x[None])).prod(axis=2).sum()
    return (13 / 12) ** x.shape[1] - 2 / len(x) * one + two / len(x) ** 2


def test_gain_equals_the_difference_of_two_discrepancies(spark, monkeypatch):
    rng = np.random.default_rng(4)
    design, more = rng.random((20, 4)), rng.random((15, 4))
    assert discrepancy.discrepancy(frame(spark, design)).first()[0] == pytest.approx(centred(design) ** 0.5)
    for block in (4096, 3):
        monkeypatch.setattr(discrepancy, "blocks", lambda df, fields, block=block: spatial.blocks(df, fields, block))
        got = {r["id"]: r["gain"] for r in discrepancy.gains(frame(spark, more).withColumn("k", F.lit("clash")), frame(spark, design)).collect()}
        for i, p in enumerate(more):
            assert got[i] == pytest.approx(centred(design) - centred(np.vstack([design, p])), abs=1e-12)
    assert {r["gain"] for r in discrepancy.gains(frame(spark, more), frame(spark, design).where("id < 0")).collect()} == {0.0}


def test_rankings_look_at_the_whole_table(spark):
    """Rows near the best are found wherever they stand; copies of the best score don't push them out."""
    n = 400
    rows = [(i, 1.0 - (i >= 300) * 0.05 - (i >= 350) * 0.5, float(i % 7), float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, score double, gain double, risk double")
    near = [r for r in rows if r[1] >= 0.9]
    rest = [r for r in rows if r[1] < 0.9]
    order = lambda rs, key: [r[0] for r in sorted(rs, key=key)]
    ids = lambda out: [r["id"] for r in out.orderBy("rn").collect()]
    tail = order(rest, lambda r: (-r[1], r[0]))
    assert ids(ranking.whole_tiebreak(df, "score", "gain", 0.9)) == order(near, lambda r: (-r[2], r[0])) + tail
    total = lambda r: round(0.5 * (r[1] - 0.95) / 0.05 + 0.5 * r[3] / 349, 9)
    assert ids(ranking.whole_set_aware(df, "score", {"score": 0.5, "risk": 0.5}, 0.9)) == order(near, lambda r: (-total(r), r[0])) + tail
    level = np.quantile([r[2] for r in rows], 0.5)
    assert ids(ranking.whole_guard(df, "score", "gain", 0.5)) == order(rows, lambda r: (r[2] < level, -r[1], r[0]))
    assert ids(ranking.whole_rescored(df, "score", "gain", 0.1)) == order(rows[:40], lambda r: (-r[2], r[0])) + [r[0] for r in rows[40:]]
    out = ranking.whole_blend(df, {"score": 0.5, "gain": 0.5}).orderBy("rn").collect()
    assert [r["rn"] for r in out] == list(range(1, n + 1)) and out[0]["id"] == 6
    assert ranking.whole_tiebreak(df.where("id < 0"), "score", "gain", 0.9).count() == 0
