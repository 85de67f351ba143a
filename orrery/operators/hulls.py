"""Triangulations of designs in any dimension, hull fans and circumcentres: one design a task, simplices as rows.

The Delaunay simplices of points are the lower facets of the convex hull of the points lifted onto a paraboloid. The hull grows
point by point: facets that see the new point go, and each ridge between one that sees it and one that doesn't makes a
new facet with it. All facets are tested at once, and all new planes solved at once. Points are moved by a tiny random
amount first (points of a grid lie on common spheres), more if the result doesn't fill the hull; vertices are reported unmoved.

Defined results: a design of fewer than d + 2 distinct points, or flat, has no simplices, or one of d + 1 points; of equal
points one is used; null or unequal-length coordinates raise. Memory is that of one design's hull.
"""

from __future__ import annotations

from itertools import combinations, product
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First size of the random move, as a share of the extent, and how often it may grow tenfold.
JOGGLE, TRIES = 1e-10, 6
VOLUME_TOLERANCE = 1e-6
#: Simplices of no more volume are flat but for the random move, and left out.
FLAT = 1e-15
#: Points of the designs of one task, about: few bytes, and some milliseconds each.
ROWS = 4096


def volumes(cells: np.ndarray) -> np.ndarray:
    """Volumes of simplices [m, d + 1, d]."""
    return np.abs(np.linalg.det(cells[:, 1:] - cells[:, :1])) / factorial(cells.shape[2])


def _first_simplex(points: np.ndarray) -> list[int] | None:
    """dim + 1 points that span the space, each the farthest from what the ones before span."""
    chosen = [int(np.argmin(points[:, 0]))]
    rest = points - points[chosen[0]]
    for _ in range(points.shape[1]):
        size = np.linalg.norm(rest, axis=1)
        far = int(np.argmax(size))
        if size[far] < 1e-13:
            return None
        chosen.append(far)
        axis = rest[far] / size[far]
        rest = rest - np.outer(rest @ axis, axis)
    return chosen


def _planes(points: np.ndarray, facets: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals that point away from an inner point, and offsets."""
    corner = points[facets[:, 0]]
    rows = np.concatenate([points[facets[:, 1:]] - corner[:, None], (inner - corner)[:, None]], axis=1)
    right = np.zeros((len(facets), points.shape[1], 1))
    right[:, -1] = -1.0
    normal = np.linalg.solve(rows, right)[:, :, 0]
    normal /= np.linalg.norm(normal, axis=1, keepdims=True)
    return normal, np.einsum("ij,ij->i", normal, corner)


def _ridges(facets: np.ndarray) -> np.ndarray:
    """All facets' ridges, sorted within, facet after facet."""
    d = facets.shape[1]
    keep = np.array([[j for j in range(d) if j != i] for i in range(d)])
    return np.sort(facets[:, keep].reshape(-1, d - 1), axis=1)


def convex_hull(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Facets (indices of points) of the hull and their outward normals; raises LinAlgError where points are flat."""
    start = _first_simplex(points)
    if start is None:
        raise np.linalg.LinAlgError("the points are flat")
    inner = points[start].mean(axis=0)
    facets = np.array([[j for j in start if j != i] for i in start])
    normal, offset = _planes(points, facets, inner)
    for p in range(len(points)):
        if p in start:
            continue
        sees = normal @ points[p] > offset
        if not sees.any():
            continue
        ridge, times = np.unique(_ridges(facets[sees]), axis=0, return_counts=True)
        new = np.column_stack([ridge[times == 1], np.full((times == 1).sum(), p)])
        new_normal, new_offset = _planes(points, new, inner)
        facets = np.concatenate([facets[~sees], new])
        normal, offset = np.concatenate([normal[~sees], new_normal]), np.concatenate([offset[~sees], new_offset])
    return facets, normal


def delaunay(points: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Simplices [m, d + 1] and hull facets [h, d] of points, as indices."""
    points = np.asarray(points, float)
    d = points.shape[1]
    none = np.zeros((0, d + 1), int), np.zeros((0, d), int)
    _, first = np.unique(points, axis=0, return_index=True)
    first = np.sort(first)
    own = points[first]
    if len(own) <= d or np.linalg.matrix_rank(own - own[0], tol=1e-10) < d:
        return none
    if len(own) == d + 1:
        return first[None, :], first[np.array(list(combinations(range(d + 1), d)))]
    extent = max(np.ptp(own, axis=0).max(), 1e-300)
    unit = (own - own.mean(axis=0)) / extent
    for trial in range(TRIES):
        moved = unit + JOGGLE * 10**trial * np.random.default_rng(seed + trial).uniform(-1, 1, unit.shape)
        try:
            facets, normal = convex_hull(np.column_stack([moved, (moved**2).sum(axis=1)]))
        except np.linalg.LinAlgError:
            continue
        lower = facets[normal[:, -1] < 0]
        upper = facets[normal[:, -1] >= 0]
        full, other = volumes(moved[lower]).sum(), volumes(moved[upper]).sum()
        # Below and above the lifted points lies the same hull.
        if len(lower) and abs(full - other) <= VOLUME_TOLERANCE * full:
            ridge, times = np.unique(_ridges(lower), axis=0, return_counts=True)
            return first[lower], first[ridge[times == 1]]
    raise ValueError("no consistent triangulation was found")


def _cells(values: list) -> pd.Series:
    """A column of lists, of that kind even if there are none."""
    return pd.Series(values, dtype=object)


def _dealt(designs: DataFrame) -> DataFrame:
    """Designs, dealt by their number of points: by bytes they would all be a few tasks."""
    own = designs.select("design", "id", "u")
    return own.repartition(max(1, -(-own.count() // ROWS)), "design")


SIMPLEX = "design long, simplex long, ids array<long>, vertices array<array<double>>"


def triangulated(designs: DataFrame) -> DataFrame:
    """Each design (design, id, u) as Delaunay simplices: design, simplex (from 0), ids and vertices."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids, points = rows["id"].to_numpy(), np.stack(rows["u"])
        cells = np.sort(delaunay(points)[0], axis=1)
        cells = cells[volumes(points[cells]) > FLAT]
        cells = cells[np.lexsort(cells.T[::-1])]
        return pd.DataFrame({"design": rows["design"].iloc[0], "simplex": np.arange(len(cells)), "ids": _cells([ids[c].tolist() for c in cells]), "vertices": _cells([points[c].tolist() for c in cells])})

    return _dealt(designs).groupBy("design").applyInPandas(cut, SIMPLEX)


def volume_of(vertices: Column) -> Column:
    """The volume of a simplex column, by elimination in Arrow batches."""

    @F.pandas_udf("double")
    def of(v: pd.Series) -> pd.Series:
        return pd.Series(volumes(np.array([np.stack(x) for x in v]))) if len(v) else pd.Series([], dtype=float)

    return of(vertices)


def hull_facets(designs: DataFrame) -> DataFrame:
    """The facets of each design's hull: design, ids."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids = rows["id"].to_numpy()
        found = delaunay(np.stack(rows["u"]))[1]
        return pd.DataFrame({"design": rows["design"].iloc[0], "ids": _cells([sorted(ids[f].tolist()) for f in found])})

    return _dealt(designs).groupBy("design").applyInPandas(cut, "design long, ids array<long>")


def structured_support(dim: int) -> np.ndarray:
    """The centre of the cube with one, two or all coordinates at 0 or 1."""
    out = []
    for many in dict.fromkeys((1, 2, dim)):
        for dims in combinations(range(dim), many):
            for ends in product((0.0, 1.0), repeat=many):
                point = np.full(dim, 0.5)
                point[list(dims)] = ends
                out.append(point)
    return np.unique(np.array(out), axis=0)


def independent(directions: np.ndarray, tolerance: float = 1e-10) -> list[int] | None:
    """The first d rows, in their order, none of which the ones before it span; None if there are fewer."""
    rest, chosen = directions.copy(), []
    scale = np.linalg.norm(directions, axis=1)
    for i in range(len(directions)):
        size = np.linalg.norm(rest[i])
        if scale[i] <= 1e-12 or size <= tolerance:
            continue
        chosen.append(i)
        if len(chosen) == directions.shape[1]:
            return chosen
        axis = rest[i] / size
        rest = rest - np.outer(rest @ axis, axis)
    return None


def fans(designs: DataFrame, support: np.ndarray, fanout: int = 4, near: int = 16) -> DataFrame:
    """For each design and each support point outside its hull, up to `fanout` simplices of that point and affinely independent neighbours.

    Neighbours are tried from the nearest on, each time starting one place later among the `near` nearest, then among all: design, support, fan, ids, vertices (the support point first).
    """

    def open_out(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids, points = rows["id"].to_numpy(), np.stack(rows["u"])
        d, out = points.shape[1], []
        cells = delaunay(points)[0]
        inside = holds(points[cells], support).any(axis=0) if len(cells) else np.zeros(len(support), bool)
        for s in np.flatnonzero(~inside):
            order = np.argsort(np.linalg.norm(points - support[s], axis=1), kind="stable")
            few, seen = order[: max(near, d * fanout)], set()
            for source in (few, order):
                for shift in range(max(len(source), 4 * fanout)):
                    if len(seen) >= fanout:
                        break
                    turned = np.roll(source, -(shift % len(source)))
                    chosen = independent(points[turned] - support[s])
                    key = None if chosen is None else tuple(sorted(turned[chosen].tolist()))
                    if key is not None and key not in seen:
                        seen.add(key)
                        out.append((int(rows["design"].iloc[0]), int(s), len(seen) - 1, ids[turned[chosen]].tolist(), [support[s].tolist(), *points[turned[chosen]].tolist()]))
        return pd.DataFrame(out, columns=["design", "support", "fan", "ids", "vertices"]).astype({"ids": object, "vertices": object})

    return _dealt(designs).groupBy("design").applyInPandas(open_out, "design long, support long, fan int, ids array<long>, vertices array<array<double>>")


def barycentric(vertices: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Coordinates of each point in each simplex: [simplex, point, vertex]; simplices [m, d + 1, d]."""
    edges = np.swapaxes(vertices[:, 1:] - vertices[:, :1], 1, 2)
    rest = np.swapaxes(np.linalg.solve(edges, np.swapaxes(points[None] - vertices[:, :1], 1, 2)), 1, 2)
    return np.concatenate([1 - rest.sum(axis=2, keepdims=True), rest], axis=2)


def holds(vertices: np.ndarray, points: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Whether each simplex holds each point; flat simplices hold none."""
    solid = np.abs(np.linalg.det(vertices[:, 1:] - vertices[:, :1])) > 1e-14
    out = np.zeros((len(vertices), len(points)), bool)
    if solid.any():
        out[solid] = (barycentric(vertices[solid], points) >= -tolerance).all(axis=2)
    return out


def circumcentres(simplices: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """`simplices` (simplex, vertices) with the barycentric weights of their circumcentre, null where it lies outside or the simplex is flat."""

    def centre(batches):
        for rows in batches:
            if not len(rows):
                continue
            v = np.array([np.stack(x) for x in rows["vertices"]])
            edges = v[:, 1:] - v[:, :1]
            solid = np.abs(np.linalg.det(edges)) > 1e-14
            weights = np.full(v.shape[:2], np.nan)
            # |x - v_i| = |x - v_0|: 2 (v_i - v_0) (x - v_0) = |v_i - v_0|^2.
            x = np.linalg.solve(2 * edges[solid], (edges[solid] ** 2).sum(axis=2)[:, :, None])
            rest = np.linalg.solve(np.swapaxes(edges[solid], 1, 2), x)[:, :, 0]
            weights[solid] = np.column_stack([1 - rest.sum(axis=1), rest])
            good = np.nan_to_num(weights, nan=-1.0).min(axis=1) >= -tolerance
            weights = np.maximum(weights, 0)
            weights /= weights.sum(axis=1, keepdims=True)
            yield pd.DataFrame({"simplex": rows["simplex"], "weights": [w.tolist() if g else None for w, g in zip(weights, good, strict=True)]})

    return simplices.select(F.col("simplex").cast("long"), "vertices").mapInPandas(centre, "simplex long, weights array<double>")
