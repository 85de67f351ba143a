"""Where reference points lie in the simplices of designs, and which of these places are accepted.

Each design is triangulated in a task of its own (see `hulls`); its row of simplices then meets the reference points in
blocks, and only pairs of a design and a point it holds become rows. Any dimension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import hulls
from orrery.operators.quantiles import quantile_columns
from orrery.operators.spatial import blocks

FIELDS = "design long, ref_id long, simplex long, deviation double, scale double, condition double, boundary double"
#: Points that meet all simplices of a design together, in tables of points times simplices.
POINTS = 256


def geometry_batch(designs: DataFrame, references: DataFrame) -> DataFrame:
    """For each design (design, id, u) and each reference point (id, u) it holds: the simplex, how far from its centre, and its shape."""
    cells = hulls.triangulated(designs).groupBy("design").agg(F.array_sort(F.collect_list(F.struct("simplex", "vertices"))).alias("cells"))
    met = cells.crossJoin(blocks(references.select("id", "u"), ["id", "u"]).drop("block"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                vertices = np.array([np.stack(c["vertices"]) for c in r.cells])
                edges = vertices[:, 1:] - vertices[:, :1]
                spread = np.sqrt(((vertices - vertices.mean(axis=1, keepdims=True)) ** 2).sum(axis=2).mean(axis=1))
                condition = np.linalg.cond(edges)
                ids, u = np.array([x["id"] for x in r.refs]), np.stack([x["u"] for x in r.refs])
                for lo in range(0, len(u), POINTS):
                    part = u[lo : lo + POINTS]
                    bary = hulls.barycentric(vertices, part)
                    inside = (bary >= -1e-9).all(axis=2)
                    at, own = inside.argmax(axis=0), np.flatnonzero(inside.any(axis=0))
                    at = at[own]
                    off = np.abs(bary[at, own] - 1 / bary.shape[2]).max(axis=1)
                    yield pd.DataFrame({"design": r.design, "ref_id": ids[lo : lo + POINTS][own], "simplex": at, "deviation": off, "scale": spread[at], "condition": condition[at], "boundary": np.minimum(part, 1 - part).min(axis=1)[own]})

    return met.select("design", "cells", "refs").mapInPandas(measure, FIELDS)


def thresholds(geometry: DataFrame) -> DataFrame:
    """One row: the tenth and ninetieth percentile of the scale and the ninetieth of the condition, exact whatever the number of rows."""
    return quantile_columns(geometry, [], "scale", {"h_min": 0.1, "h_max": 0.9}).crossJoin(quantile_columns(geometry, [], "condition", {"kappa_max": 0.9}))


def accepted(geometry: DataFrame, limits: DataFrame, deviation: float, boundary: float = 0.02) -> DataFrame:
    """Near its simplex's centre, of usual size and shape, and off the faces of the cube."""
    rows = geometry.crossJoin(F.broadcast(limits))
    ok = (F.col("deviation") <= deviation) & F.col("scale").between(F.col("h_min"), F.col("h_max")) & (F.col("condition") <= F.col("kappa_max")) & (F.col("boundary") >= boundary)
    return rows.where(ok).drop(*limits.columns)
