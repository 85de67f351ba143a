"""Centred discrepancy of designs in the unit cube, and what each candidate would take off it.

With S1 the sum of the points' own terms and S2 that of all pairs' terms, the squared discrepancy of n points is
(13/12)^d - 2 S1 / n + S2 / n^2. A candidate p changes S1 by its own term and S2 by twice its terms with the design and
its term with itself, so one pass of the candidates over blocks of the design gives every gain; no design is summed anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.spatial import blocks, coordinates, sums_against, tiles


def _off(x: Column) -> Column:
    return F.abs(x - 0.5)


def _product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda a, x: a * x)


def own_term(u: Column) -> Column:
    return _product(F.transform(u, lambda x: 1 + 0.5 * _off(x) - 0.5 * _off(x) * _off(x)))


def pair_term(u: Column, v: Column) -> Column:
    return _product(F.zip_with(u, v, lambda x, y: 1 + 0.5 * _off(x) + 0.5 * _off(y) - 0.5 * F.abs(x - y)))


def _pair_terms(rows: pa.Table, refs: pa.StructArray) -> np.ndarray:
    """The sums of each row's terms with all points of a block."""
    u, v, out = coordinates(rows["u"]), coordinates(refs.field("u")), np.zeros((len(rows), 1))
    off_u, off_v = 1 + 0.5 * np.abs(u - 0.5), 0.5 * np.abs(v - 0.5)
    u, v = 0.5 * u, 0.5 * v
    for i, j in tiles(len(u), len(v)):
        product = np.ones((len(u[i]), len(v[j])))
        for d in range(u.shape[1]):
            term = np.subtract.outer(u[i, d], v[j, d])
            np.subtract(off_v[None, j, d], np.abs(term, out=term), out=term)
            term += off_u[i, d, None]
            product *= term
        out[i, 0] += product.sum(axis=1)
    return out


def _pair_sums(rows: DataFrame, held: DataFrame) -> DataFrame:
    """id and k, the sum of its terms with all points of the design, from the design's blocks."""
    return sums_against(rows, held, _pair_terms, 1).select("id", F.col("s0").alias("k"))


def sums(design: DataFrame) -> DataFrame:
    """One row of a design (id, u): n, dim, s1 and s2."""
    one = design.agg(F.count("*").alias("n"), F.max(F.size("u")).alias("dim"), F.sum(own_term(F.col("u"))).alias("s1"))
    return one.crossJoin(_pair_sums(design, blocks(design, ["id", "u"])).agg(F.sum("k").alias("s2")))


def squared(n: Column, dim: Column, s1: Column, s2: Column) -> Column:
    return F.pow(F.lit(13.0 / 12), dim) - 2.0 / n * s1 + s2 / (n * n)


def discrepancy(design: DataFrame) -> DataFrame:
    """One row: the centred discrepancy; null for no points."""
    c = F.col
    return sums(design).select(F.sqrt(F.greatest(squared(c("n"), c("dim"), c("s1"), c("s2")), F.lit(0.0))).alias("discrepancy"))


def gains(candidates: DataFrame, design: DataFrame, name: str = "gain") -> DataFrame:
    """`candidates` (id, u and others) with the fall of the squared discrepancy if each joined the design; 0 for an empty design. Ids are distinct."""
    c = lambda x: F.col(f"__{x}")
    held = sums(design)
    now = F.broadcast(held.select(*(F.col(x).alias(f"__{x}") for x in held.columns)))
    both = candidates.join(_pair_sums(candidates, blocks(design, ["id", "u"])).withColumnRenamed("k", "__k"), "id", "left").crossJoin(now)
    u = F.col("u")
    after = squared(c("n") + 1, c("dim"), c("s1") + own_term(u), c("s2") + 2 * c("k") + pair_term(u, u))
    gain = F.when(c("n") > 0, squared(c("n"), c("dim"), c("s1"), c("s2")) - after).otherwise(0.0)
    return both.withColumn("__gain", gain).select(*candidates.columns, c("gain").alias(name))
