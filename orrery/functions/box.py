"""Points in a parameter box: affine maps to the unit cube and what is measured there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_FLOOR = 1e-12


def normalize(x: Column, lo: Column, hi: Column, clip: bool = True) -> Column:
    """A coordinate's place between lo and hi, by default clipped to the box."""
    unit = (x - lo) / F.greatest(hi - lo, F.lit(SPAN_FLOOR))
    return clip_unit(unit) if clip else unit


def denormalize(u: Column, lo: Column, hi: Column) -> Column:
    return lo + u * F.greatest(hi - lo, F.lit(SPAN_FLOOR))


def clip_unit(u: Column) -> Column:
    return F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0))


def clip_to_guard(u: Column, guard: float) -> Column:
    return F.least(F.greatest(u, F.lit(guard)), F.lit(1.0 - guard))


def boundary_distance(point: Column) -> Column:
    """Of a point in the unit cube: to its nearest face."""
    return F.array_min(F.transform(point, lambda u: F.least(u, 1.0 - u)))


def is_point(point: Column, dim: int) -> Column:
    """Whether a point has `dim` finite coordinates."""
    return F.coalesce((F.size(point) == dim) & F.forall(point, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def bulk_density(point: Column, power: float, floor: float) -> Column:
    """floor + (1 - floor) exp(power * mean ln 4u(1-u)): 1 at the centre, the floor at the faces."""
    logs = F.transform(point, lambda u: F.log(F.greatest(4.0 * u * (1.0 - u), F.lit(1e-12))))
    return floor + (1.0 - floor) * F.exp(power * F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / F.size(point))


def project_to_simplex(vector: Column) -> Column:
    """The nearest point with non-negative coordinates that sum to 1."""
    falling = F.reverse(F.array_sort(vector))
    ranks = F.sequence(F.lit(1), F.size(vector))
    over = F.transform(ranks, lambda j: (F.aggregate(F.slice(falling, F.lit(1), j), F.lit(0.0), lambda s, x: s + x) - 1.0) / j)
    shift = F.array_min(F.transform(F.filter(F.zip_with(falling, over, lambda v, t: F.when(v > t, t)), lambda t: t.isNotNull()), lambda t: -t))
    return F.transform(vector, lambda v: F.greatest(v + shift, F.lit(0.0)))
