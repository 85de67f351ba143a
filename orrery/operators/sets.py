"""Sets of points: distinct by rounded coordinates, disjoint roles, draws that avoid what exists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.spatial import rounded_key


def first_distinct(df: DataFrame, u: str, digits: int = 12, exclude: DataFrame | None = None) -> DataFrame:
    """The row with the smallest id of each rounded point, without those of `exclude`."""
    keyed = df.withColumn("__key", rounded_key(F.col(u), digits))
    columns = df.columns
    first = keyed.groupBy("__key").agg(F.min_by(F.struct(*columns), "id").alias("__r"))
    if exclude is not None:
        first = first.join(exclude.select(rounded_key(F.col(u), digits).alias("__key")).distinct(), "__key", "left_anti")
    return first.select(*(F.col(f"__r.{c}").alias(c) for c in columns))


def disjoint_roles(df: DataFrame, u: str, digits: int = 12) -> DataFrame:
    """Each rounded point in the first role (then with the smallest id) that has it, and in no other."""
    columns = df.columns
    keyed = df.groupBy(rounded_key(F.col(u), digits).alias("__key")).agg(F.min_by(F.struct(*columns), F.struct("role", "id")).alias("__r"))
    return keyed.select(*(F.col(f"__r.{c}").alias(c) for c in columns))


def overlap(a: DataFrame, b: DataFrame, u: str, digits: int = 12) -> DataFrame:
    """How many rounded points two sets share; 0 for disjoint splits."""
    key = lambda df: df.select(rounded_key(F.col(u), digits).alias("k"))
    return key(a).intersect(key(b)).agg(F.count("*").alias("shared"))


def draw_disjoint(draw, count: int, exclude: DataFrame, u: str = "u", digits: int = 12, attempts: int = 128) -> DataFrame:
    """`count` points of draw(n, attempt) that `exclude` lacks; each attempt draws four times what is missing."""
    kept = None
    for attempt in range(attempts):
        fresh = first_distinct(draw(4 * count, attempt), u, digits, exclude)
        kept = fresh if kept is None else first_distinct(kept.unionByName(fresh), u, digits)
        if kept.count() >= count:
            return kept.orderBy("id").limit(count)
    raise ValueError(f"no {count} points apart from those excluded after {attempts} draws")


def append_rounds(initial: DataFrame, rounds: DataFrame) -> DataFrame:
    """Initial points, then those of each round in order, with a position."""
    return initial.withColumn("round", F.lit(0)).unionByName(rounds).orderBy("round", "id")
