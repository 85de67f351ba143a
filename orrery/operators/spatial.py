"""Joins by distance between points: nearest, k nearest, kernels, tolerances, brackets along an axis.

The reference side (a design, knots, hot probes) travels in blocks of about BLOCK rows, each block as one array; parts of the
queries meet blocks in `against`, one group for each part and block, where numpy works on a few rows of their pairs at a time.
So no pair becomes a row and no task holds more than one part and one block. Joins that only need what is near (nearest,
tolerance, novelty) go through cells where the reference is large, see `cells`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orrery.functions.box import distance
from orrery.operators import cells
from orrery.operators.quantiles import running_total

BLOCK = 4096
#: As many blocks are broadcast together where a row meets them in one expression.
BROADCAST_BLOCKS = 32
#: Query rows of one part, reference rows of one block where numpy meets them, and pairs that are in memory together.
PART, WIDE, PAIRS = 8192, 1 << 16, 1 << 16


def blocks(reference: DataFrame, fields: list[str], limit: int = BLOCK) -> DataFrame:
    """One row with an array of structs for each block of about `limit` rows, hinted for broadcast if there are few."""
    n = max(1, -(-reference.count() // limit))
    dealt = reference.select(F.struct(*fields).alias("r"), F.pmod(F.xxhash64(*(F.col(f) for f in fields)), F.lit(n)).alias("block"))
    out = dealt.groupBy("block").agg(F.collect_list("r").alias("refs"))
    return F.broadcast(out) if n * limit <= BLOCK * BROADCAST_BLOCKS else out


def coordinates(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of points of one dimension as [row, dim]."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def tiles(m: int, n: int, width: int = 2048) -> Iterator[tuple[slice, slice]]:
    """Slices of m rows and n others, about PAIRS pairs each."""
    for j in range(0, n, width):
        rows = max(1, PAIRS // min(width, n - j))
        for i in range(0, m, rows):
            yield slice(i, i + rows), slice(j, j + width)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, summed in the order of the coordinates."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = np.subtract.outer(a[:, i], b[:, i])
        d *= d
        out += d
    return out


def against(queries: DataFrame, held: DataFrame, work: Callable[[pa.Table, pa.StructArray], pa.Table], schema: T.StructType) -> DataFrame:
    """The rows that `work` makes of each part of `queries` (id, u) and each block of `held`, see `blocks`; points that are null are left out."""
    asked = queries.select("id", "u").where("u is not null")
    parts = max(1, -(-asked.count() // PART))
    left = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).crossJoin(F.broadcast(held.select("block")))
    right = held.select(F.col("block").alias("at"), F.filter("refs", lambda r: r["u"].isNotNull()).alias("refs")).crossJoin(queries.sparkSession.range(parts).withColumnRenamed("id", "of"))

    def meet(rows: pa.Table, block: pa.Table) -> pa.Table:
        refs = block["refs"].combine_chunks().flatten() if len(rows) and len(block) else []
        return work(rows, refs) if len(refs) else to_arrow_schema(schema).empty_table()

    return left.groupBy("part", "block").cogroup(right.groupBy("of", "at")).applyInArrow(meet, schema)


def sums_against(queries: DataFrame, held: DataFrame, terms: Callable[[pa.Table, pa.StructArray], np.ndarray], count: int) -> DataFrame:
    """id and s0, s1, ...: for each query the sums over all blocks of what `terms` ([row, sum]) gives for one."""
    names = [f"s{i}" for i in range(count)]

    def work(rows: pa.Table, refs: pa.StructArray) -> pa.Table:
        found = terms(rows, refs)
        return pa.table({"id": rows["id"], **{n: found[:, i] for i, n in enumerate(names)}})

    per = against(queries, held, work, T.StructType([queries.schema["id"], *(T.StructField(n, T.DoubleType()) for n in names)]))
    return per.groupBy("id").agg(*(F.sum(n).alias(n) for n in names))


def nearest_distance(queries: DataFrame, reference: DataFrame, u: str, name: str, other_than_self: bool = False, most: int = BLOCK * BROADCAST_BLOCKS) -> DataFrame:
    """Each query's distance to its nearest reference row (id, u); infinite where there is none. More than `most` reference rows are met through cells."""
    held, asked = reference.select("id", F.col(u).alias("u")), queries.select("id", F.col(u).alias("u"))
    n = held.count()
    if n > most:
        found = cells.nearest(asked, held, name, other_than_self, max(n, 1) ** (-1 / cells.DIMS))
    else:

        def work(rows: pa.Table, refs: pa.StructArray) -> pa.Table:
            a, b, best = coordinates(rows["u"]), coordinates(refs.field("u")), np.full(len(rows), np.inf)
            ids, others = rows["id"].to_numpy(), refs.field("id").to_numpy(zero_copy_only=False)
            for i, j in tiles(len(a), len(b)):
                d = squares(a[i], b[j])
                if other_than_self:
                    d[ids[i, None] == others[None, j]] = np.inf
                best[i] = np.minimum(best[i], d.min(axis=1))
            return pa.table({"id": rows["id"], "d": np.sqrt(best)})

        schema = T.StructType([asked.schema["id"], T.StructField("d", T.DoubleType())])
        found = against(asked, blocks(held, ["id", "u"], WIDE), work, schema).groupBy("id").agg(F.min("d").alias(name))
    return queries.join(found, "id", "left").withColumn(name, F.coalesce(name, F.lit(float("inf"))))


def farther_than(queries: DataFrame, reference: DataFrame, radius: float, most: int = BLOCK * BROADCAST_BLOCKS) -> DataFrame:
    """The queries (id, u and others) with no reference row within the radius: an anti join on distance."""
    if reference.count() <= most:
        return nearest_distance(queries, reference, "u", "__near", most=most).where(F.col("__near") > radius).drop("__near")
    hit = cells.within(queries.select("id", "u"), reference, radius, lambda r: distance(F.col("u"), r["u"]) <= radius).where("match_id is not null")
    return queries.join(hit.select("id"), "id", "left_anti")


def _first_k(distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its k smallest distances, ties to smaller ids; in no order."""
    if k >= distances.shape[1]:
        return np.tile(np.arange(distances.shape[1]), (len(distances), 1))
    found = np.argpartition(distances, k - 1, axis=1)[:, :k]
    level = np.take_along_axis(distances, found, axis=1).max(axis=1)
    for i in np.flatnonzero((distances <= level[:, None]).sum(axis=1) > k):
        tied = np.flatnonzero(distances[i] <= level[i])
        found[i] = tied[np.lexsort((ids[tied], distances[i, tied]))[:k]]
    return found


def nearest_k(queries: DataFrame, reference: DataFrame, k: int, extra: list[str]) -> DataFrame:
    """The k nearest reference rows of each query: id, rn, distance d and the reference's id and extra columns as ref_*."""
    fields = ["id", "u", *extra]
    kept = ["id", *extra]

    def work(rows: pa.Table, refs: pa.StructArray) -> pa.Table:
        a, b, ids = coordinates(rows["u"]), coordinates(refs.field("u")), refs.field("id").to_numpy(zero_copy_only=False)
        # Written where they stay: a view of what was ranked would keep all of the block's distances or places with each row.
        at = np.empty((len(a), min(k, len(b))), dtype=np.int64)
        near = np.empty(at.shape)
        for lo in range(0, len(a), max(1, PAIRS // len(b))):
            own = slice(lo, lo + max(1, PAIRS // len(b)))
            d = np.sqrt(squares(a[own], b))
            at[own] = _first_k(d, ids, k)
            near[own] = np.take_along_axis(d, at[own], axis=1)
        met = {"id": rows["id"].take(pa.array(np.repeat(np.arange(len(a)), at.shape[1]))), "d": near.ravel()}
        return pa.table(met | {f"ref_{f}": refs.field(f).take(pa.array(at.ravel())) for f in kept})

    schema = T.StructType([queries.schema["id"], T.StructField("d", T.DoubleType()), *(T.StructField(f"ref_{f}", reference.schema[f].dataType) for f in kept)])
    best = against(queries, blocks(reference.select(*fields), fields, WIDE), work, schema)
    rn = F.row_number().over(Window.partitionBy("id").orderBy("d", "ref_id"))
    return best.withColumn("rn", rn).where(F.col("rn") <= k)


def kernel_mean(queries: DataFrame, reference: DataFrame, y: str, width: float, name: str) -> DataFrame:
    """Mean of y over the reference, weighted by exp(-d^2 / 2 width^2)."""

    def terms(rows: pa.Table, refs: pa.StructArray) -> np.ndarray:
        a, b, out = coordinates(rows["u"]), coordinates(refs.field("u")), np.zeros((len(rows), 2))
        weighed = np.column_stack([np.ones(len(b)), np.asarray(refs.field("y"), dtype=float)])
        for i, j in tiles(len(a), len(b)):
            w = squares(a[i], b[j])
            w *= -0.5 / (width * width)
            out[i] += np.exp(w, out=w) @ weighed[j]
        return out

    sums = sums_against(queries, blocks(reference.select("id", "u", F.col(y).alias("y")), ["id", "u", "y"], WIDE), terms, 2)
    return queries.join(sums.select("id", (F.col("s1") / F.col("s0")).alias(name)), "id")


def reliability_smoother(queries: DataFrame, reference: DataFrame, k: int, full_count: int = 20) -> DataFrame:
    """Mean of the k nearest values, weighted by min(1, count / full_count) exp(-(d / d_k)^2 / 2); an exact hit gives its own value.

    `reference` has id, u, value, n. Confidence is the effective number of neighbours over k, at most 1.
    """
    near = nearest_k(queries, reference, k, ["value", "n"])
    dk = F.max("d").over(Window.partitionBy("id"))
    w = F.least(F.lit(1.0), F.col("ref_n") / full_count) * F.exp(-0.5 * F.pow(F.col("d") / F.greatest(dk, F.lit(1e-12)), F.lit(2.0)))
    weighted = near.withColumn("w", w)
    hit = F.min_by("ref_value", F.struct("d", "ref_id"))
    mean = F.sum(F.col("w") * F.col("ref_value")) / F.sum("w")
    ess = F.pow(F.sum("w"), F.lit(2.0)) / F.sum(F.col("w") * F.col("w"))
    return weighted.groupBy("id").agg(F.when(F.min("d") <= 1e-7, hit).otherwise(mean).alias("value"), F.when(F.min("d") <= 1e-7, F.lit(1.0)).otherwise(F.least(F.lit(1.0), ess / k)).alias("confidence"))


def rounded_key(u: Column, digits: int = 12) -> Column:
    """A point's key: its coordinates rounded half to even."""
    return F.transform(u, lambda x: F.bround(x, digits))


def match_rows(left: DataFrame, right: DataFrame, digits: int = 12) -> DataFrame:
    """One-to-one: the nth row of a rounded point on one side with the nth on the other."""
    nth = lambda df, i: df.withColumn("__key", rounded_key(F.col("u"), digits)).withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy(i)))
    a, b = nth(left.select(F.col("id").alias("left_id"), "u"), "left_id"), nth(right.select(F.col("id").alias("right_id"), "u"), "right_id")
    return a.join(b.drop("u"), ["__key", "__n"]).select("left_id", "right_id")


def within_tolerance(queries: DataFrame, reference: DataFrame, atol: float, rtol: float = 0.0, most: int = BLOCK) -> DataFrame:
    """The first reference row with every coordinate within atol + rtol |reference|, null where there is none. More than `most` reference rows are met through cells."""
    close = lambda r: F.forall(F.zip_with("u", r["u"], lambda a, b: F.abs(a - b) <= atol + rtol * F.abs(b)), lambda x: x)
    if reference.count() > most:
        far = reference.agg(F.max(F.array_max(F.transform("u", lambda x: F.abs(x)))).alias("m")).first()["m"] if rtol else 0.0
        return cells.within(queries, reference, max(atol + rtol * far, 1e-12), close)
    own = queries.select("id", "u").crossJoin(blocks(reference.select("id", "u"), ["id", "u"]))
    first = F.array_min(F.transform(F.filter("refs", close), lambda r: r["id"]))
    return own.withColumn("__m", first).groupBy("id").agg(F.min("__m").alias("match_id"))


def rank_quantile(values: DataFrame, support: DataFrame, x: str, name: str) -> DataFrame:
    """Share of the support at or below each value: one sort of both together, no pairs."""
    both = support.select(F.col(x).alias("__x"), F.lit(1).alias("__s")).unionAll(values.select(F.col(x).alias("__x"), F.lit(0).alias("__s")))
    counts = both.groupBy("__x").agg(F.sum("__s").alias("__s"))
    upto = running_total(counts, "__x", "__s", "__c").drop("__s")
    total = F.broadcast(support.agg(F.count("*").alias("__n")))
    return values.join(upto, values[x] == upto["__x"]).crossJoin(total).withColumn(name, F.col("__c") / F.col("__n")).drop("__x", "__c", "__n")


def brackets(queries: DataFrame, knots: DataFrame, x: str, fields: list[str]) -> DataFrame:
    """As-of both ways: the last knot at or before each query's x and the first one after, as `before` and `after` structs.

    The knots are a small sorted table; they travel as one array that each row searches.
    """
    sorted_knots = F.broadcast(knots.agg(F.array_sort(F.collect_list(F.struct(x, *fields))).alias("__k")))
    own = queries.crossJoin(sorted_knots)
    before = F.element_at(F.filter("__k", lambda k: k[x] <= F.col(x)), -1)
    after = F.get(F.filter("__k", lambda k: k[x] > F.col(x)), F.lit(0))
    found = own.withColumn("__b", F.filter("__k", lambda k: k[x] <= F.col(x)))
    return found.withColumn("before", F.when(F.size("__b") > 0, before)).withColumn("after", after).drop("__k", "__b")


def linear(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return y0 + (x - x0) / (x1 - x0) * (y1 - y0)


def pchip_knots(knots: DataFrame, x: str, y: str) -> DataFrame:
    """Knots with shape-preserving slopes: a weighted harmonic mean inside, a limited one-sided one at the ends."""
    o = Window.orderBy(x)
    h1, d1 = F.lead(x).over(o) - F.col(x), (F.lead(y).over(o) - F.col(y)) / (F.lead(x).over(o) - F.col(x))
    k = knots.withColumn("h", h1).withColumn("d", d1)
    k = k.withColumn("hb", F.lag("h").over(o)).withColumn("db", F.lag("d").over(o)).withColumn("ha", F.lead("h").over(o)).withColumn("da", F.lead("d").over(o))
    k = k.withColumn("hbb", F.lag("h", 2).over(o)).withColumn("dbb", F.lag("d", 2).over(o))
    w1, w2 = 2 * F.col("h") + F.col("hb"), F.col("h") + 2 * F.col("hb")
    inner = F.when(F.col("d") * F.col("db") > 0, (w1 + w2) / (w1 / F.col("db") + w2 / F.col("d"))).otherwise(0.0)

    def end(h0, h1_, d0, d1_):
        m = ((2 * h0 + h1_) * d0 - h0 * d1_) / (h0 + h1_)
        return F.when(F.signum(m) != F.signum(d0), 0.0).when((F.signum(d0) != F.signum(d1_)) & (F.abs(m) > 3 * F.abs(d0)), 3 * d0).otherwise(m)

    first, last = end(F.col("h"), F.col("ha"), F.col("d"), F.col("da")), end(F.col("hb"), F.col("hbb"), F.col("db"), F.col("dbb"))
    return k.withColumn("slope", F.when(F.col("hb").isNull(), first).when(F.col("h").isNull(), last).otherwise(inner)).select(x, y, "slope")


def hermite(x: Column, x0: Column, y0: Column, m0: Column, x1: Column, y1: Column, m1: Column) -> Column:
    h = x1 - x0
    t = (x - x0) / h
    return (1 + 2 * t) * (1 - t) * (1 - t) * y0 + t * (1 - t) * (1 - t) * h * m0 + t * t * (3 - 2 * t) * y1 + t * t * (t - 1) * h * m1


def pair_sum(points: DataFrame, term: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Sum over i < j of term(squared distances of pairs)."""

    def terms(rows: pa.Table, refs: pa.StructArray) -> np.ndarray:
        a, b, out = coordinates(rows["u"]), coordinates(refs.field("u")), np.zeros((len(rows), 1))
        ids, others = rows["id"].to_numpy(), refs.field("id").to_numpy(zero_copy_only=False)
        for i, j in tiles(len(a), len(b)):
            out[i, 0] += np.where(others[None, j] > ids[i, None], term(squares(a[i], b[j])), 0).sum(axis=1)
        return out

    return sums_against(points, blocks(points.select("id", "u"), ["id", "u"], WIDE), terms, 1).agg(F.sum("s0").alias("value"))


def repulsion(points: DataFrame, eta: float, length: float, soft: float) -> DataFrame:
    """One evaluation of the pair force on each point: eta sum exp(-d^2 / 2 l^2) / (d^2 + soft^2) (u_i - u_j)."""
    first = points.where("u is not null").select(F.size("u").alias("n")).first()
    dims = first["n"] if first else 0

    def terms(rows: pa.Table, refs: pa.StructArray) -> np.ndarray:
        a, b, out = coordinates(rows["u"]), coordinates(refs.field("u")), np.zeros((len(rows), dims))
        ids, others = rows["id"].to_numpy(), refs.field("id").to_numpy(zero_copy_only=False)
        for i, j in tiles(len(a), len(b)):
            d = squares(a[i], b[j])
            # A point is no neighbour of its own, whatever the softening.
            d[ids[i, None] == others[None, j]] = np.inf
            push = np.exp(d * (-0.5 / (length * length))) / (d + soft * soft)
            out[i] += push.sum(axis=1)[:, None] * a[i] - push @ b[j]
        return out

    sums = sums_against(points, blocks(points.select("id", "u"), ["id", "u"], WIDE), terms, dims)
    forces = F.posexplode(F.array(*(F.col(f"s{i}") for i in range(dims))) if dims else F.array().cast("array<double>")).alias("dim", "f")
    return sums.select("id", forces).select("id", "dim", (eta * F.col("f")).alias("force"))


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)
