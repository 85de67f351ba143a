"""Generators of points: low-discrepancy, Latin hypercube, support sets, clouds. All from spark.range and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: For each dimension the polynomial's degree and inner bits, and the initial direction numbers.
SOBOL = [(0, 0, [1]), (1, 0, [1]), (2, 1, [1, 3]), (3, 1, [1, 3, 1]), (3, 2, [1, 1, 1]), (4, 1, [1, 1, 3, 3]), (4, 4, [1, 3, 5, 13]), (5, 2, [1, 1, 5, 5, 17])]
BITS = 30
#: Ids of one row before they become rows.
CHUNK = 4096


def _directions(dim: int) -> list[int]:
    degree, inner, first = SOBOL[dim]
    if dim == 0:
        return [1 << (BITS - 1 - i) for i in range(BITS)]
    m = list(first)
    for i in range(degree, BITS):
        new = m[i - degree] ^ (m[i - degree] << degree)
        for j in range(1, degree):
            if inner >> (degree - 1 - j) & 1:
                new ^= m[i - j] << j
        m.append(new)
    return [m[i] << (BITS - 1 - i) for i in range(BITS)]


def sobol(spark: SparkSession, count: int, dim: int, seed: int | None = None, skip: int = 0) -> DataFrame:
    """Sobol points (id, u); a seed shifts all digitally, which keeps their stratification."""
    gray = F.col("id").bitwiseXOR(F.shiftright("id", 1))
    coords = []
    for d in range(dim):
        digit = F.lit(0).cast("long")
        for b, v in enumerate(_directions(d)[: max(1, (count + skip).bit_length())]):
            digit = digit.bitwiseXOR(F.shiftright(gray, b).bitwiseAND(F.lit(1)) * v)
        if seed is not None:
            digit = digit.bitwiseXOR(F.pmod(F.xxhash64(F.lit(seed), F.lit(d)), F.lit(1 << BITS)))
        coords.append(digit / float(1 << BITS))
    return spark.range(skip, skip + count).select("id", F.array(*coords).alias("u"))


def sobol_for(sizes: DataFrame, by: str, count: str, dim: int) -> DataFrame:
    """Sobol points for each row of `sizes`: `by`, id (from 0) and u, as many as its count; one expression, whatever the sizes (below 2^BITS)."""
    rows = sizes.where(F.col(count) > 0).select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1)).alias("id"))
    gray = F.col("id").bitwiseXOR(F.shiftright("id", 1))
    coords = []
    for d in range(dim):
        digit = F.lit(0).cast("long")
        for b, v in enumerate(_directions(d)):
            digit = digit.bitwiseXOR(F.shiftright(gray, b).bitwiseAND(F.lit(1)) * v)
        coords.append(digit / float(1 << BITS))
    return rows.select(by, "id", F.array(*coords).alias("u"))


def latin_hypercube_for(sizes: DataFrame, by: str, count: str, dim: int, seed: int) -> DataFrame:
    """A Latin hypercube for each row of `sizes`: `by`, its count, id and u. Slices are dealt by the rank of a hash, apart for each dimension and `by`."""
    chunks = sizes.where(F.col(count) > 0).select(by, F.col(count), F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1, F.lit(CHUNK).cast("long"))).alias("first"))
    rows = chunks.select(by, count, F.explode(F.sequence("first", F.least(F.col("first") + CHUNK, F.col(count).cast("long")) - 1)).alias("id"))
    for i in range(dim):
        own = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), F.col(by), F.lit(i), F.col("id")), "id")
        rows = rows.withColumn(f"__{i}", (F.row_number().over(own) - 1 + hashed_uniform(F.lit(seed), F.col(by), F.lit(i), F.col("id"))) / F.col(count))
    return rows.select(by, count, "id", F.array(*(F.col(f"__{i}") for i in range(dim))).alias("u"))


def hashed_uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, so that a lost task draws it again."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)) / float(1 << 53)


def latin_hypercube(spark: SparkSession, count: int, dim: int, seed: int) -> DataFrame:
    """One point in each of `count` slices of every dimension: slices are dealt by an affine permutation of the row number."""
    ids = spark.range(count)
    coords = []
    for d in range(dim):
        step = _coprime(count, seed * 31 + d * 7 + 1)
        slice_ = F.pmod(F.col("id") * step + F.lit((seed * 17 + d * 13) % count), F.lit(count))
        coords.append((slice_ + hashed_uniform(F.lit(seed), F.lit(d), F.col("id"))) / float(count))
    return ids.select("id", F.array(*coords).alias("u"))


def _coprime(n: int, start: int) -> int:
    from math import gcd

    step = start * 0x9E3779B1 % n if n > 1 else 1
    while gcd(step, n) != 1:
        step += 1
    return step


def jitter(points: DataFrame, scale: float, seed: int, copies: int = 1) -> DataFrame:
    """Copies of points moved by Gaussian steps, clipped to the unit cube."""
    more = points.select("id", "u", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    normal = lambda i: F.sqrt(-2 * F.log(1 - hashed_uniform(F.lit(seed), F.col("id"), F.col("copy"), i))) * F.cos(6.283185307179586 * hashed_uniform(F.lit(seed + 1), F.col("id"), F.col("copy"), i))
    return more.select("id", "copy", F.transform("u", lambda x, i: F.least(F.greatest(x + scale * normal(i), F.lit(0.0)), F.lit(1.0))).alias("u"))


def dirichlet(points: DataFrame, shrink: float = 0.05) -> DataFrame:
    """Barycentric coordinates from unit cube points, by sorted spacings, drawn a little to the centre."""
    cut = F.array_sort("u")
    edges = F.concat(F.array(F.lit(0.0)), cut, F.array(F.lit(1.0)))
    gaps = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.get(edges, i) - F.get(edges, i - 1))
    return points.select("id", F.transform(gaps, lambda g: (1 - shrink) * g + shrink / (F.size("u") + 1)).alias("bary"))


def support_points(spark: SparkSession, dim: int, scheme: str) -> DataFrame:
    """Points on the boundary of the cube: face centres (`axis_only`), with corners in Gray order (`axis_corner_hybrid`)."""
    centre = [0.5] * dim
    rows = [(2 * d + s, [float(s) if i == d else c for i, c in enumerate(centre)]) for d in range(dim) for s in (0, 1)]
    faces = spark.createDataFrame(rows, "id long, u array<double>")
    if scheme == "axis_only":
        return faces
    gray = F.col("id").bitwiseXOR(F.shiftright("id", 1))
    corners = spark.range(1 << dim).select((F.col("id") + 2 * dim).alias("id"), F.array(*(F.shiftright(gray, d).bitwiseAND(F.lit(1)).cast("double") for d in range(dim))).alias("u"))
    return faces.unionAll(corners)
