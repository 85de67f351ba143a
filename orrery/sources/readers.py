"""Scans. All take paths that Spark reads; nothing is opened on the driver."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def require(df: DataFrame, test: Column, message: str) -> DataFrame:
    """The rows as they are; the first that fails the test ends the query with the message."""
    return df.where(F.coalesce(F.assert_true(F.coalesce(test, F.lit(False)), message).isNull(), F.lit(True)))


def designs(spark: SparkSession, path: str, role: str | None = None) -> DataFrame:
    """A table of points partitioned by role; one role reads one folder."""
    df = spark.read.parquet(path)
    return df if role is None else df.where(F.col("role") == role)


def optional_design(spark: SparkSession, path: str | None, column: str) -> tuple[DataFrame | None, str]:
    """Points and `loaded`, or nothing and why: disabled, missing_path, missing_file or missing_key."""
    if path is None:
        return None, "disabled"
    if not path:
        return None, "missing_path"
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None, "missing_file"
    return (df, "loaded") if column in df.columns else (None, "missing_key")


def in_box(df: DataFrame, column: str, lo: list[float], hi: list[float], is_unit: bool) -> DataFrame:
    """Points in raw coordinates of the present box: unit ones are mapped into it, raw ones stay."""
    if not is_unit:
        return df
    low, high = (F.array(*(F.lit(float(x)) for x in b)) for b in (lo, hi))
    return df.withColumn(column, F.transform(column, lambda u, i: F.get(low, i) + u * (F.get(high, i) - F.get(low, i))))


def k_axis(df: DataFrame, k: str, least: float, most: float, expected: int | None = None) -> DataFrame:
    """Distinct axis points within bounds; a count other than the expected ends the query."""
    axis = df.select(F.col(k).cast("double").alias("k")).where(F.col("k").between(least, most)).distinct()
    if expected is None:
        return axis
    n = F.broadcast(axis.agg(F.count("*").alias("__n")))
    return require(axis.crossJoin(n), F.col("__n") == expected, f"the axis must have {expected} points").drop("__n")


def spectra(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """A bank (id, theta, k, power) whose rows have `dim` coordinates, positive k and power."""
    df = require(spark.read.parquet(path), F.size("theta") == dim, f"theta must have {dim} columns")
    return require(df, (F.col("k") > 0) & (F.col("power") > 0), "k and power must be positive")


def rising(df: DataFrame, by: str, order: str, x: str) -> DataFrame:
    """The rows, if x rises strictly along `order` in each group; else the query ends."""
    before = F.lag(x).over(Window.partitionBy(by).orderBy(order))
    return require(df.withColumn("__before", before), F.col("__before").isNull() | (F.col(x) > F.col("__before")), f"{x} must rise strictly").drop("__before")


def replay(spark: SparkSession, path: str, iteration: int, lo: list[float], hi: list[float]) -> DataFrame:
    """The stored selection of one iteration, in its order, raw and unit coordinates; the one that is missing follows from the other.

    `path` holds JSON rows iteration, position and theta_raw or theta_unit (arrays of numbers).
    """
    rows = spark.read.schema("iteration int, position int, theta_raw array<double>, theta_unit array<double>").json(path).where(F.col("iteration") == iteration)
    low, high = (F.array(*(F.lit(float(x)) for x in b)) for b in (lo, hi))
    span = lambda i: F.get(high, i) - F.get(low, i)
    raw = F.coalesce("theta_raw", F.transform("theta_unit", lambda u, i: F.get(low, i) + u * span(i)))
    unit = F.coalesce("theta_unit", F.transform("theta_raw", lambda x, i: (x - F.get(low, i)) / span(i)))
    return require(rows.select("iteration", "position", raw.alias("theta_raw"), unit.alias("theta_unit")), F.size("theta_raw") == len(lo), f"a point must have {len(lo)} coordinates").orderBy("position")


def sample(df: DataFrame, by: str, count: int, seed: int) -> DataFrame:
    """`count` rows without replacement, the same ones at every run and partitioning."""
    return df.orderBy(F.xxhash64(F.col(by), F.lit(seed)), by).limit(count).orderBy(by)


def _arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            found = np.load(io.BytesIO(content), allow_pickle=False)
            named = {"array": found} if isinstance(found, np.ndarray) else {k: found[k] for k in found.files}
            for key, value in named.items():
                rows = np.atleast_2d(value.astype(float)) if value.ndim < 3 else value.reshape(len(value), -1).astype(float)
                yield pd.DataFrame({"path": path, "key": key, "row": np.arange(len(rows)), "values": list(rows)})


def arrays(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """NPY and NPZ files as path, key, row, values; the first of `keys` that a file has, where given."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").load(path).select("path", "content")
    df = files.mapInPandas(_arrays, "path string, key string, row long, values array<double>")
    if keys is None:
        return df
    order = F.array_position(F.array(*(F.lit(k) for k in keys)), F.col("key"))
    ranked = df.withColumn("__o", order).where("__o > 0")
    return ranked.withColumn("__least", F.min("__o").over(Window.partitionBy("path"))).where("__o = __least").drop("__o", "__least")


def points(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """Rows of numbers from NPY, NPZ, CSV with a header, whitespace text or Parquet, as `values`."""
    if path.rstrip("/").endswith((".npy", ".npz")):
        return arrays(spark, path, keys).select("values")
    if path.rstrip("/").endswith(".csv"):
        df = spark.read.csv(path, header=True, inferSchema=True)
        return df.select(F.array(*(F.col(c).cast("double") for c in df.columns)).alias("values"))
    if path.rstrip("/").endswith((".txt", ".dat")):
        lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
        return lines.select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("values"))
    return spark.read.parquet(path)


def simulation_tables(spark: SparkSession, root: str, factor: float = 1.0) -> DataFrame:
    """Text tables <root>/<id>/*.txt of k and power as simulation, k, power * factor; k must rise in each file, else the query ends."""
    lines = spark.read.option("wholetext", True).text(f"{root}/*/*.txt").select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", r"\r$", ""))).where(~F.col("line").rlike("^(#|$)"))
    parts = F.split("line", r"\s+")
    lines = rising(lines.withColumn("k", parts[0].cast("double")), "file", "at", "k")
    return lines.select(F.regexp_extract("file", "/([^/]+)/[^/]+$", 1).alias("simulation"), "k", (parts[1].cast("double") * factor).alias("power"))


def registry(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """A CSV registry; of several rows with one key the last by `order` counts."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__r")).select(key, *(F.col(f"__r.{c}").alias(c) for c in columns))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """JSON cases (id, weight, timeout, ...): ids unique, weights and time limits positive."""
    df = require(spark.read.json(path, multiLine=True), (F.col("weight") > 0) & (F.col("timeout") > 0), "weight and timeout must be positive")
    twice = df.groupBy("id").agg(F.count("*").alias("__n"))
    return require(df.join(twice, "id"), F.col("__n") == 1, "case ids must be unique").drop("__n")


def covers(source: DataFrame, target: DataFrame, k: str, rtol: float = 1e-6) -> DataFrame:
    """One row: whether the source's axis reaches over the target's."""
    lo_hi = lambda df, n: df.agg(F.min(k).alias(f"{n}_lo"), F.max(k).alias(f"{n}_hi"))
    return lo_hi(source, "s").crossJoin(lo_hi(target, "t")).select(((F.col("s_lo") <= F.col("t_lo") * (1 + rtol)) & (F.col("s_hi") >= F.col("t_hi") * (1 - rtol))).alias("covers"))


class Catalog:
    """Named sources: a name gives a DataFrame, made by the function registered for it."""

    def __init__(self) -> None:
        self._made: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def register(self, name: str, make: Callable[[SparkSession], DataFrame]) -> None:
        self._made[name.lower()] = make

    def resolve(self, spark: SparkSession, name: str) -> DataFrame:
        if name.lower() not in self._made:
            raise KeyError(f"no source {name}; there are {', '.join(sorted(self._made))}")
        return self._made[name.lower()](spark)


class Extensions:
    """Named steps DataFrame -> DataFrame, applied in the order in which they were registered."""

    def __init__(self) -> None:
        self._steps: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, step: Callable[[DataFrame], DataFrame]) -> None:
        self._steps[name] = step

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self._steps.values():
            df = df.transform(step)
        return df
