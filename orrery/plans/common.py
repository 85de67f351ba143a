"""What the plans share: the facts that the driver's tables stand in for, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.axis import band_of
from orrery.functions.targets import relative_error

# Band edges along p_size, as low, mid, focus_high and tail.
EDGES, BANDS = [5.0, 20.0, 35.0], ["low", "mid", "focus_high", "tail"]
BAND_SQL = "CASE WHEN k < 5 THEN 'low' WHEN k < 20 THEN 'mid' WHEN k < 35 THEN 'focus_high' ELSE 'tail' END"
FACTS_SQL = f"""facts AS (
    SELECT *, {BAND_SQL} AS band FROM (
        SELECT l_suppkey AS sample, p_size AS k, l_extendedprice AS truth, l_quantity * p_retailprice AS pred,
               abs(l_quantity * p_retailprice - l_extendedprice) / greatest(l_extendedprice, 1e-30) AS err
        FROM lineitem JOIN part ON l_partkey = p_partkey))"""
#: Vectors scaled to the unit cube by the bounds of all dimensions together, an id, a label and a value for each.
POINTS_SQL = """points AS (
    SELECT vec_id AS id, label, list_transform(embedding[1:5], lambda x: least(greatest((CAST(x AS DOUBLE) + 0.6) / 1.2, 0.0), 1.0)) AS u
    FROM embeddings)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a number of decimals: sums of floats differ in their last digits with their order."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and prediction of each sample at each k, with the relative error and the band of k."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    both = item.join(part, item["l_partkey"] == part["p_partkey"])
    rows = both.select(F.col("l_suppkey").alias("sample"), F.col("p_size").alias("k"), F.col("l_extendedprice").alias("truth"), (F.col("l_quantity") * F.col("p_retailprice")).alias("pred"))
    return rows.withColumn("err", relative_error(F.col("pred"), F.col("truth"))).withColumn("band", band_of(F.col("k"), EDGES, BANDS))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five coordinates of each vector in the unit cube of a fixed box."""
    clip = lambda x: F.least(F.greatest((x.cast("double") + 0.6) / 1.2, F.lit(0.0)), F.lit(1.0))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform(F.slice("embedding", 1, 5), clip).alias("u"))


def r6(x: Column) -> Column:
    return F.round(x, 6)
