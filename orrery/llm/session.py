"""Helpers about the running session that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's `spark.checkpoint.dir`; where it is unset, a folder of this machine in local mode alone, else one in the shared warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] == "local":
            named = tempfile.mkdtemp(prefix="orrery-checkpoint-")
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/orrery-checkpoint")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from the copy there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder, columns packed, and continue from it."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released() -> None:
    """Gives memory that this Python process no longer uses back to its machine; called at the end of a task."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """`df`, a written table, with the hint to broadcast it if it has no more than most_rows rows."""
    return F.broadcast(df) if df.count() <= most_rows else df


def join_hot(rows: DataFrame, table: DataFrame, key: str, most_rows: int = 200_000, shares: int = 2048) -> DataFrame:
    """Left join of `rows` with `table`, written and with one row for each key, where many rows may share one key.

    A table of up to most_rows rows is broadcast. Of a larger one, keys that more than a `shares`-th of all rows have, at most
    `shares` of them, are broadcast; their rows keep out of the shuffle's partition of that key under keys of their own.
    """
    if table.count() <= most_rows:
        return rows.join(F.broadcast(table), key, "left")
    counts = rows.groupBy(key).agg(F.count("*").alias("__n"))
    limit = rows.count() // shares + 1
    hot = checkpointed(table.join(counts.where(F.col("__n") > limit).select(key), key, "left_semi"))
    others = [c for c in table.columns if c != key]
    near = hot.select(F.col(key).alias("__hot"), *(F.col(c).alias(f"__hot_{c}") for c in others))
    far = table.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__far_{c}") for c in others))
    both = rows.join(F.broadcast(near), F.col(key) == F.col("__hot"), "left")
    # A random part of a hot row's key only says where it goes.
    dealt = both.withColumn("__deal", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(shares))))
    both = dealt.join(far.withColumn("__deal_far", F.lit(0).cast("long")), (F.col(key) == F.col("__key")) & (F.col("__deal") == F.col("__deal_far")), "left")
    return both.select(*rows.columns, *(F.coalesce(f"__hot_{c}", f"__far_{c}").alias(c) for c in others))


def packed(df: DataFrame, *more: Column, without: tuple[str, ...] = ()) -> DataFrame:
    """The caller's columns in one struct `row`, whatever their names, with more columns beside it."""
    return df.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in without)).alias("row"), *more)


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that `row` holds."""
    return df.select(*(F.col("row").getField(c).alias(c) for c in columns))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_or_null(df: DataFrame, name: str, kind: str):
    """The column cast to `kind`, or typed nulls where the table has none of that name."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)
