"""The accumulator as a stream: sums of each group kept as state, files taken as they come, resumed from a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.metrics import accumulate


def accumulator_stream(spark: SparkSession, folder: str, schema, by: list[str], x: str, files_per_batch: int = 1) -> DataFrame:
    """Sum, sum of squares and count of each group over a folder of Parquet files."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return accumulate(rows, by, x)


def run_available(states: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Take all that is there now; each batch replaces the table of states under `sink`. A restart continues."""

    def replace(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(sink)

    return states.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(replace).start()


def windowed_rates(events: DataFrame, at: str, kind: str, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each kind in each window, late ones included up to the watermark."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"))
