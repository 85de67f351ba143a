"""Intermediate tables that are written once and read back, in the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to `spark.checkpoint.dir`; where that is unset, to a folder of this machine in local mode alone, else into the warehouse."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named:
            local = context.master.split("[")[0] == "local"
            named = tempfile.mkdtemp(prefix="orrery-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/orrery-checkpoint"
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)
