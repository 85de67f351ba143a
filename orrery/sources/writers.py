"""Sinks: role-partitioned designs, logs, summaries, reports, versioned states, content-addressed tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_designs(points: DataFrame, path: str, force: bool = False) -> None:
    """Points by role; an existing table is only replaced with `force`."""
    points.write.partitionBy("role").mode("overwrite" if force else "errorifexists").parquet(path)


def append_progress(events: DataFrame, path: str) -> None:
    """One JSON line for each event, stamped in UTC."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    events.withColumn("time_utc", stamp).write.mode("append").json(path)


def write_summary(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def write_union(tables: list[DataFrame], path: str) -> None:
    """One CSV of tables whose columns differ, in alphabetical order of their columns."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    whole.select(*sorted(whole.columns)).write.mode("overwrite").csv(path, header=True)


def latex_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of a LaTeX table body."""
    escaped = (F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([&%$#_])", r"\\$1") for c in columns)
    return rows.select(F.concat(F.concat_ws(" & ", *escaped), F.lit(r" \\")).alias("value"))


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |")).alias("value"))


def write_state(states: DataFrame, root: str, version: int) -> None:
    """A new version of a state; readers take the latest whole one."""
    states.write.mode("errorifexists").parquet(f"{root}/version={version:012d}")


def latest_state(spark: SparkSession, root: str) -> DataFrame:
    df = spark.read.parquet(root)
    newest = F.broadcast(df.agg(F.max("version").alias("version")))
    return df.join(newest, "version")


def digest(keys: dict) -> str:
    """A short name for settings: equal settings, equal name."""
    import hashlib

    return hashlib.sha256(json.dumps(keys, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, keys: dict, make) -> tuple[DataFrame, str]:
    """The table made for exactly these settings: read (`hit`), or made once and kept (`missing`)."""
    path = f"{root}/{digest(keys)}"
    try:
        return spark.read.parquet(path), "hit"
    except AnalysisException:
        make(spark).write.mode("ignore").parquet(path)
        return spark.read.parquet(path), "missing"


def refreshed(spark: SparkSession, root: str, settings: dict, parts: DataFrame, build) -> tuple[DataFrame, str, list[str]]:
    """A table kept in parts, of which only those whose inputs changed are made again.

    `parts` (part, fingerprint) says what each part is made from; `build` gives the rows, with their part, of the parts it is handed.
    The manifest has each part's fingerprint and the version that holds it, and the settings. Compared with it the table is a
    `hit`, `stale` (some parts are new, changed or gone, or any setting differs, which makes all anew) or `missing`.
    Rows are written first and the new manifest last, under one name in one step, so a reader or a lost job finds the old table or the new one.
    Returns the table, its state, and which settings differ."""
    try:
        last = latest_state(spark, f"{root}/manifest").select("part", "fingerprint", "held", "settings", "version")
        facts = last.agg(F.max("version").alias("version"), F.first("settings").alias("settings")).first()
        version, before = facts["version"], json.loads(facts["settings"])
    except AnalysisException:
        last, version, before = None, -1, None
    now = json.loads(json.dumps(settings, sort_keys=True, default=str))
    changed = [] if before is None else sorted(k for k in {*now, *before} if now.get(k) != before.get(k) or (k in now) != (k in before))
    known = spark.createDataFrame([], "part string, known string, held int") if last is None or changed else last.where("part is not null").select("part", F.col("fingerprint").alias("known"), "held")
    both = parts.select(F.col("part").cast("string"), F.col("fingerprint").cast("string")).join(known, "part", "full")
    fresh = F.coalesce(F.col("fingerprint") == F.col("known"), F.lit(False))
    todo = both.where(F.col("fingerprint").isNotNull() & ~fresh)
    if last is not None and not changed and both.where(~fresh).isEmpty():
        state = "hit"
    else:
        state, version = "missing" if last is None else "stale", version + 1
        build(todo.select("part")).withColumn("part", F.col("part").cast("string")).write.mode("overwrite").parquet(f"{root}/rows/held={version:d}")
        mark = spark.createDataFrame([(None, None, version)], "part string, fingerprint string, held int")
        whole = both.where("fingerprint is not null").select("part", "fingerprint", F.when(fresh, F.col("held")).otherwise(version).cast("int").alias("held")).unionAll(mark)
        write_state(whole.withColumn("settings", F.lit(json.dumps(now, sort_keys=True))), f"{root}/manifest", version)
        last = latest_state(spark, f"{root}/manifest")
    kept = last.where("part is not null").select(F.col("part").alias("__part"), F.col("held").cast("int").alias("__held"))
    rows = spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows")
    return rows.join(kept, (F.col("part") == F.col("__part")) & (F.col("held").cast("int") == F.col("__held")), "left_semi").drop("held"), state, changed


def write_report(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """A run's report: each table in a folder of its own, and a manifest of their rows, columns and an order-free digest."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        kept = spark.read.parquet(f"{path}/{name}")
        facts = kept.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*kept.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).first()
        rows.append((name, facts["rows"], kept.schema.simpleString(), facts["digest"]))
    manifest = spark.createDataFrame(rows, "name string, rows long, columns string, digest string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def write_bias_field(field: DataFrame, path: str, usable: int = 10, confident: int = 20) -> DataFrame:
    """The bias field (id, mean, std, se, n), its density (mean's share, 0 where unsupported) and its support, as one report."""
    total = field.where(F.col("n") >= usable).agg(F.sum(F.greatest("mean", F.lit(0.0))).alias("__t"))
    density = field.crossJoin(F.broadcast(total)).select("id", F.coalesce(F.when(F.col("n") >= usable, F.greatest("mean", F.lit(0.0)) / F.col("__t")), F.lit(0.0)).alias("density"))
    support = field.agg(F.count("*").alias("points"), F.count_if(F.col("n") >= usable).alias("usable"), F.count_if(F.col("n") >= confident).alias("high_confidence"), F.count("mean").alias("finite"))
    return write_report({"field": field, "density": density, "support": support}, path)


def write_evaluation(facts: DataFrame, path: str, k: str, truth: str, predicted: str) -> DataFrame:
    """An evaluation's payload: the facts with signed relative bias, and its mean and spread at each k, as one report."""
    rows = facts.withColumn("signed_relative_bias", F.col(predicted) / F.col(truth) - 1)
    curve = rows.groupBy(k).agg(F.count("*").alias("n"), F.avg("signed_relative_bias").alias("mean"), F.stddev_pop("signed_relative_bias").alias("std"))
    return write_report({"facts": rows, "curve": curve}, path)
