"""State, history, text and grading queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orrery.operators import metrics as m
from orrery.operators import progress, textops
from orrery.plans.common import rounded, table
from orrery.plans.metric_plans import query
from orrery.streaming.accumulate import accumulator_stream, run_available

_ACC = "SELECT user_id % 50 AS ref, count(value) AS n, round(avg(value), 6) AS mean, round(CASE WHEN count(value) = 1 THEN 0.0 ELSE stddev_samp(value) END, 6) AS std, round(CASE WHEN count(value) = 1 THEN 0.0 ELSE stddev_samp(value) END / sqrt(count(value)), 6) AS se, count(value) >= 10 AS usable, count(value) >= 20 AS high_confidence FROM events GROUP BY 1"


@query(_ACC)
def bias_accumulator(spark, d):
    """Partial sums of each part, merged."""
    rows = table(spark, d, "events").select((F.col("user_id") % 50).alias("ref"), F.col("event_type").alias("part"), "value")
    states = m.merge(m.accumulate(rows, ["ref", "part"], "value"), ["ref"])
    return rounded(m.estimate(states).select("ref", "n", "mean", "std", "se", "usable", "high_confidence"))


@query(_ACC)
def bias_accumulator_stream(spark, d):
    """The same from a stream of files, through the state store."""
    rows = table(spark, d, "events")
    base = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/streams"
    folder = f"{base}/accumulator-{uuid.uuid4().hex}"
    rows.select((F.col("user_id") % 50).alias("ref"), "value").repartition(4).write.parquet(f"{folder}/in")
    stream = accumulator_stream(spark, f"{folder}/in", "ref long, value double", ["ref"], "value", files_per_batch=2)
    run_available(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    states = spark.read.parquet(f"{folder}/out")
    return rounded(m.estimate(states).select("ref", "n", "mean", "std", "se", "usable", "high_confidence"))


_DENSITY = "b AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice - 1000 END AS x FROM part)"


@query(f"WITH {_DENSITY}, f AS (SELECT p_partkey, coalesce(x, (SELECT median(x) FROM b)) AS x FROM b), c AS (SELECT quantile_cont(x, 0.95) AS cap FROM f), m AS (SELECT p_partkey, pow(greatest(least(x, cap), 0.0) + 1e-12, 0.5) AS m FROM f, c) SELECT p_partkey, round(m / sum(m) OVER (), 9) AS density FROM m")
def bias_density(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice") - 1000).alias("x"))
    return m.density_from(part, "x", 0.5, "density").select("p_partkey", F.round("density", 9).alias("density"))


@query("SELECT event_type, min(ts) AS first, max(ts) AS last, count(*) AS updates, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS micros FROM events GROUP BY event_type")
def stage_durations(spark, d):
    return progress.stage_durations(table(spark, d, "events"), "event_type", "ts")


@query("WITH r AS (SELECT DISTINCT l_orderkey AS run, l_linenumber AS round FROM lineitem WHERE l_linenumber >= 1), n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round) AS rn FROM r) SELECT run, round FROM n WHERE rn = round")
def resume_islands(spark, d):
    return progress.resumable(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("round")), "run", "round")


_ROUNDS = "r AS (SELECT l_suppkey % 10 AS run, l_linenumber AS round, count(*) AS selected, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)"


def _rounds(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 10).alias("run"), F.col("l_linenumber").alias("round")).agg(F.count("*").alias("selected"), F.avg("l_extendedprice").alias("value"))


@query(f"WITH {_ROUNDS} SELECT run, round, CAST(32 + sum(selected) OVER (PARTITION BY run ORDER BY round) - selected AS BIGINT) AS size_before, CAST(32 + sum(selected) OVER (PARTITION BY run ORDER BY round) AS BIGINT) AS size_after FROM r")
def running_train_size(spark, d):
    return progress.running_sizes(_rounds(spark, d), "run", "round", "selected", 32).select("run", "round", "size_before", "size_after")


@query(f"WITH {_ROUNDS} SELECT run, round, round((lag(value) OVER o - value) / (round - lag(round) OVER o), 6) AS gain, round(abs(value - lag(value) OVER o) / greatest(abs(lag(value) OVER o), 1e-30), 6) AS change FROM r WINDOW o AS (PARTITION BY run ORDER BY round)")
def marginal_gain(spark, d):
    both = progress.relative_change(progress.marginal_gain(_rounds(spark, d), "run", "round", "value"), "run", "round", "value")
    return rounded(both.select("run", "round", "gain", "change"))


@query(f"WITH {_ROUNDS}, b AS (SELECT *, min(value) OVER (PARTITION BY run ORDER BY round) AS best, first_value(value) OVER (PARTITION BY run ORDER BY round) AS f FROM r) SELECT run, round, round(best, 6) AS best, round(1.0 - best / greatest(f, 1e-300), 6) AS improvement, coalesce((lag(best) OVER o - best) / greatest(lag(best) OVER o, 1e-300) < 0.001, false) AS converged FROM b WINDOW o AS (PARTITION BY run ORDER BY round)")
def convergence_history(spark, d):
    out = progress.best_so_far(_rounds(spark, d), "run", "round", "value", 0.001)
    return rounded(out.select("run", "round", "best", "improvement", "converged"))


@query("SELECT d.lang, round(sum(quality * (1 + toxic)) / sum(1 + toxic), 6) AS score, round(avg(CASE WHEN quality >= 1 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang")
def harness_summary(spark, d):
    labels = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    graded = labels.select("lang", F.col("quality").cast("double").alias("score"), (1 + F.col("toxic")).alias("weight"))
    return rounded(textops.summarize(graded, "lang", "score", "weight"))


@query("WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nxt FROM conversations) SELECT conv_id, turn, CASE WHEN trim(text, ' ') = trim(nxt, ' ') THEN 1.0 ELSE 0.0 END AS exact, CASE WHEN contains(text, left(nxt, 4)) THEN 1.0 ELSE 0.0 END AS contains, CASE WHEN regexp_matches(text, '[0-9]+') THEN 1.0 ELSE 0.0 END AS regex, round(greatest(0.0, 1.0 - abs(length(text) - coalesce(length(nxt), length(text) + 1000)) / 100.0), 6) AS numeric FROM c")
def graders(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations").withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    g = textops.grade
    far = F.coalesce(F.length("nxt"), F.length("text") + 1000).cast("string")
    text, nxt = F.col("text"), F.col("nxt")
    return rounded(c.select("conv_id", "turn", g("exact", text, nxt).alias("exact"), g("contains", text, F.left(nxt, F.lit(4))).alias("contains"), g("regex", text, F.lit("[0-9]+")).alias("regex"), g("numeric_abs_error", F.length("text").cast("string"), far, 100.0).alias("numeric")))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+ing\b')) AS ings, len(regexp_extract_all(text, '[0-9]+(\.[0-9]+)?')) AS numbers, length(text) - length(regexp_replace(text, '[\x{4e00}-\x{9fff}]', '', 'g')) AS han FROM documents")
def regex_counts(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, d, "documents").select("doc_id", n(r"[A-Za-z]+ing\b").alias("ings"), n(r"[0-9]+(\.[0-9]+)?").alias("numbers"), textops.han_count(F.col("text")).cast("long").alias("han"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos FROM documents), k AS (SELECT *, CASE WHEN trim(line, ' ') = '' THEN NULL WHEN starts_with(line, '#') THEN 'heading' WHEN starts_with(line, '>') THEN 'blockquote' WHEN contains(line, '|') THEN 'table' WHEN starts_with(line, '\\[') THEN 'display_math' ELSE 'paragraph' END AS kind FROM l)".replace("'\\\\['", "'\\['")


@query(f"WITH {_LINES}, s AS (SELECT *, sum(CASE WHEN kind IS NOT NULL AND lag_kind IS DISTINCT FROM kind THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS lag_kind FROM k)) SELECT doc_id, CAST(block AS BIGINT) AS block, any_value(kind) AS kind, CAST(min(pos) AS INTEGER) AS first_line, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, left(regexp_replace(string_agg(line, ' ' ORDER BY pos), '\\s+', ' ', 'g'), 160) AS preview FROM s WHERE kind IS NOT NULL GROUP BY doc_id, block")
def block_scanner(spark, d):
    return textops.blocks(table(spark, d, "documents"))


@query("WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark), a AS (SELECT word, count(*) AS a FROM w WHERE item_id % 2 = 0 GROUP BY word), b AS (SELECT word, count(*) AS b FROM w WHERE item_id % 2 = 1 GROUP BY word) SELECT word, a - coalesce(b, 0) AS missing FROM a LEFT JOIN b USING (word) WHERE a > coalesce(b, 0)")
def multiset_missing(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("word"))
    return textops.multiset_missing(w.where("item_id % 2 = 0"), w.where("item_id % 2 = 1"), ["word"])


@query("SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier")
def slugify(spark, d):
    from orrery.functions.targets import slug

    return table(spark, d, "supplier").select("s_suppkey", slug(F.col("s_name")).alias("slug"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS asked, round(avg(length(text)), 6) AS mean_chars, arg_max(role, {'t': turn, 'r': role}) AS last_role FROM conversations GROUP BY conv_id")
def conversation_profile(spark, d):
    c = table(spark, d, "conversations")
    return rounded(c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.avg(F.length("text")).alias("mean_chars"), F.max_by("role", F.struct("turn", "role")).alias("last_role")))
