"""Operators on candidates: points in simplices, penalties, embeddings, priorities, bindings, checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.quantiles import running_total


def best_in_simplices(simplices: DataFrame, probes: DataFrame, score: Callable[[Column], Column]) -> DataFrame:
    """`simplices` (simplex, vertices: points in order) and `probes` (probe, weights of the vertices): each simplex's best point, its probe and score.

    Probes are a fixed table of barycentric weights (centre, mid-points, a lattice), so they travel to every task. Ties go to the first probe.
    """
    met = simplices.crossJoin(F.broadcast(probes))
    dims = F.sequence(F.lit(0), F.size(F.get("vertices", F.lit(0))) - 1)
    mix = lambda d: F.aggregate(F.zip_with("vertices", "weights", lambda v, w: F.get(v, d) * w), F.lit(0.0), lambda a, x: a + x)
    scored = met.withColumn("u", F.transform(dims, mix)).withColumn("score", score(F.col("u")))
    best = F.max_by(F.struct("probe", "u", "score"), F.struct("score", -F.col("probe")))
    return scored.groupBy("simplex").agg(best.alias("b")).select("simplex", "b.*")


def lattice(spark, corners: int, steps: int) -> DataFrame:
    """Barycentric weights (probe, weights) of all points of a lattice of `steps` parts in a simplex of so many corners."""

    def parts(left: int, n: int):
        if n == 1:
            yield (left,)
            return
        for i in range(left + 1):
            for rest in parts(left - i, n - 1):
                yield (i, *rest)

    rows = [(i, [w / steps for w in ws]) for i, ws in enumerate(parts(steps, corners))]
    return spark.createDataFrame(rows, "probe long, weights array<double>")


def boundary_penalty(candidates: DataFrame, train: DataFrame, threshold: float, target: float, own_share: float = 0.1) -> DataFrame:
    """How far each candidate would take the share of coordinates near the boundary above its target, and a tenth of its own share."""
    near = F.size(F.filter("u", lambda x: F.least(x, 1 - x) < threshold))
    held = train.agg(F.coalesce(F.sum(near), F.lit(0)).alias("__near"), F.coalesce(F.sum(F.size("u")), F.lit(0)).alias("__all"))
    both = candidates.crossJoin(F.broadcast(held))
    after = (F.col("__near") + near) / F.greatest(F.lit(1), F.col("__all") + F.size("u"))
    return both.withColumn("penalty", F.greatest(after - target, F.lit(0.0)) + own_share * near / F.size("u")).drop("__near", "__all")


def embedding(df: DataFrame, features: list[str], floor: float = 1e-12) -> DataFrame:
    """z_ columns: features less their mean over their population deviation, at least `floor`."""
    facts = df.agg(*(f(c).alias(f"__{n}_{c}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
    out = df.crossJoin(F.broadcast(facts))
    out = out.withColumns({f"z_{c}": (F.col(c) - F.col(f"__mean_{c}")) / F.greatest(F.col(f"__std_{c}"), F.lit(floor)) for c in features})
    return out.drop(*facts.columns)


def scaled_collection(ranking: DataFrame, collection: str, name: str, factor: float) -> DataFrame:
    """Scores of one collection times a factor; the ranking is the order of the new scores."""
    return ranking.withColumn("score", F.when(F.col(collection) == name, F.col("score") * factor).otherwise(F.col("score")))


def primary(results: DataFrame, by: list[str], kind: str, name: str, order: list[str]) -> DataFrame:
    """Of each group the first row by kind in the given order of kinds, then by name; rows of other kinds come last."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(kind)).cast("int"), F.lit(0))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    return results.groupBy(*by).agg(F.min(F.struct(rank.alias("rank"), F.col(name).alias("name")))["name"].alias("primary"))


def center_candidates(rows: DataFrame, p68: str, label: str, overrides: str, baseline: str = "baseline") -> DataFrame:
    """Rows with a number for p68 and a JSON object of overrides that are no baseline."""
    return rows.where(F.expr(f"try_cast({p68} AS double)").isNotNull() & ~F.coalesce(F.contains(F.lower(label), F.lit(baseline)), F.lit(False)) & F.get_json_object(overrides, "$").startswith("{"))


def update_due(iteration: Column, interval: int) -> Column:
    """After the first iteration, every interval-th."""
    return (iteration > 1) & (F.pmod(iteration - 1, F.lit(interval)) == 0)


def bound_anchors(rows: DataFrame, known: DataFrame, keys: list[str], provided: str, name: str) -> DataFrame:
    """The provided anchor of each row, else that of the known row with equal keys; an error where there is neither."""
    match = known.select(*keys, F.col(name).alias("__known")).dropDuplicates(keys)
    return rows.join(match, keys, "left").withColumn(name, F.coalesce(F.col(provided), F.col("__known"), F.raise_error(F.lit("a row has no anchor and equals no known one")).cast("double"))).drop("__known")


def same_prefix(source: DataFrame, reference: DataFrame, position: str, point: str, atol: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each group: n rows of the source, and whether each equals the reference's at its position."""
    both = source.join(reference.select(position, F.col(point).alias("__ref")), position, "left")
    close = F.forall(F.zip_with(point, "__ref", lambda a, b: F.coalesce(F.abs(a - b) <= atol, F.lit(False))), lambda x: x)
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.coalesce(close, F.lit(False))), F.lit(True)).alias("same"))


def basis_model(features: DataFrame, coefficients: DataFrame, anchor: DataFrame) -> DataFrame:
    """anchor(k) exp(sum of coefficient(k, feature) value(id, feature)): a row for each id and k."""
    total = features.join(coefficients, "feature").groupBy("id", "k").agg(F.sum(F.col("coefficient") * F.col("value")).alias("s"))
    return total.join(anchor, "k").select("id", "k", (F.col("anchor") * F.exp("s")).alias("value"))


def dominant(facts: DataFrame, by: str, band: str, x: str) -> DataFrame:
    """For each group: the band with the largest mean, that mean, and the sum of its bands' means; ties go to the first name."""
    per = facts.groupBy(by, band).agg(F.avg(x).alias("m"))
    first = F.min(F.struct((-F.col("m")).alias("m"), F.col(band).alias("b")))
    return per.groupBy(by).agg(first["b"].alias("dominant"), F.max("m").alias("mean"), F.sum("m").alias("total"))


def top_per_band(facts: DataFrame, by: str, band: str, x: str, k: int = 5) -> DataFrame:
    """The k groups with the largest means in each band, with their place."""
    per = facts.groupBy(by, band).agg(F.avg(x).alias("m"))
    place = F.row_number().over(Window.partitionBy(band).orderBy(F.desc("m"), by))
    return per.withColumn("place", place).where(F.col("place") <= k)


def pair_offsets(pairs: DataFrame, design: str) -> DataFrame:
    """Of accepted pairs (design, ref), stored long: how many each design has and where they begin among all, in order of design."""
    counts = pairs.groupBy(design).agg(F.count("*").alias("n"))
    return running_total(counts, design, "n", "__upto").select(design, "n", (F.col("__upto") - F.col("n")).alias("offset"))


def weighted_checks(actual: DataFrame, expected: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """`actual` (name, value) against `expected` (name, value, weight): the checks, those passed and their share of the weight, in one row or one for each group."""
    both = expected.join(actual.select(*by, "name", F.col("value").alias("__got")), [*by, "name"], "left")
    passed = F.coalesce(F.col("value") == F.col("__got"), F.lit(False))
    return both.groupBy(*by).agg(F.count("*").alias("checks"), F.count_if(passed).alias("passed"), (F.sum(F.when(passed, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("score"))
