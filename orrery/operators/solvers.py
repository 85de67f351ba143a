"""Greedy and iterative choices: diverse batches, farthest points, relaxation, weight updates, active learning.

Greedy steps depend on each other, so each step is one small aggregate over the distributed candidates with the
chosen points as literals; steps are as many as points chosen, never as many as candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.box import distance
from orrery.functions.targets import synthetic_log_power
from orrery.operators.lineage import checkpointed
from orrery.operators.models import gp_predict

#: Choices after which what is left is written.
WRITTEN = 8


def _point(u) -> Column:
    return F.array(*(F.lit(float(x)) for x in u))


def farthest_points(points: DataFrame, count: int) -> DataFrame:
    """Starting at the least id, again and again the point farthest from all chosen: order, id."""
    first = points.orderBy("id").select("id", "u").first()
    chosen, near = [first], None
    for _ in range(count - 1):
        d = distance(F.col("u"), _point(chosen[-1]["u"]))
        near = points.select("id", "u", d.alias("near")) if near is None else near.select("id", "u", F.least("near", d).alias("near"))
        # Distances are written now and then: an expression that only grows would be planned and computed anew for each point.
        near = checkpointed(near) if len(chosen) % WRITTEN == 0 else near
        best = near.agg(F.max_by(F.struct("id", "u"), F.struct(F.round("near", 12), -F.col("id"))).alias("b")).first()["b"]
        chosen.append(best)
    return points.sparkSession.createDataFrame([(i, r["id"]) for i, r in enumerate(chosen)], "rank int, id long")


def diverse_batch(points: DataFrame, count: int, weight: float, guard: float = 0.02, cap: float = 0.5) -> DataFrame:
    """Greedy batch of points (id, u, score): largest (1 - weight) score + weight * distance to the chosen, few at the boundary."""
    quota = int(cap * count)
    near = points.select("id", "u", "score", (F.array_min(F.transform("u", lambda x: F.least(x, 1 - x))) < guard).alias("edge"), F.lit(1.0).alias("near"))
    chosen, edges, written = [], 0, 0
    for _ in range(count):
        left = near.where(~F.col("id").isin([r["id"] for r in chosen[written:]])) if chosen[written:] else near
        left = left.where("not edge") if edges >= quota else left
        key = F.struct(F.round((1 - weight) * F.col("score") + weight * F.col("near"), 12), -F.col("id"))
        best = left.agg(F.max_by(F.struct("id", "u", "edge"), key).alias("b")).first()["b"]
        if best is None:
            break
        chosen.append(best)
        edges += best["edge"]
        near = near.withColumn("near", F.least("near", distance(F.col("u"), _point(best["u"]))))
        if len(chosen) % WRITTEN == 0:
            near, written = checkpointed(near.where(~F.col("id").isin([r["id"] for r in chosen[written:]]))), len(chosen)
    return points.sparkSession.createDataFrame([(i, r["id"]) for i, r in enumerate(chosen)], "rank int, id long")


def greedy_dedup(ranking: DataFrame, count: int, tolerance: float) -> DataFrame:
    """In the order of rn (a number or a struct), points farther than the tolerance from all accepted before, until there are `count`."""
    accepted: list = []
    left = ranking.select("rn", "id", "u")
    while len(accepted) < count:
        best = left.agg(F.min(F.struct("rn", "id", "u")).alias("b")).first()["b"]
        if best is None:
            raise ValueError(f"only {len(accepted)} of {count} points are apart by more than {tolerance}")
        accepted.append(best)
        left = left.where(distance(F.col("u"), _point(best["u"])) > tolerance)
        left = checkpointed(left) if len(accepted) % WRITTEN == 0 else left
    return ranking.sparkSession.createDataFrame([(i, r["id"]) for i, r in enumerate(accepted)], "rank int, id long")


def relax(designs: DataFrame, boundary: str = "periodic", exponent: float = 2.0, soft: float = 0.05, steps: int = 60, step: float = 0.02) -> DataFrame:
    """Points of each design (design, id, u) pushed apart on a torus or in a reflecting cube; a step that raises the energy is halved."""

    def push(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        x, size = np.stack(rows["u"]), step

        def look(x):
            d = x[:, None] - x[None]
            if boundary == "periodic":
                d -= np.round(d)
            r2 = (d * d).sum(axis=2) + soft * soft
            np.fill_diagonal(r2, np.inf)
            return (r2 ** (-exponent / 2)).sum() / 2, (d * (r2 ** (-exponent / 2 - 1))[:, :, None]).sum(axis=1)

        energy, force = look(x)
        for _ in range(steps):
            move = x + size * force / max(np.abs(force).max(), 1e-12)
            move = move % 1.0 if boundary == "periodic" else 1 - np.abs(1 - np.abs(move))
            new, new_force = look(move)
            if new < energy:
                x, energy, force = move, new, new_force
            else:
                size /= 2
        return pd.DataFrame({"design": rows["design"], "id": rows["id"], "u": list(x), "energy": energy})

    return designs.select("design", "id", "u").groupBy("design").applyInPandas(push, "design long, id long, u array<double>, energy double")


def balanced_weights(errors: DataFrame, error: str, previous: str, gamma: float, rho: float, least: float, most: float) -> DataFrame:
    """Weights moved towards error^gamma (mean 1) by a share rho, clipped and scaled to mean 1, twice."""
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    power = F.pow(F.greatest(F.col(error), F.lit(1e-12)), F.lit(gamma))
    out = errors.withColumn("__t", power).withColumn("__t", F.col("__t") / F.avg("__t").over(everything))
    out = out.withColumn("weight", (1 - rho) * F.col(previous) + rho * F.col("__t"))
    for _ in range(2):
        out = out.withColumn("weight", F.least(F.greatest("weight", F.lit(least)), F.lit(most)))
        out = out.withColumn("weight", F.col("weight") / F.avg("weight").over(everything))
    return out.drop("__t")


def active_learning(pool: DataFrame, seed: DataFrame, rounds: int, batch: int, k: float = 0.3, lengths: tuple[float, ...] = (0.7,) * 5) -> DataFrame:
    """Label, fit, take the most uncertain points of the pool, append, again: one row for each round with its error on the whole pool."""
    label = lambda df: df.select("id", "u", synthetic_log_power([F.get("u", F.lit(i)) for i in range(5)], F.lit(k)).alias("y"))
    truth, chosen, history = label(pool), label(seed), []
    spark = pool.sparkSession
    for number in range(rounds + 1):
        known = chosen.collect()  # the design: tens of points
        chosen = spark.createDataFrame(known, chosen.schema)
        predicted = gp_predict(chosen, pool, list(lengths)).join(truth.select("id", "y"), "id")
        error = predicted.agg(F.percentile(F.abs(F.exp(F.col("mean") - F.col("y")) - 1), F.lit(0.68)).alias("p68")).first()["p68"]
        history.append((number, len(known), error))
        if number < rounds:
            ids = [r["id"] for r in known]
            best = predicted.where(~F.col("id").isin(ids)).orderBy(F.desc(F.round("std", 9)), "id").limit(batch).select("id")
            chosen = chosen.unionByName(truth.join(F.broadcast(best), "id"))
    return spark.createDataFrame(history, "round int, training_points int, p68 double")


