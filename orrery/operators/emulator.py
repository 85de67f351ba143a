"""The emulator: log spectra as components, a Gaussian process with fitted length scales for each, spectra back through both.

One task fits one component on the whole design, side by side; points to predict are scored in batches against the
fitted models, of which there are as many as components. A design of more than MOST_FIT points is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import models

#: Each step of a fit factors the kernel matrix once, so its time grows with the cube of this.
MOST_FIT = 2048
STEPS, RATE = 120, 0.08
LEAST_LOG, MOST_LOG = np.log(1e-2), np.log(1e2)


def likelihood(x: np.ndarray, y: np.ndarray, logs: np.ndarray) -> tuple[float, np.ndarray]:
    """Log marginal likelihood and its gradient by logs: a length for each dimension, variance, noise."""
    lengths, variance, noise = np.exp(logs[:-2]), np.exp(logs[-2]), np.exp(logs[-1])
    apart = [(x[:, None, i] - x[None, :, i]) ** 2 / lengths[i] ** 2 for i in range(x.shape[1])]
    kernel = variance * np.exp(-0.5 * sum(apart))
    factor = np.linalg.cholesky(kernel + noise * np.eye(len(x)))
    half = np.linalg.solve(factor, np.eye(len(x)))
    inverse = half.T @ half
    alpha = inverse @ y
    value = -0.5 * y @ alpha - np.log(np.diag(factor)).sum() - 0.5 * len(x) * np.log(2 * np.pi)
    w = 0.5 * (np.outer(alpha, alpha) - inverse)
    return float(value), np.array([*((w * kernel * a).sum() for a in apart), (w * kernel).sum(), noise * np.trace(w)])


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The best logs met on STEPS steps up the gradient, each of a size that its running moments set."""
    logs = np.append(np.log(np.maximum(x.std(axis=0), 1e-2)), [0.0, np.log(1e-3)])
    mean, square, best = np.zeros(len(logs)), np.zeros(len(logs)), (-np.inf, logs)
    low = np.append(np.full(len(logs) - 1, LEAST_LOG), np.log(1e-6))
    for step in range(1, STEPS + 1):
        value, gradient = likelihood(x, y, logs)
        if value > best[0]:
            best = value, logs
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient**2 - square)
        logs = np.clip(logs + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-12), low, MOST_LOG)
    return best[1]


def fit_components(design: DataFrame, scores: DataFrame, sample: str) -> DataFrame:
    """`design` (sample, u) and `scores` (sample, pc, score): for each component its design, weights, lengths, variance, noise and scale."""
    held = design.count()
    if held > MOST_FIT:
        raise ValueError(f"a design of {held} points is beyond the {MOST_FIT} that a fit takes")

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(sample)
        x, y = np.stack(rows["u"].to_numpy()), rows["score"].to_numpy()
        mean, std = y.mean(), y.std() or 1.0
        logs = fit(x, (y - mean) / std)
        lengths, variance, noise = np.exp(logs[:-2]), float(np.exp(logs[-2])), float(np.exp(logs[-1]))
        matrix = models._kernel(x, x, lengths, variance) + noise * np.eye(len(x))
        alpha = np.linalg.solve(matrix, (y - mean) / std)
        return pd.DataFrame({"pc": [int(rows["pc"].iloc[0])], "x": [x.ravel().tolist()], "alpha": [alpha.tolist()], "lengths": [lengths.tolist()], "variance": [variance], "noise": [noise], "mean": [mean], "std": [std]})

    shape = "pc int, x array<double>, alpha array<double>, lengths array<double>, variance double, noise double, mean double, std double"
    return scores.join(design.select(sample, "u"), sample).groupBy("pc").applyInPandas(learn, shape)


def predict_scores(fitted: DataFrame, queries: DataFrame) -> DataFrame:
    """id, pc, score and its variance for each query (id, u): a product of its kernel row with the weights, and what the design leaves open."""
    rows = fitted.orderBy("pc").toPandas()  # a row for each component

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors: dict = {}
        for b in batches:
            if not len(b):
                continue
            for m in rows.itertuples(index=False):
                if m.pc not in factors:
                    factors[m.pc] = models._Factor(np.array(m.x).reshape(-1, len(m.lengths)), np.array(m.lengths), m.variance, m.noise)
                factor = factors[m.pc]
                for part, u in models._pieces(b["u"].to_numpy()):
                    half = factor.at(u)
                    left = np.maximum(m.variance - (half * half).sum(axis=0), 0)
                    got = factor.kernel(u, factor.x) @ np.array(m.alpha)
                    yield pd.DataFrame({"id": b["id"].to_numpy()[part], "pc": np.int32(m.pc), "score": m.mean + m.std * got, "variance": m.std**2 * left})

    return queries.select(F.col("id").cast("long"), "u").mapInPandas(score, "id long, pc int, score double, variance double")


def emulate(facts: DataFrame, design: DataFrame, queries: DataFrame, sample: str, axis: str, value: str, k: int, deviations: bool = False) -> DataFrame:
    """id, axis and value: spectra at the queries, from log spectra of the design's samples in `facts`.

    `deviations` adds deviation, that of the log spectrum at each point (components are independent, so their variances add with squared
    loadings), and component_deviation, the root mean square over the query's components."""
    own = facts.join(design.select(sample), sample, "left_semi")
    loadings = models.principal_components(own, sample, axis, value, k)
    fitted = fit_components(design, models.scores(own, loadings, sample, axis, value), sample)
    mean = own.groupBy(F.col(axis).cast("double").alias("axis")).agg(F.avg(value).alias("m"))
    parts = predict_scores(fitted, queries).join(F.broadcast(loadings.select("pc", "axis", "loading")), "pc")
    sums = [F.sum(F.col("score") * F.col("loading")).alias("s"), F.sum(F.col("variance") * F.col("loading") * F.col("loading")).alias("v"), F.avg("variance").alias("c")]
    total = parts.groupBy("id", "axis").agg(*sums).join(F.broadcast(mean), "axis")
    more = [F.sqrt("v").alias("deviation"), F.sqrt("c").alias("component_deviation")] if deviations else []
    return total.select("id", "axis", F.exp(F.col("m") + F.col("s")).alias("value"), *more)


def anchored(spectra: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """Predicted ratios (value) times the anchor of the same `by` (axis, or id and axis); a row without an anchor is an error."""
    both = spectra.join(anchors.select(*by, F.col("anchor").alias("__anchor")), by, "left")
    held = F.coalesce(F.col("__anchor"), F.raise_error(F.lit("a predicted ratio has no anchor")).cast("double"))
    return both.withColumn("value", F.col("value") * held).drop("__anchor")
