"""Models of point sets: principal components, Gaussian processes, ridge, acquisition by variance reduction.

Fits are on designs, which mostly have tens to hundreds of points: one task fits one component or one design, and many
of them run side by side. What grows, the points to predict, is scored in Arrow batches against the fitted model.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import components
from orrery.operators.lineage import checkpointed

#: A design larger than this is refused where it is factored whole, never cut: half its kernel matrix (270 MB here) is held by each task.
MOST_POINTS = 8192
#: Designs of more points than this are fitted through the points that span their kernel, see `_spanning`.
FACTORED = 2048
#: Share of the variance that the spanning points may leave unexplained at any point, rows looked at for more of them, rows of one task.
TOLERANCE, ROUND, ROWS = 1e-10, 4096, 8192
#: Rows of the matrix, and points against it, that are worked on together.
BLOCK = 512
#: Probes that are in a task's memory together.
PROBES = 1 << 16


def principal_components(facts: DataFrame, sample: str, axis: str, value: str, k: int, band: str | None = None) -> DataFrame:
    """Loadings (band, pc, axis, loading, explained): one eigenproblem for each band, or one for all, of one covariance state."""
    state = components.state_of(facts, sample, axis, value)
    if band is None:
        return components.layout(state, None, k, 0)
    return components.layout(state, facts.select(F.col(axis).cast("double").alias("axis"), F.col(band).alias("band")).distinct(), 0, k)


def scores(facts: DataFrame, loadings: DataFrame, sample: str, axis: str, value: str) -> DataFrame:
    """Each sample's coordinate on each component: a join on the axis and a sum."""
    mean = facts.groupBy(axis).agg(F.avg(value).alias("m"))
    centred = facts.join(F.broadcast(mean), axis).select(sample, F.col(axis).cast("double").alias("axis"), (F.col(value) - F.col("m")).alias("x"))
    return centred.join(F.broadcast(loadings), "axis").groupBy(sample, "band", "pc").agg(F.sum(F.col("x") * F.col("loading")).alias("score"))


def band_sensitivity(loadings: DataFrame, weights: DataFrame, band_of_axis: str) -> DataFrame:
    """Squared loadings integrated over each band of the axis, as shares of the component. `weights`: axis, w and the band."""
    per = loadings.join(F.broadcast(weights), "axis").groupBy("pc", band_of_axis).agg(F.sum(F.col("loading") * F.col("loading") * F.col("w")).alias("s"))
    total = per.groupBy("pc").agg(F.sum("s").alias("t"))
    return per.join(total, "pc").select("pc", band_of_axis, (F.col("s") / F.col("t")).alias("share"))


def ridge_sums(df: DataFrame, x: list[str], y: str) -> DataFrame:
    """Sums, of squares and products too, that a linear fit needs: one row, whatever the input."""
    cols = [*x, y]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    return df.agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s_{c}") for c in cols), *(F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs))


def fit_ridge(df: DataFrame, x: list[str], y: str, alpha: float = 1.0) -> dict:
    """Ridge on standardised features (population deviation): means, deviations, weights, intercept."""
    r = ridge_sums(df, x, y).first().asDict()
    n = r["n"]
    mean = {c: r[f"s_{c}"] / n for c in [*x, y]}
    std = {c: max((r[f"p_{c}_{c}"] / n - mean[c] ** 2), 0.0) ** 0.5 or 1.0 for c in x}
    order = [*x, y]
    prod = lambda a, b: r[f"p_{a}_{b}"] if f"p_{a}_{b}" in r else r[f"p_{b}_{a}"]
    gram = np.array([[(prod(a, b) - n * mean[a] * mean[b]) / (std[a] * std[b]) for b in x] for a in x])
    rhs = np.array([(prod(a, order[-1]) - n * mean[a] * mean[y]) / std[a] for a in x])
    return {"mean": mean, "std": std, "weights": dict(zip(x, np.linalg.solve(gram + alpha * np.eye(len(x)), rhs), strict=True)), "intercept": mean[y]}


def predict_ridge(df: DataFrame, model: dict, name: str) -> DataFrame:
    out = F.lit(float(model["intercept"]))
    for c, w in model["weights"].items():
        out = out + float(w) * (F.col(c) - float(model["mean"][c])) / float(model["std"][c])
    return df.withColumn(name, out)


def _kernel(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, variance: float) -> np.ndarray:
    a, b = a / lengths, b / lengths
    d2 = sum((a[:, None, i] - b[None, :, i]) ** 2 for i in range(a.shape[1]))
    return variance * np.exp(-0.5 * d2)


class _Factor:
    """The triangular factor of a design's kernel matrix in blocks of rows: half the matrix, and never a second one beside it."""

    def __init__(self, x: np.ndarray, lengths: np.ndarray, variance: float, noise: float):
        self.x, self.lengths, self.variance, self.rows = x, lengths, variance, []
        for lo in range(0, len(x), BLOCK):
            own = x[lo : lo + BLOCK]
            left = self.solve(self._with(own)).T
            pivot = np.linalg.cholesky(self.kernel(own, own) + noise * np.eye(len(own)) - left @ left.T)
            self.rows.append((left, np.linalg.inv(pivot)))

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _kernel(a, b, self.lengths, self.variance)

    def _with(self, points: np.ndarray) -> np.ndarray:
        """Kernel of the rows factored so far with some points."""
        return self.kernel(self.x[: len(self.rows) * BLOCK], points)

    def solve(self, right: np.ndarray) -> np.ndarray:
        """L^-1 right, for the rows factored so far."""
        out = np.empty(right.shape)
        for i, (left, inverse) in enumerate(self.rows):
            lo = i * BLOCK
            out[lo : lo + len(inverse)] = inverse @ (right[lo : lo + len(inverse)] - left @ out[:lo])
        return out

    def solve_back(self, right: np.ndarray) -> np.ndarray:
        """L^-T right."""
        out = right.copy()
        for i in reversed(range(len(self.rows))):
            left, inverse = self.rows[i]
            lo = i * BLOCK
            own = out[lo : lo + len(inverse)] = inverse.T @ out[lo : lo + len(inverse)]
            out[:lo] -= left.T @ own
        return out

    def at(self, points: np.ndarray) -> np.ndarray:
        """L^-1 k(design, points): products of its columns are what the design explains."""
        return self.solve(self._with(points))


def _whole(design: DataFrame) -> pd.DataFrame:
    """All rows of a design in order of id."""
    rows = design.orderBy("id").limit(MOST_POINTS + 1).toPandas()
    if len(rows) > MOST_POINTS:
        raise ValueError(f"a design of more than {MOST_POINTS} points")
    return rows


def _pieces(u) -> Iterator[tuple[slice, np.ndarray]]:
    """A batch's points, so many at a time that they meet a large design in little memory."""
    for lo in range(0, len(u), BLOCK):
        yield slice(lo, lo + BLOCK), np.stack(u[lo : lo + BLOCK])


def _dealt(df: DataFrame) -> DataFrame:
    """Rows in tasks of about ROWS: few bytes that need much work."""
    return df.repartition(max(1, -(-df.count() // ROWS)))


def _pivoted(x: np.ndarray, factor: _Factor | None, lengths: np.ndarray, variance: float) -> np.ndarray:
    """Places of the rows of x, worst first, that together with the factor's own points explain all the others to the tolerance."""
    known = factor.at(x).T if factor else np.zeros((len(x), 0))
    left, chosen, columns = variance - (known * known).sum(axis=1), [], np.zeros((len(x), 0))
    while len(chosen) < len(x) and left.max() > TOLERANCE * variance:
        at = int(left.argmax())
        if len(chosen) == columns.shape[1]:
            columns = np.concatenate([columns, np.zeros((len(x), max(64, len(chosen))))], axis=1)
        own = _kernel(x, x[at : at + 1], lengths, variance)[:, 0] - known @ known[at] - columns[:, : len(chosen)] @ columns[at, : len(chosen)]
        columns[:, len(chosen)] = own / np.sqrt(left[at])
        left -= columns[:, len(chosen)] ** 2
        left[at] = 0
        chosen.append(at)
    return np.array(chosen, int)


def _spanning(points: DataFrame, lengths: np.ndarray, variance: float) -> _Factor:
    """The factor of points which explain every one of `points` (u) to TOLERANCE of the variance.

    With l its `at`, k(a, b) is l(a) l(b) to that tolerance for any two, so that sums of products of l over a design of any
    size stand for its kernel matrix. Each round looks at all points and adds from the worst explained, until there are none.
    """
    factor, context = None, points.sparkSession.sparkContext
    points = checkpointed(_dealt(points.select("u")))
    while True:
        model = context.broadcast(factor)

        def unexplained(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            for b in batches:
                for part, u in _pieces(b["u"].to_numpy()):
                    left = np.full(len(u), variance) if model.value is None else variance - (model.value.at(u) ** 2).sum(axis=0)
                    over = left > TOLERANCE * variance
                    yield pd.DataFrame({"u": b["u"].to_numpy()[part][over], "left": left[over]})

        worst = points.mapInPandas(unexplained, "u array<double>, left double").orderBy(F.desc("left"), F.xxhash64("u")).limit(ROUND).toPandas()
        if not len(worst):
            return factor
        x = np.stack(worst["u"])
        x = x[_pivoted(x, factor, lengths, variance)]
        held = x if factor is None else np.concatenate([factor.x, x])
        if len(held) > MOST_POINTS:
            raise ValueError(f"a kernel that {MOST_POINTS} points don't span")
        factor = _Factor(held, lengths, variance, 0.0)


def _moments(points: DataFrame, factor: _Factor, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Over all `points` (u, w, columns): the sums of w l l' and of l times each column, with l as in `_spanning`."""
    model, size = points.sparkSession.sparkContext.broadcast(factor), len(factor.x)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + len(columns)))
        for b in batches:
            for part, u in _pieces(b["u"].to_numpy()):
                v, rest = model.value.at(u), b.iloc[part]
                total += v @ np.column_stack([(v * rest["w"].to_numpy(float)).T, rest[columns].to_numpy(float)])
        yield pd.DataFrame({"i": np.arange(size), "row": [r.tobytes() for r in total]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": rows["i"].iloc[:1], "row": [np.sum([np.frombuffer(r) for r in rows["row"]], axis=0).tobytes()]})

    rows = _dealt(points.select("u", "w", *columns)).mapInPandas(own, "i long, row binary").groupBy("i").applyInPandas(add, "i long, row binary").toPandas().sort_values("i")
    total = np.stack([np.frombuffer(r) for r in rows["row"]])
    return total[:, :size], total[:, size:]


def _spanned_predict(design: DataFrame, queries: DataFrame, lengths: np.ndarray, variance: float, noise: float) -> DataFrame:
    factor = _spanning(design.select("u").unionAll(queries.select("u")), lengths, variance)
    level = design.agg(F.avg("y")).first()[0]
    gram, sums = _moments(design.withColumn("w", F.lit(1.0)).withColumn("off", F.col("y") - F.lit(level)), factor, ["off"])
    half = np.linalg.inv(np.linalg.cholesky(gram + noise * np.eye(len(gram))))
    model = queries.sparkSession.sparkContext.broadcast((factor, half, half.T @ (half @ sums[:, 0])))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factor, half, weights = model.value
        for b in batches:
            for part, u in _pieces(b["u"].to_numpy()):
                v = factor.at(u)
                var = variance - (v * v).sum(axis=0) + noise * ((half @ v) ** 2).sum(axis=0)
                yield pd.DataFrame({"id": b["id"].to_numpy()[part], "mean": weights @ v + level, "std": np.sqrt(np.maximum(var, 0))})

    return _dealt(queries.select("id", "u")).mapInPandas(predict, "id long, mean double, std double")


def _spanned_reduction(design: DataFrame, candidates: DataFrame, probes: DataFrame, lengths: np.ndarray, noise: float) -> DataFrame:
    """A covariance after the design is noise l(z) A^-1 l(c), with A the design's moments and noise: one matrix of the probes' moments holds them all."""
    factor = _spanning(design.select("u").unionAll(candidates.select("u")).unionAll(probes.select("u")), lengths, 1.0)
    gram = _moments(design.withColumn("w", F.lit(1.0)), factor, [])[0]
    asked = _moments(probes, factor, [])[0]
    half = np.linalg.inv(np.linalg.cholesky(gram + noise * np.eye(len(gram))))
    model = candidates.sparkSession.sparkContext.broadcast((factor, half, half @ asked @ half.T))

    def gain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factor, half, asked = model.value
        for b in batches:
            for part, u in _pieces(b["u"].to_numpy()):
                v = factor.at(u)
                h = half @ v
                var = np.maximum(1.0 - (v * v).sum(axis=0) + noise * (h * h).sum(axis=0), 0)
                yield pd.DataFrame({"id": b["id"].to_numpy()[part], "gain": noise**2 * (h * (asked @ h)).sum(axis=0) / (var + noise)})

    return _dealt(candidates.select("id", "u")).mapInPandas(gain, "id long, gain double")


def gp_predict(design: DataFrame, queries: DataFrame, lengths: list[float], variance: float = 1.0, noise: float = 1e-4) -> DataFrame:
    """Posterior mean and deviation at `queries` (id, u) of a process through all of `design` (id, u, y), by triangular factors; a design of any size, if few points span its kernel."""
    if design.count() > FACTORED:
        return _spanned_predict(design, queries, np.array(lengths), variance, noise)
    rows = _whole(design.select("id", "u", "y"))
    y = rows["y"].to_numpy()
    factor = _Factor(np.stack(rows["u"]), np.array(lengths), variance, noise)
    model = queries.sparkSession.sparkContext.broadcast((factor, factor.solve(y - y.mean()), y.mean()))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factor, alpha, level = model.value
        for b in batches:
            for part, u in _pieces(b["u"].to_numpy()):
                v = factor.at(u)
                yield pd.DataFrame({"id": b["id"].to_numpy()[part], "mean": alpha @ v + level, "std": np.sqrt(np.maximum(variance - (v * v).sum(axis=0), 0))})

    return queries.select("id", "u").mapInPandas(predict, "id long, mean double, std double")


def loo_residuals(designs: DataFrame, lengths: list[float], variance: float = 1.0, noise: float = 1e-4) -> DataFrame:
    """For each design (design, id, u, y): |alpha_i / [K^-1]_ii|, the residual of each point left out, without refitting."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(rows["u"]), rows["y"].to_numpy()
        inverse = np.linalg.inv(_kernel(x, x, np.array(lengths), variance) + noise * np.eye(len(x)))
        return pd.DataFrame({"design": rows["design"], "id": rows["id"], "residual": np.abs(inverse @ (y - y.mean()) / np.diag(inverse))})

    return designs.select("design", "id", "u", "y").groupBy("design").applyInPandas(solve, "design long, id long, residual double")


def variance_reduction(design: DataFrame, candidates: DataFrame, probes: DataFrame, lengths: list[float], noise: float = 1e-4, probes_at_once: int = PROBES) -> DataFrame:
    """For each candidate: weighted sum over all probes of cov^2 / (var + noise), the variance that labelling it would take away. `probes` has u and w.

    Probes are summed over in parts of about `probes_at_once`, each of which the driver sends to the tasks; the parts' sums add up. Larger designs
    go through the points that span the kernel, where the probes are one matrix of sums."""
    if design.count() > FACTORED:
        return _spanned_reduction(design, candidates, probes, np.array(lengths), noise)
    factor = _Factor(np.stack(_whole(design.select("id", "u"))["u"]), np.array(lengths), 1.0, noise)
    context = candidates.sparkSession.sparkContext
    model, parts = context.broadcast(factor), max(1, -(-probes.count() // probes_at_once))
    dealt = probes.select("u", "w", F.pmod(F.xxhash64("u", "w", F.monotonically_increasing_id()), F.lit(parts)).alias("part"))
    dealt = checkpointed(dealt) if parts > 1 else dealt

    def against(z, w):
        shared = context.broadcast((z, w))

        def gain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            factor, (z, w) = model.value, shared.value
            for b in batches:
                for part, c in _pieces(b["u"].to_numpy()):
                    vc = factor.at(c)
                    var, by_design, total = np.maximum(1.0 - (vc * vc).sum(axis=0), 0), factor.solve_back(vc), np.zeros(len(c))
                    for lo in range(0, len(z), BLOCK):
                        cov = factor.kernel(z[lo : lo + BLOCK], c) - factor.kernel(z[lo : lo + BLOCK], factor.x) @ by_design
                        total += w[lo : lo + BLOCK] @ (cov * cov)
                    yield pd.DataFrame({"id": b["id"].to_numpy()[part], "gain": total / (var + noise)})

        return candidates.select("id", "u").mapInPandas(gain, "id long, gain double")

    out = []
    for i in range(parts):
        p = dealt.where(F.col("part") == i).select("u", "w").toPandas()
        out.append(against(np.stack(p["u"]) if len(p) else np.zeros((0, len(lengths))), p["w"].to_numpy(float)))
    return out[0] if parts == 1 else reduce(DataFrame.unionAll, out).groupBy("id").agg(F.sum("gain").alias("gain"))


def upper_hits(lengths: DataFrame, value: str, bound: str, rtol: float = 1e-3) -> DataFrame:
    """How many length scales lie at their upper bound."""
    hit = F.abs(F.col(value) - F.col(bound)) <= rtol * F.abs(bound)
    return lengths.agg(F.count_if(hit).alias("hits"), F.avg(hit.cast("double")).alias("share"))


def component_weights(shares: DataFrame, level: str, beta: float, least: float, most: float, mode: str = "linear_blend") -> DataFrame:
    """Weights of components (pc, level) with mean 1: linearly blended, or by a tanh of the log level; clipped, then scaled."""
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    unit = F.col(level) / F.avg(level).over(everything)
    raw = (1 - beta) + beta * unit if mode == "linear_blend" else F.exp(beta * F.tanh(F.log(F.greatest(unit, F.lit(1e-12)))))
    out = shares.withColumn("__w", F.least(F.greatest(raw, F.lit(least)), F.lit(most)))
    return out.withColumn("weight", F.col("__w") / F.avg("__w").over(everything)).drop("__w")
