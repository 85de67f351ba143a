"""Components of curves from a covariance state that merges: layouts by band, appended rows, spectra rebuilt.

A state is one row: how many samples, their mean and the scatter about it. Each Arrow batch of samples makes one, and
two states merge exactly (the scatter of both, and of their means), so states are folded in a tree of tasks and rows that are appended to a data set
update its state without the rows before. The axis is small, as K x K numbers are held; samples need not be few.

Layouts share out components: `global` over the whole axis, `bands` one eigenproblem for each band, `residual`
global components first and then, in each band, components of what these leave (the covariance deflated by them).

Defined results: samples that lack a finite value at some point of the axis are left out and not counted; of several values at
one point the mean counts; an empty table has a state of no samples, and no components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "axis array<double>, n long, mean array<double>, scatter array<double>"
LOADING = "band string, pc int, axis double, loading double, explained double"
#: States that one task merges: three rounds reach FAN^2 tasks and what few groups are left.
FAN = 64


def curves(facts: DataFrame, sample: str, axis: str, value: str, points: DataFrame | None = None) -> DataFrame:
    """Samples as arrays along the axis: sample, axis, v; those without a finite value at every point are left out.

    `points` (axis) fixes the axis where the facts may not hold all of it, as those of appended rows may not."""
    x = F.col(value).cast("double")
    good = facts.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).groupBy(F.col(sample).alias("sample"), F.col(axis).cast("double").alias("axis")).agg(F.avg(x).alias("x"))
    known = (points if points is not None else good).select(F.col("axis").cast("double").alias("axis")).distinct().agg(F.array_sort(F.collect_list("axis")).alias("axis"))
    packed = good.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("axis", "x"))).alias("p"))
    whole = packed.crossJoin(F.broadcast(known)).where(F.transform("p", lambda p: p["axis"]) == F.col("axis"))
    return whole.select("sample", "axis", F.transform("p", lambda p: p["x"]).alias("v"))


def _merge(one: tuple, two: tuple) -> tuple:
    """Of two states (n, mean, scatter) that of all their samples."""
    if not one[0] or not two[0]:
        return two if not one[0] else one
    n = one[0] + two[0]
    apart = two[1] - one[1]
    return n, one[1] + apart * (two[0] / n), one[2] + two[2] + np.outer(apart, apart) * (one[0] * two[0] / n)


def _state_rows(axis: np.ndarray, state: tuple) -> pd.DataFrame:
    return pd.DataFrame({"axis": [axis.tolist()], "n": [int(state[0])], "mean": [state[1].tolist()], "scatter": [state[2].ravel().tolist()]})


def states(samples: DataFrame) -> DataFrame:
    """A state for each task of `samples` (axis, v)."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        axis, state = None, (0, None, None)
        for rows in batches:
            if len(rows):
                axis = np.asarray(rows["axis"].iloc[0])
                v = np.stack(rows["v"])
                centred = v - v.mean(axis=0)
                state = _merge(state, (len(v), v.mean(axis=0), centred.T @ centred))
        if state[0]:
            yield _state_rows(axis, state)

    return samples.select("axis", "v").mapInPandas(add, STATE)


def merged(parts: DataFrame) -> DataFrame:
    """One state of all `parts`, states of one axis: folded FAN at a time, so no task holds more."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        state = (0, None, None)
        for r in rows.itertuples(index=False):
            state = _merge(state, (r.n, np.asarray(r.mean), np.asarray(r.scatter).reshape(len(r.axis), -1)))
        return _state_rows(np.asarray(rows["axis"].iloc[0]), state).assign(to=rows["to"].iloc[0])

    parts = parts.select("axis", "n", "mean", "scatter", F.spark_partition_id().cast("long").alias("to"))
    for last in (False, False, True):
        parts = parts.withColumn("to", F.lit(0).cast("long") if last else F.floor(F.col("to") / FAN)).groupBy("to").applyInPandas(fold, STATE + ", to long")
    return parts.drop("to")


def state_of(facts: DataFrame, sample: str, axis: str, value: str) -> DataFrame:
    return merged(states(curves(facts, sample, axis, value)))


def appended(state: DataFrame, facts: DataFrame, sample: str, axis: str, value: str) -> DataFrame:
    """The state with the samples of `facts` added; the rows it was made of are not read."""
    points = state.select(F.explode("axis").alias("axis"))
    return merged(state.unionByName(states(curves(facts, sample, axis, value, points))))


def _leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and vectors (rows), each with its largest entry positive."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:k]
    v = vectors[:, order].T
    return values[order], v * np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] > 0, 1.0, -1.0)[:, None]


def layout(state: DataFrame, bands: DataFrame | None, everywhere: int, each: int) -> DataFrame:
    """Loadings (band, pc, axis, loading, explained): `everywhere` global ones (band `all`), then `each` in every band of `bands` (axis, band) of what they leave.

    everywhere=0 gives one eigenproblem for each band; no bands gives the global components alone. Each band is a task."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        axis = np.asarray(r["axis"])
        c = np.asarray(r["scatter"]).reshape(len(axis), -1) / max(r["n"] - 1, 1)
        first, v = _leading(c, everywhere)
        if r["band"] == "all":
            values, at = first, np.arange(len(axis))
        else:
            left = np.eye(len(axis)) - v.T @ v
            at = np.flatnonzero(np.isin(axis, np.asarray(r["points"])))
            values, v = _leading((left @ c @ left)[np.ix_(at, at)], each)
        n, k = len(values), len(at)
        return pd.DataFrame({"band": r["band"], "pc": np.repeat(np.arange(n), k).astype(np.int32), "axis": np.tile(axis[at], n), "loading": v.ravel(), "explained": np.repeat(values, k)})

    wanted = state.sparkSession.createDataFrame([("all", [])] if everywhere else [], "band string, points array<double>")
    if bands is not None and each:
        wanted = wanted.unionAll(bands.groupBy(F.col("band").cast("string")).agg(F.collect_list(F.col("axis").cast("double"))))
    return state.where("n > 1").crossJoin(F.broadcast(wanted)).groupBy("band").applyInPandas(solve, LOADING)


def coordinates(samples: DataFrame, state: DataFrame, loadings: DataFrame) -> DataFrame:
    """Each sample's coordinates: sample, band, pc, score. Band components measure what the global ones leave."""
    rows = loadings.groupBy("band", "pc").agg(F.array_sort(F.collect_list(F.struct("axis", "loading"))).alias("p"))
    model = state.select("axis", "mean").crossJoin(rows.agg(F.collect_list(F.struct("band", "pc", "p")).alias("model")))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            axis, v = np.asarray(b["axis"].iloc[0]), np.stack(b["v"]) - np.asarray(b["mean"].iloc[0])
            parts = sorted(b["model"].iloc[0], key=lambda m: (m["band"] != "all", m["band"], m["pc"]))
            for m in parts:
                at = np.searchsorted(axis, [p["axis"] for p in m["p"]])
                own = np.array([p["loading"] for p in m["p"]])
                score = v[:, at] @ own
                if m["band"] == "all":
                    v = v - np.outer(score, own)
                yield pd.DataFrame({"sample": b["sample"], "band": m["band"], "pc": np.int32(m["pc"]), "score": score})

    kind = samples.schema["sample"].dataType.simpleString()
    return samples.drop("axis").crossJoin(F.broadcast(model)).mapInPandas(measure, f"sample {kind}, band string, pc int, score double")


def rebuilt(scores: DataFrame, state: DataFrame, loadings: DataFrame) -> DataFrame:
    """The curves that coordinates stand for: sample, axis, value; exact if every component is there."""
    mean = state.select(F.explode(F.arrays_zip("axis", "mean")).alias("z")).select("z.axis", "z.mean")
    total = scores.join(F.broadcast(loadings.select("band", "pc", "axis", "loading")), ["band", "pc"]).groupBy("sample", "axis").agg(F.sum(F.col("score") * F.col("loading")).alias("s"))
    return total.join(F.broadcast(mean), "axis").select("sample", "axis", (F.col("mean") + F.col("s")).alias("value"))
