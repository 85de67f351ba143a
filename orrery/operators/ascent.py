"""Ascent inside simplices: thousands of starts climb a function of the parameters together, a batch of them in each step.

A state is a start's barycentric weights. Its direction is the limited-memory quasi-Newton one of its last steps within the
face it is on, its next weights are the projection of a step back into the simplex, and a step counts only if it gains: it is
shortened until it does (by a share of the slope's promise), and a state that gains no more rests. So no start ends below where it
began. First steps have a fixed length and all bounds are relative, so a function of small values is climbed as fast as a large one.
Rows are independent, so Spark deals them out; what every task needs, the fitted design, is bounded and broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import models

#: Steps remembered, steps at most, times a step is shortened at most, share of the promised gain a step must bring.
MEMORY, STEPS, HALVINGS, SHARE = 6, 60, 24, 1e-4
RESTS = 1e-9
#: How far a step without a memory moves the weight it moves most: about as far as starts are apart, so that it doesn't pass over a top between them.
FIRST = 0.25
#: Least cosine of a step and the fall of the slope along it that is remembered.
BENDS = 1e-8
#: A step that promises less than this share of the variance is not tried: halving it only promises less.
LEAST = 1e-12
#: Simplices of one task: few bytes, and some sixty starts each.
ROWS = 2048


def onto_simplex(w: np.ndarray) -> np.ndarray:
    """The nearest weights, row by row, that are non-negative and sum to 1."""
    falling = -np.sort(-w, axis=1)
    over = (np.cumsum(falling, axis=1) - 1) / np.arange(1, w.shape[1] + 1)
    last = (falling > over).sum(axis=1) - 1
    return np.maximum(w - over[np.arange(len(w)), last][:, None], 0)


class PosteriorVariance:
    """The variance that a process fitted to a design leaves at points, and its gradient, by triangular solves."""

    def __init__(self, design: np.ndarray, lengths: np.ndarray, noise: float = 1e-4, variance: float = 1.0):
        self.factor = models._Factor(design, lengths, variance, noise)
        # Of a small design the inverse itself: one product in place of two solves.
        self.inverse = self.factor.solve_back(self.factor.solve(np.eye(len(design)))) if len(design) <= models.BLOCK else None

    def __call__(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f, value, slope = self.factor, np.empty(len(points)), np.empty(points.shape)
        for lo in range(0, len(points), models.BLOCK):
            u = points[lo : lo + models.BLOCK]
            kernel = f.kernel(f.x, u)
            # d k(x_i, u) / du = k (x_i - u) / length^2, and the variance falls by twice K^-1 k times that.
            pull = (f.solve_back(f.solve(kernel)) if self.inverse is None else self.inverse @ kernel) * kernel
            value[lo : lo + models.BLOCK] = f.variance - pull.sum(axis=0)
            slope[lo : lo + models.BLOCK] = -2 * (pull.T @ f.x - pull.sum(axis=0)[:, None] * u) / f.lengths**2
        return value, slope


def _direction(slope: np.ndarray, moved: np.ndarray, turned: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Quasi-Newton directions upwards: moved and turned [state, memory, weight] are steps and how the slope fell along them, oldest first, held says which are filled."""
    bend = np.where(held, np.einsum("smw,smw->sm", moved, turned), 1.0)
    out, share = slope.copy(), np.zeros(held.shape)
    for m in reversed(range(held.shape[1])):
        share[:, m] = np.where(held[:, m], np.einsum("sw,sw->s", moved[:, m], out) / bend[:, m], 0)
        out -= share[:, m, None] * turned[:, m]
    size = np.einsum("sw,sw->s", turned[:, -1], turned[:, -1])
    out *= np.where(held[:, -1] & (size > 0), bend[:, -1] / np.where(size > 0, size, 1), 1.0)[:, None]
    for m in range(held.shape[1]):
        back = np.where(held[:, m], np.einsum("sw,sw->s", turned[:, m], out) / bend[:, m], 0)
        out += ((share[:, m] - back) * held[:, m])[:, None] * moved[:, m]
    return out


def _within_face(slope: np.ndarray, shut: np.ndarray) -> np.ndarray:
    """The part of each slope along which shut weights stay as they are and the sum does."""
    mean = np.where(shut, 0, slope).sum(axis=1) / (~shut).sum(axis=1)
    return np.where(shut, 0, slope - mean[:, None])


def _face(weights: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slope within the face each state is on, and which weights are shut: those of 0 that the slope would make less."""
    shut = np.zeros(weights.shape, bool)
    while True:
        up = _within_face(slope, shut)
        more = (weights <= 0) & ~shut & (up < 0)
        if not more.any():
            return up, shut
        shut |= more


def climb(vertices: np.ndarray, weights: np.ndarray, function: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """The weights each state reaches, and their values: vertices [state, weight, dim], weights [state, weight]."""
    weights = onto_simplex(weights)

    def look(rows: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, slope = function(np.einsum("sw,swd->sd", w, vertices[rows]))
        along = np.einsum("sd,swd->sw", slope, vertices[rows])
        return value, along - along.mean(axis=1, keepdims=True)

    live = np.arange(len(weights))
    value, slope = look(live, weights)
    shape = (len(weights), MEMORY, weights.shape[1])
    moved, turned, held, walls = np.zeros(shape), np.zeros(shape), np.zeros(shape[:2], bool), np.zeros(weights.shape, bool)
    for _ in range(steps):
        up, shut = _face(weights[live], slope[live])
        steepest = np.abs(up).max(axis=1, initial=0)
        on = steepest > LEAST * np.abs(value[live])
        live, up, shut, steepest = live[on], up[on], shut[on], steepest[on]
        if not len(live):
            break
        # On another face what is remembered is forgotten.
        held[live[(shut != walls[live]).any(axis=1)]] = False
        walls[live] = shut
        own = _direction(up, moved[live], turned[live], held[live])
        # Where the memory points down, it is forgotten.
        held[live[np.einsum("sw,sw->s", own, up) <= 0]] = False
        plain = ~held[live].any(axis=1)
        own[plain] = FIRST * up[plain] / steepest[plain, None]
        size, open_, gained = np.ones(len(live)), np.arange(len(live)), np.zeros(len(live), bool)
        new_w, new_value, new_slope = weights[live].copy(), value[live].copy(), slope[live].copy()
        for _ in range(HALVINGS):
            tried = onto_simplex(weights[live[open_]] + size[open_, None] * own[open_])
            promise = np.einsum("sw,sw->s", slope[live[open_]], tried - weights[live[open_]])
            worth = promise > LEAST * np.abs(value[live[open_]])
            open_, tried, promise = open_[worth], tried[worth], promise[worth]
            if not len(open_):
                break
            rows = live[open_]
            got, got_slope = look(rows, tried)
            gain = got - value[rows]
            good = (gain > 0) & (gain >= SHARE * promise)
            at = open_[good]
            new_w[at], new_value[at], new_slope[at], gained[at] = tried[good], got[good], got_slope[good], True
            # The next try is where the parabola through value, slope and try is highest: a tenth to half of the step.
            open_, lack = open_[~good], (promise - gain)[~good]
            size[open_] *= np.clip(promise[~good] / (2 * lack), 0.1, 0.5)
            if not len(open_):
                break
        step, fall = new_w - weights[live], _within_face(slope[live] - new_slope, shut)
        lengths = np.sqrt(np.einsum("sw,sw->s", step, step) * np.einsum("sw,sw->s", fall, fall))
        keep = gained & (np.einsum("sw,sw->s", step, fall) > BENDS * lengths)
        rows = live[keep]
        moved[rows, :-1], turned[rows, :-1], held[rows, :-1] = moved[rows, 1:], turned[rows, 1:], held[rows, 1:]
        moved[rows, -1], turned[rows, -1], held[rows, -1] = step[keep], fall[keep], True
        far = np.abs(step).max(axis=1) > RESTS
        weights[live], value[live], slope[live] = new_w, new_value, new_slope
        # Without gain a state with a memory tries once more along its slope; without one it rests.
        again = ~gained & held[live].any(axis=1)
        held[live[again]] = False
        live = live[(gained & far) | again]
    return weights, value


def starts(corners: int, most: int = 64) -> np.ndarray:
    """Where climbs begin: the centre, a point near each vertex, and the finest lattice of at most `most` points (its vertices and edges' middles at least)."""
    near = np.full((corners, corners), 0.3 / (corners - 1)) + (0.7 - 0.3 / (corners - 1)) * np.eye(corners)
    parts = 2
    while comb(parts + corners, corners - 1) <= most:
        parts += 1
    bars = np.array(list(combinations(range(parts + corners - 1), corners - 1))).reshape(-1, corners - 1)
    ends = np.column_stack([np.full(len(bars), -1), bars, np.full(len(bars), parts + corners - 1)])
    return np.concatenate([np.full((1, corners), 1 / corners), near, (np.diff(ends, axis=1) - 1) / parts])


def best_points(simplices: DataFrame, design: DataFrame, lengths: list[float], noise: float = 1e-4, expected: int | None = None) -> DataFrame:
    """`simplices` (simplex, vertices): the point of each where a process fitted to all of `design` (id, u) is least sure, over several climbs.

    simplex, u, weights, start (the best value at a start) and value (its posterior variance), which is never less. The design is broadcast: at most models.MOST_POINTS points.
    `expected` is about how many simplices there are, for where counting would make all of them once more; it only deals them into tasks.
    """
    simplices = simplices.repartition(max(1, -(-(simplices.count() if expected is None else expected) // ROWS)))
    factor = PosteriorVariance(np.stack(models._whole(design.select("id", "u"))["u"]), np.array(lengths), noise)
    shared = simplices.sparkSession.sparkContext.broadcast(factor)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            v = np.array([np.stack(x) for x in rows["vertices"]])
            begin = starts(v.shape[1])
            own = max(1, 4096 // len(begin))
            for lo in range(0, len(v), own):
                part = v[lo : lo + own]
                each, w = np.repeat(part, len(begin), axis=0), np.tile(begin, (len(part), 1))
                first = shared.value(np.einsum("sw,swd->sd", w, each))[0].reshape(len(part), -1)
                w, value = climb(each, w, shared.value)
                value = value.reshape(len(part), -1)
                best = value.argmax(axis=1)
                w = w.reshape(len(part), len(begin), -1)[np.arange(len(part)), best]
                yield pd.DataFrame({"simplex": rows["simplex"].to_numpy()[lo : lo + own], "u": np.einsum("sw,swd->sd", w, part).tolist(), "weights": w.tolist(), "start": first.max(axis=1), "value": value.max(axis=1)})

    return simplices.select(F.col("simplex").cast("long"), "vertices").mapInPandas(search, "simplex long, u array<double>, weights array<double>, start double, value double")
