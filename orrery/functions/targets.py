"""What is learned and how error is told: targets and their inverses, errors, gains, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-30


def target(power: Column, anchor: Column | None, kind: str, eps: float = EPS) -> Column:
    """log of the power without an anchor; `ratio`: power / anchor - 1; `logdiff`: difference of logs."""
    p = F.greatest(power, F.lit(eps))
    if anchor is None:
        return F.log(p)
    a = F.greatest(anchor, F.lit(eps))
    return {"ratio": p / a - 1.0, "logdiff": F.log(p) - F.log(a)}[kind]


def power_of(value: Column, anchor: Column | None, kind: str, eps: float = EPS) -> Column:
    """The inverse; a ratio stays at least 1e-8."""
    if anchor is None:
        return F.exp(value)
    a = F.greatest(anchor, F.lit(eps))
    return {"ratio": F.greatest(value + 1.0, F.lit(1e-8)) * a, "logdiff": F.exp(value) * a}[kind]


def target_name(kind: str, anchor: str) -> str:
    return f"ratio_to_{anchor}" if kind == "ratio" else f"log_hi_minus_log_{anchor}_anchor"


def target_parts(name: Column) -> Column:
    """(kind, anchor) of such a name."""
    ratio, diff = F.regexp_extract(name, "^ratio_to_(.+)$", 1), F.regexp_extract(name, "^log_hi_minus_log_(.+)_anchor$", 1)
    return F.struct(F.when(ratio != "", "ratio").when(diff != "", "logdiff").alias("kind"), F.when(ratio != "", ratio).when(diff != "", diff).alias("anchor"))


def relative_error(pred: Column, truth: Column, eps: float = EPS) -> Column:
    return F.abs(pred - truth) / F.greatest(truth, F.lit(eps))


def log_relative_error(pred: Column, truth: Column) -> Column:
    return F.abs(F.exp(pred - truth) - 1.0)


def signed_percent(pred: Column, truth: Column, eps: float = EPS) -> Column:
    return (pred / F.greatest(truth, F.lit(eps)) - 1.0) * 100.0


def improvement(base: Column, value: Column) -> Column:
    return 1.0 - value / F.greatest(base, F.lit(1e-300))


def improvement_percent(base: Column, value: Column) -> Column:
    return F.when(base != 0, (base - value) / base * 100.0).otherwise(F.lit(0.0))


def variance_bias_score(variance: Column, bias: Column, variance_scale: Column, bias_scale: Column, weight: float, mode: str) -> Column:
    """sqrt((U/sU)^2 + (wB/sB)^2), or the bias term alone; what is not a number counts as 0."""
    b = F.nanvl(F.coalesce(weight * bias / bias_scale, F.lit(0.0)), F.lit(0.0))
    if mode == "bias_only":
        return F.abs(b)
    u = F.nanvl(F.coalesce(variance / variance_scale, F.lit(0.0)), F.lit(0.0))
    return F.sqrt(u * u + b * b)


def smoothstep_gate(error: Column, good: float, bad: float, floor: float) -> Column:
    r = F.least(F.greatest((bad - error) / (bad - good), F.lit(0.0)), F.lit(1.0))
    return F.greatest(r * r * (3.0 - 2.0 * r), F.lit(floor))


def synthetic_log_power(u: list[Column], k: Column) -> Column:
    """A smooth closed form over five unit coordinates and k, the truth of hermetic runs."""
    # The closed form's coefficients.
    level = 3.0 + 0.8 * u[0] - 0.25 * u[1] + 0.35 * u[4]
    slope = -1.15 + 0.28 * (u[3] - 0.5)
    wave = 0.06 * F.sin(4.0 * F.log(k) + 2.0 * u[2])
    return level + slope * F.log(k) + wave - 0.18 * (u[0] - u[4]) * F.pow(k / 3.0, F.lit(0.7))


def soft_cap(x: Column, cap: float) -> Column:
    return cap * x / (cap + x)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
