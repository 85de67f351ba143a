"""Changes of coordinates of parameter rows: amplitude and its normalisation, fixed extra parameters, deltas to an anchor."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def sigma8(amplitude: Column, reference: Column, reference_amplitude: float) -> Column:
    """reference sqrt(A / A_ref); null where A or the reference isn't positive."""
    return F.when((amplitude > 0) & (reference > 0), reference * F.sqrt(amplitude / reference_amplitude))


def amplitude(sigma: Column, reference: Column, reference_amplitude: float) -> Column:
    """The way back: A_ref (sigma8 / reference)^2."""
    return F.when((sigma > 0) & (reference > 0), reference_amplitude * F.pow(sigma / reference, F.lit(2.0)))


def extended(df: DataFrame, fixed: Mapping[str, float]) -> DataFrame:
    """The rows with fixed values for the parameters they lack."""
    return df.withColumns({k: F.lit(float(v)) for k, v in fixed.items()})


def stage_count(total: Column, fraction: Column) -> Column:
    """ceil(fraction total), from 1 to total; 0 where the fraction isn't positive or there is nothing."""
    return F.when((fraction > 0) & (total > 0), F.least(F.greatest(F.ceil(fraction * total), F.lit(1)), total)).otherwise(F.lit(0)).cast("long")


def anchor_deltas(df: DataFrame, anchor: DataFrame, logs: Sequence[str], linear: Sequence[str], floor: float = 1e-12) -> DataFrame:
    """log(x / anchor) for some columns and x - anchor for others, against the one row of `anchor`."""
    own = anchor.select(*(F.col(c).alias(f"__{c}") for c in (*logs, *linear)))
    out = df.crossJoin(F.broadcast(own.limit(1)))
    at_least = lambda c: F.greatest(F.col(c), F.lit(floor))
    out = out.withColumns({f"dlog_{c}": F.log(at_least(c) / at_least(f"__{c}")) for c in logs} | {f"d_{c}": F.col(c) - F.col(f"__{c}") for c in linear})
    return out.drop(*own.columns)
