"""Compositions: parts of a whole as columns of one row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import group_mean, group_median


def total(parts: Sequence[str]) -> Column:
    """Sum in the given order; null if any part is."""
    return reduce(lambda a, b: a + b, [F.col(p) for p in parts])


def closure(parts: Sequence[str]) -> dict[str, Column]:
    """Each part over the total; null where the total is zero."""
    return {p: F.try_divide(F.col(p), total(parts)) for p in parts}


def replace_small(parts: Sequence[str], floor: float) -> dict[str, Column]:
    """Multiplicative replacement of shares under ``floor``; the others shrink to keep the sum.

    Null if all parts are small.
    """
    small = [F.when(F.col(p) < floor, F.lit(1.0)).otherwise(F.lit(0.0)) for p in parts]
    k = reduce(lambda a, b: a + b, small)
    rest = reduce(lambda a, b: a + b, [F.when(F.col(p) < floor, F.lit(0.0)).otherwise(F.col(p)) for p in parts])
    scale = F.try_divide(1 - k * floor, rest)
    return {p: F.when(rest > 0, F.when(F.col(p) < floor, F.lit(floor)).otherwise(F.col(p) * scale)) for p in parts}


def clr(parts: Sequence[str]) -> dict[str, Column]:
    """Centred log-ratio; null where a part isn't positive."""
    logs = [F.when(F.col(p) > 0, F.ln(p)) for p in parts]
    center = reduce(lambda a, b: a + b, logs) / len(parts)
    return {p: log - center for p, log in zip(parts, logs, strict=True)}


def relative_clr(df: DataFrame, parts: Sequence[str], by: Sequence[str], how: str = "mean") -> DataFrame:
    """Log-ratios minus their group's centre; medians are centred anew within the row."""
    center = {"mean": group_mean, "median": group_median}[how]
    out = df.select("*", *[(F.col(p) - center(p, by)).alias(f"_rel_{p}") for p in parts])
    shift = total([f"_rel_{p}" for p in parts]) / len(parts) if how == "median" else F.lit(0.0)
    names = {f"_rel_{p}" for p in parts}
    kept = [c for c in out.columns if c not in names and c not in parts]
    return out.select(*kept, *[(F.col(f"_rel_{p}") - shift).alias(p) for p in parts])


def composition_distance(a: Sequence[str], b: Sequence[str]) -> Column:
    """Euclidean distance of two rows of log-ratios (the Aitchison distance)."""
    return F.sqrt(reduce(lambda x, y: x + y, [(F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(a, b, strict=True)]))
