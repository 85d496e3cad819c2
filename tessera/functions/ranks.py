"""Ranks, group centring and robust scales as window columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

Names = Sequence[str]
#: Consistency factor of the median absolute deviation for a normal distribution.
MAD_FACTOR = 1.4826


def avg_rank(value: str, by: Names = (), descending: bool = False) -> Column:
    """Rank from 1, ties share their mean rank.  Filter nulls before."""
    order = F.desc(value) if descending else F.asc(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (ties - 1) / F.lit(2.0)


def group_mean(value: str | Column, by: Names) -> Column:
    return F.avg(value).over(Window.partitionBy(*by))


def group_median(value: str | Column, by: Names) -> Column:
    return F.median(value).over(Window.partitionBy(*by))


def group_center(value: str, by: Names, how: str = "median") -> Column:
    """Group mean or median on every row."""
    return {"mean": group_mean, "median": group_median}[how](value, by)


def relative(value: str, by: Names, how: str = "median", eligible: Column | None = None) -> Column:
    """Value minus its group's centre; only eligible rows make the centre."""
    base = F.col(value) if eligible is None else F.when(eligible, F.col(value))
    return F.col(value) - {"mean": group_mean, "median": group_median}[how](base, by)


def rank01(value: str, by: Names = ()) -> Column:
    """Average rank scaled to [0, 1]; a single row gets 1."""
    n = F.count(value).over(Window.partitionBy(*by))
    return F.when(n == 1, F.lit(1.0)).otherwise((avg_rank(value, by) - 1) / F.nullif(n - 1, F.lit(0)))


def pct_rank(value: str, by: Names = ()) -> Column:
    """Average rank over the number of rows."""
    return avg_rank(value, by) / F.count(value).over(Window.partitionBy(*by))


def quantile_group(value: str, tie: str, q: int, by: Names = ()) -> Column:
    """``floor(position * q / n)``; ties are split by ``tie``."""
    w = Window.partitionBy(*by)
    position = F.row_number().over(w.orderBy(value, tie)) - 1
    return F.floor(position * q / F.count(F.lit(1)).over(w)).cast("int")


def lag_diff(value: str, by: Names, order: str) -> Column:
    return F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(order))
