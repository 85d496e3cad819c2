"""Reproducible permutations and bootstraps.

Draws come from MD5 of the row's key and the replicate's number, so that they
are the same in any engine, partitioning and order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task sorts, about.
TASK_ROWS = 131072


def draw_key(key: str, rep: str | Column, salt: str = "") -> Column:
    """Sort key of a row in a replicate."""
    r = F.col(rep) if isinstance(rep, str) else rep
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), r.cast("string"), F.lit(salt)))


def replicates(df: DataFrame, n: int) -> DataFrame:
    """Every row once per replicate ``rep`` 0..n-1."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def permute_within(df: DataFrame, value: str, key: str, by: Sequence[str], n: int, salt: str = "", keep: Sequence[str] = ()) -> DataFrame:
    """``rep, by, key, keep, value`` with the values of each group dealt anew to its rows.

    A row's seat is its place by key, the same in every replicate; a seat meets
    one card a replicate. The planner knows neither the replicates nor the
    windows' sizes, so the join is told not to broadcast and the tasks are
    counted by the cards: sorts of a few large tasks at once overflow a heap.
    """
    tasks = min(4096, max(1, df.count() * n // TASK_ROWS))
    seat = df.select(*by, key, *keep, F.row_number().over(Window.partitionBy(*by).orderBy(key)).alias("_n"))
    dealt = Window.partitionBy("rep", *by).orderBy(draw_key(key, "rep", salt), key)
    # Dealt before the draws are made: a draw is longer than its row.
    rows = replicates(df.select(*by, key, value), n).repartition(tasks, "rep", *by)
    card = rows.select("rep", *by, value, F.row_number().over(dealt).alias("_n"))
    card, seat = (x.repartition(tasks, *by, "_n") for x in (card, seat))
    return card.join(seat.hint("merge"), [*by, "_n"]).select("rep", *by, key, *keep, value)


def bootstrap_groups(groups: DataFrame, group: str, n: int, salt: str = "") -> DataFrame:
    """``rep, group, times``: how often each whole group is drawn in each replicate.

    Group number i of m (by order) draws the group at the MD5's value modulo m.
    """
    listed = groups.select(group).distinct().withColumn("_i", F.row_number().over(Window.partitionBy().orderBy(group)) - 1)
    size = listed.agg(F.count(F.lit(1)).alias("_m"))
    draws = replicates(listed, n).crossJoin(F.broadcast(size)).select(
        "rep", (F.conv(F.substring(draw_key("_i", "rep", salt), 1, 8), 16, 10).cast("long") % F.col("_m")).alias("_i")
    )
    return draws.groupBy("rep", "_i").agg(F.count(F.lit(1)).alias("times")).join(listed, "_i").select("rep", group, "times")


def bootstrap_mean(df: DataFrame, group: str, value: str, n: int, salt: str = "") -> DataFrame:
    """``rep, mean``: mean over rows when whole groups are drawn; groups are summed once before."""
    sums = df.groupBy(group).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    drawn = bootstrap_groups(sums, group, n, salt).join(sums, group)
    return drawn.groupBy("rep").agg(F.try_divide(F.sum(F.col("times") * F.col("_s")), F.sum(F.col("times") * F.col("_c"))).alias("mean"))


def percentile_interval(draws: DataFrame, value: str, level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    a = (1 - level) / 2
    return draws.groupBy(*by).agg(F.percentile(value, a).alias("low"), F.percentile(value, 1 - a).alias("high"))


def empirical_p(draws: DataFrame, observed: float | Column, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``(1 + #null >= observed) / (1 + #null)``; never zero."""
    o = F.lit(float(observed)) if isinstance(observed, (int, float)) else observed
    return draws.groupBy(*by).agg(((1 + F.count_if(F.col(value) >= o)) / (1 + F.count(value))).alias("p"))


def subsample(df: DataFrame, key: str, share: float, rep: int = 0, salt: str = "") -> DataFrame:
    """Rows whose draw is below ``share``: a sample without replacement that needs no sort."""
    unit = F.conv(F.substring(draw_key(key, F.lit(rep), salt), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return df.filter(unit < share)


def circular_shift(series: DataFrame, periods: int, shift: int) -> DataFrame:
    """Series ``id, t, y`` moved by a number of periods around the circle."""
    return series.withColumn("t", F.pmod(F.col("t") + shift, F.lit(periods)))


def allowed_shifts(periods: int, reach: int, guard: int, season: int = 12) -> list[int]:
    """Shifts at least ``reach + guard`` from every multiple of the season."""
    far = reach + guard
    return [s for s in range(1, periods) if min(s % season, season - s % season) >= far]
