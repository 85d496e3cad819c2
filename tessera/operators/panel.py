"""Panels: entity x month x category facts, their quality, windows and levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ranks import group_median


def add_residual(long: DataFrame, whole: str, name: str = "other", key: Sequence[str] = ("id", "t")) -> DataFrame:
    """Append the category ``whole - sum of the others`` for keys that have the whole.

    Keys without the whole, or with a residual of zero or less, get no row.
    ``is_derived`` marks the new rows.
    """
    rest = (
        long.groupBy(*key)
        .agg(
            F.sum(F.when(F.col("cat") == whole, F.col("v"))).alias("_whole"),
            F.sum(F.when(F.col("cat") != whole, F.col("v")).otherwise(F.lit(0.0))).alias("_parts"),
        )
        .select(*key, F.lit(name).alias("cat"), (F.col("_whole") - F.col("_parts")).alias("v"), F.lit(True).alias("is_derived"))
        .filter("v > 0")
    )
    return long.select(*key, "cat", "v", F.lit(False).alias("is_derived")).unionByName(rest)


def to_wide(long: DataFrame, categories: Sequence[str], names: Sequence[str], key: Sequence[str] = ("id", "t")) -> DataFrame:
    """One row per key with a column per category, in one aggregation; absent parts are null."""
    return long.groupBy(*key).agg(
        *[F.sum(F.when(F.col("cat") == c, F.col("v"))).alias(n) for c, n in zip(categories, names, strict=True)]
    )


def to_long(wide: DataFrame, names: Sequence[str], key: Sequence[str] = ("id", "t")) -> DataFrame:
    return wide.unpivot(list(key), list(names), "cat", "v").filter("v is not null")


def series_quality(months: DataFrame, periods: int, year_length: int = 12) -> DataFrame:
    """Per entity: months, first, last, coverage string, longest inner gap and status.

    ``months`` has ``id, t``; status is ``full``, ``only_k`` (exactly the months of
    year k) or ``partial``.
    """
    w = Window.partitionBy("id").orderBy("t")
    rows = months.select("id", "t").distinct().withColumn("_gap", F.col("t") - F.lag("t").over(w) - 1)
    years = range(periods // year_length)
    agg = rows.groupBy("id").agg(
        F.count("t").alias("n_months"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        F.coalesce(F.max("_gap"), F.lit(0)).alias("longest_gap"),
        F.collect_set("t").alias("_seen"),
        *[F.count_if(F.floor(F.col("t") / year_length) == y).alias(f"_y{y}") for y in years],
    )
    coverage = F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(periods - 1)), lambda i: F.when(F.array_contains("_seen", i), "1").otherwise("0")), ""
    )
    status: Column = F.when(F.col("n_months") == periods, "full")
    for y in years:
        status = status.when((F.col(f"_y{y}") == year_length) & (F.col("n_months") == year_length), f"only_{y}")
    return agg.select(
        "id", "n_months", "first_t", "last_t", "longest_gap", coverage.alias("coverage"), status.otherwise("partial").alias("status")
    )


def months_coverage(months: DataFrame) -> DataFrame:
    return months.groupBy("t").agg(F.countDistinct("id").alias("n_ids"))


def month_ladder(quality: DataFrame, weights: DataFrame, steps: Sequence[int]) -> DataFrame:
    """For each step: entities with at least so many months, and their share of the weight."""
    rows = quality.join(weights, "id", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    grid = rows.withColumn("k", F.explode(F.array(*[F.lit(int(s)) for s in steps])))
    return grid.groupBy("k").agg(
        F.count_if(F.col("n_months") >= F.col("k")).alias("n_ids"),
        F.try_divide(F.sum(F.when(F.col("n_months") >= F.col("k"), F.col("w")).otherwise(0.0)), F.sum("w")).alias("w_share"),
    )


def calendar_windows(periods: int, kinds: Sequence[str] = ("year", "half", "quarter")) -> list[tuple[str, int, int]]:
    """``(name, first month, months)`` of tumbling calendar windows."""
    size = {"year": 12, "half": 6, "quarter": 3}
    return [(f"{k}{i}", i * size[k], size[k]) for k in kinds for i in range(periods // size[k])]


def rolling_windows(periods: int, size: int = 12, step: int = 1) -> list[tuple[str, int, int]]:
    return [(f"roll{s}", s, size) for s in range(0, periods - size + 1, step)]


def window_bridge(df: DataFrame, windows: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Rows with ``win``: each month once for every window that holds it, without a join."""
    hits = F.array(*[F.when((F.col("t") >= s) & (F.col("t") < s + n), F.lit(name)) for name, s, n in windows])
    return df.withColumn("win", F.explode(F.filter(hits, lambda x: x.isNotNull())))


def window_sums(long: DataFrame, windows: Sequence[tuple[str, int, int]], key: Sequence[str] = ("id", "cat")) -> DataFrame:
    """Sums over windows, only where every month of the window is present."""
    size = F.create_map(*[F.lit(x) for name, _, n in windows for x in (name, n)])
    return (
        window_bridge(long, windows)
        .groupBy(*key, "win")
        .agg(F.sum("v").alias("v"), F.countDistinct("t").alias("n_months"))
        .filter(F.col("n_months") == size[F.col("win")])
    )


def level_relative(long: DataFrame, least_months: int) -> DataFrame:
    """``exp(mean ln(v / median over entities of the month))`` per entity and category."""
    rows = long.filter("v > 0").withColumn("_m", group_median("v", ["cat", "t"]))
    return (
        rows.groupBy("id", "cat")
        .agg(F.exp(F.avg(F.ln(F.col("v") / F.col("_m")))).alias("level"), F.count(F.lit(1)).alias("n_months"))
        .filter(F.col("n_months") >= least_months)
    )


def yoy(df: DataFrame, value: str, key: Sequence[str], lag: int = 12) -> DataFrame:
    """Value minus the value ``lag`` months before, by a self-join on the month, so gaps don't shift it."""
    before = df.select(*key, (F.col("t") + lag).alias("t"), F.col(value).alias("_before"))
    return df.join(before, [*key, "t"]).select(*key, "t", (F.col(value) - F.col("_before")).alias("diff"))


def detrend(df: DataFrame, key: str = "id", x: str = "t", y: str = "y") -> DataFrame:
    """Residuals of each entity's least-squares line, from two running moments per entity."""
    w = Window.partitionBy(key)
    slope = F.try_divide(F.covar_pop(x, y).over(w), F.var_pop(x).over(w))
    rows = df.select("*", slope.alias("_b"), F.avg(x).over(w).alias("_mx"), F.avg(y).over(w).alias("_my"))
    return rows.withColumn("resid", F.col(y) - F.col("_my") - F.coalesce("_b", F.lit(0.0)) * (F.col(x) - F.col("_mx"))).drop("_b", "_mx", "_my")


def chain_index(df: DataFrame, ratio: str, by: Sequence[str], order: str) -> Column:
    """Cumulative product of ratios, as a window column."""
    return F.exp(F.sum(F.ln(ratio)).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
