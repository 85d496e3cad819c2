"""Versioned dimensions, entity resolution and annual context facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import version_distance

#: End year of a version that is still in force.
OPEN_YEAR = 9999


def interval_slice(versions: DataFrame, year: int | Column, last: int | None = None) -> DataFrame:
    """Versions in force at a year (``year_from <= y < year_to``), the year capped at ``last``."""
    y = F.lit(year) if isinstance(year, int) else year
    if last is not None:
        y = F.least(y, F.lit(last))
    return versions.filter((F.col("year_from") <= y) & (F.col("year_to") > y))


def slices(versions: DataFrame, years: Sequence[int]) -> DataFrame:
    """``year`` and the versions in force, for all years in one pass over the versions."""
    listed = F.array(*[F.lit(int(y)) for y in years])
    return versions.withColumn(
        "year", F.explode(F.filter(listed, lambda y: (F.col("year_from") <= y) & (F.col("year_to") > y)))
    )


def latest_versions(versions: DataFrame, year: int) -> DataFrame:
    """Per id the version in force, else the one that ended last."""
    active = (F.col("year_from") <= year) & (F.col("year_to") > year)
    w = Window.partitionBy("id").orderBy(active.desc(), F.desc("year_from"), F.desc("year_to"), "code")
    return versions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def select_priority(
    rows: DataFrame, key: Sequence[str], period_rank: Column, preferred: Column, order: Sequence[str], value: str = "value"
) -> DataFrame:
    """One row per key: best period, then preferred rows if there are any, then the first in order.

    ``dup_conflict`` tells that the rows that were left differ in value,
    ``fallback_period`` that the best period isn't the first choice.
    """
    w = Window.partitionBy(*key)
    best = rows.filter(F.col(value).isNotNull()).select("*", period_rank.alias("_p"), F.coalesce(preferred, F.lit(False)).alias("_s"))
    best = best.withColumn("_bp", F.min("_p").over(w)).filter("_p = _bp")
    best = best.withColumn("_any", F.max("_s").over(w)).filter("_s or not _any")
    best = best.select(
        "*",
        (F.min(value).over(w) != F.max(value).over(w)).alias("dup_conflict"),
        (F.col("_p") > 0).alias("fallback_period"),
        F.row_number().over(w.orderBy(*order)).alias("_n"),
    )
    return best.filter("_n = 1").drop("_p", "_s", "_bp", "_any", "_n")


def stable_pairs(bridge: DataFrame) -> DataFrame:
    """``code, stable`` pairs whose code has one image."""
    return bridge.groupBy("code").agg(F.min("stable").alias("stable"), F.max("stable").alias("_m")).filter("stable = _m").drop("_m")


def cascade_match(versions: DataFrame, rows: DataFrame, years: Sequence[int]) -> DataFrame:
    """``id, year, code, value, method`` by direct, then version, then stable code.

    ``versions``: ``id, code, stable, year_from, year_to``; ``rows``: ``code,
    year, value`` with the source's ``stable``.  A direct match is the code in
    force; a version match another code of the same id that is no id's direct
    code, the nearest version to the year, the later on ties; a stable match
    needs a stable code owned by one id of the slice and a single candidate
    code that is no direct code.
    """
    here = slices(versions, years).select("id", "year", F.col("code").alias("own"), "stable")
    direct = here.join(rows.select("year", F.col("code").alias("own"), "value"), ["year", "own"]).select(
        "id", "year", F.col("own").alias("code"), "value", F.lit("direct").alias("method")
    )
    left = here.join(direct.select("id", "year").distinct(), ["id", "year"], "left_anti")
    taken = here.select("year", F.col("own").alias("code"))
    free = rows.join(taken, ["year", "code"], "left_anti")
    near = Window.partitionBy("id", "year").orderBy("_d", F.desc("year_from"), "code")
    version = (
        left.select("id", "year")
        .join(versions.select("id", "code", "year_from", "year_to"), "id")
        .withColumn("_d", version_distance("year", "year_from", "year_to"))
        .join(free.select("code", "year", "value"), ["code", "year"])
        .withColumn("_n", F.row_number().over(near))
        .filter("_n = 1")
        .select("id", "year", "code", "value", F.lit("version").alias("method"))
    )
    left = left.join(version.select("id", "year"), ["id", "year"], "left_anti")
    owners = here.filter("stable is not null").groupBy("year", "stable").agg(F.countDistinct("id").alias("_owners")).filter("_owners = 1")
    stable = (
        left.join(owners.select("year", "stable"), ["year", "stable"])
        .join(free.filter("stable is not null").select("year", "stable", "code", "value"), ["year", "stable"])
        .groupBy("id", "year")
        .agg(F.min("code").alias("code"), F.max("code").alias("_last"), F.min(F.struct("code", "value")).alias("_v"))
        .filter("code = _last")
        .select("id", "year", "code", F.col("_v.value").alias("value"), F.lit("stable").alias("method"))
    )
    return direct.unionByName(version).unionByName(stable)


def unmatched(versions: DataFrame, rows: DataFrame, matched: DataFrame, years: Sequence[int]) -> DataFrame:
    """``id, year, reason`` of slice entities without a match; the last reason that holds wins.

    ``no_code`` (no code at all), ``union_banned`` (stable code shared), ``multi_row``
    (several candidates), ``region_no_rows`` (no row of the code's region that year).
    """
    here = slices(versions, years).select("id", "year", "code", "stable")
    lost = here.join(matched.select("id", "year").distinct(), ["id", "year"], "left_anti")
    shared = here.groupBy("year", "stable").agg(F.countDistinct("id").alias("_owners"))
    candidates = rows.groupBy("year", "stable").agg(F.countDistinct("code").alias("_codes"))
    regions = rows.select("year", F.substring("code", 1, 2).alias("_region")).distinct().withColumn("_seen", F.lit(True))
    found = (
        lost.join(shared, ["year", "stable"], "left")
        .join(candidates, ["year", "stable"], "left")
        .withColumn("_region", F.substring("code", 1, 2))
        .join(regions, ["year", "_region"], "left")
    )
    reason = (
        F.when(F.col("_seen").isNull(), "region_no_rows")
        .when(F.col("_codes") > 1, "multi_row")
        .when(F.col("_owners") > 1, "union_banned")
        .otherwise("no_code")
    )
    return found.select("id", "year", reason.alias("reason"))


def carry_forward(df: DataFrame, key: str = "id", year: str = "year", value: str = "value") -> DataFrame:
    """Values of zero or less become null; a null takes the observed value of the year before.

    Adds ``zero_replaced`` and ``carried``; only observed values are carried.
    """
    w = Window.partitionBy(key).orderBy(year)
    seen = F.when(F.col(value) > 0, F.col(value))
    rows = df.select("*", seen.alias("_v"), F.coalesce(F.col(value) <= 0, F.lit(False)).alias("zero_replaced"))
    before = F.when(F.lag(year).over(w) == F.col(year) - 1, F.lag("_v").over(w))
    rows = rows.withColumn("_b", before)
    return rows.withColumn("carried", F.col("_v").isNull() & F.col("_b").isNotNull()).withColumn(
        value, F.coalesce("_v", "_b")
    ).drop("_v", "_b")


def jump_flags(df: DataFrame, key: str = "id", year: str = "year", amount: str = "amount", heads: str = "heads") -> DataFrame:
    """Flag the odd side of a jump in ``heads`` (ten-fold) while ``amount`` stays within a factor of two.

    Of two consecutive years the one with fewer heads is flagged, if its amount
    per head is further from the year's median, on a log scale.
    """
    rate = F.try_divide(F.col(amount), F.col(heads))
    rows = df.select("*", rate.alias("_r"))
    rows = rows.withColumn("_dev", F.abs(F.ln(F.try_divide(F.col("_r"), F.median("_r").over(Window.partitionBy(year))))))
    w = Window.partitionBy(key).orderBy(year)

    def odd(step) -> Column:
        near = F.abs(step(year) - F.col(year)) == 1
        calm = F.try_divide(F.col(amount), step(amount)).between(0.5, 2.0)
        ratio = F.try_divide(F.col(heads), step(heads))
        return F.coalesce(near & calm & (ratio <= 0.1) & (F.col("_dev") > step("_dev")), F.lit(False))

    flag = odd(lambda c: F.lag(c).over(w)) | odd(lambda c: F.lead(c).over(w))
    return rows.withColumn("jump", flag).drop("_r", "_dev")


def neighbour_year_ok(df: DataFrame, low: float, high: float, key: str = "id", year: str = "year", value: str = "value") -> DataFrame:
    """``ok``: a known neighbour year exists and all known ones are within the bounds."""
    w = Window.partitionBy(key).orderBy(year)
    sides = [F.when(F.abs(s(year).over(w) - F.col(year)) == 1, s(value).over(w)) for s in (F.lag, F.lead)]
    fine = [F.coalesce(x.between(low, high), F.lit(True)) for x in sides]
    known = sides[0].isNotNull() | sides[1].isNotNull()
    return df.withColumn("ok", known & fine[0] & fine[1])


def weighted_rollup(df: DataFrame, by: Sequence[str], value: str, weight: str, least_cover: float) -> DataFrame:
    """Weighted mean over members with a value, if they carry enough of the group's weight."""
    has = F.col(value).isNotNull() & (F.col(weight) > 0)
    agg = df.groupBy(*by).agg(
        F.sum(F.when(has, F.col(value) * F.col(weight))).alias("_wv"),
        F.sum(F.when(has, F.col(weight))).alias("_w"),
        F.sum(weight).alias("_all"),
        F.count(F.lit(1)).alias("n_members"),
    )
    cover = F.coalesce(F.try_divide(F.col("_w"), F.col("_all")), F.lit(0.0))
    return agg.select(*by, F.when(cover >= least_cover, F.try_divide(F.col("_wv"), F.col("_w"))).alias("value"), cover.alias("coverage"), "n_members")


def renormalised_shares(df: DataFrame, key: Sequence[str], value: str, whole: str) -> DataFrame:
    """Shares of a whole; where they sum to more than one they are divided by the sum."""
    share = F.try_divide(F.col(value), F.col(whole))
    rows = df.withColumn("_s", share).withColumn("_sum", F.sum("_s").over(Window.partitionBy(*key)))
    return rows.withColumn("share", F.col("_s") / F.greatest(F.col("_sum"), F.lit(1.0))).drop("_s", "_sum")


def month_list(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """``t, ym``: every month of the years, from 0."""
    months = (last_year - first_year + 1) * 12
    start = F.make_date(F.lit(first_year), F.lit(1), F.lit(1))
    return spark.range(months).select(F.col("id").cast("int").alias("t"), F.date_format(F.add_months(start, F.col("id").cast("int")), "yyyy-MM").alias("ym"))


def lookup_codes(rows: DataFrame, code: str, mapping: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name`` from ``mapping`` (``code``, ``name``); a code that it lacks raises, null stays null."""
    named = mapping.select(F.col(code).alias("_code"), F.col(name).alias("_name"))
    found = rows.join(named, rows[code] == F.col("_code"), "left")
    value = F.when(F.col(code).isNull() | F.col("_code").isNotNull(), F.col("_name")).otherwise(
        F.raise_error(F.concat(F.lit("no entry for code "), F.col(code).cast("string")))
    )
    return found.withColumn(name, value).drop("_code", "_name")


def relative_density(df: DataFrame, size: str, area: str, group: str) -> DataFrame:
    """``df`` with ``density``: ln of size over area, less its group's median; null unless both are positive."""
    ln = F.when((F.col(size) > 0) & (F.col(area) > 0), F.ln(F.col(size) / F.col(area)))
    logged = df.withColumn("_ln", ln)
    middle = logged.groupBy(F.col(group).alias("_g")).agg(F.median("_ln").alias("_m"))
    return logged.join(middle, F.col(group).eqNullSafe(F.col("_g"))).withColumn("density", F.col("_ln") - F.col("_m")).drop("_ln", "_g", "_m")


def signatures(rows: DataFrame, key: str, dims: Sequence[str]) -> DataFrame:
    """``key, signature``: the distinct values of ``dims``, sorted, as ``a=b;...``: equal for keys with the same rows."""
    pair = F.concat_ws("=", *[F.coalesce(F.col(d).cast("string"), F.lit("")) for d in dims])
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(pair)), ";").alias("signature"))
