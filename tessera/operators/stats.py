"""Rank correlations, effect sizes, robust fits and tests as aggregations.

Every function takes a long table and group columns, and returns one row per
group; the group columns may be empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ranks import MAD_FACTOR, avg_rank

from .summaries import ranked, ranked_within

Names = Sequence[str]


def _pairs(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter(" and ".join(f"{c} is not null" for c in columns))


def _ranks(df: DataFrame, named: dict[str, str], by: Names, *keep: Column | str) -> DataFrame:
    """``by``, ``keep`` and average ranks ``name: value``; without groups no task holds the whole table."""
    kept = df.select(*by, *keep, *[F.col(v).alias(f"_{k}") for k, v in named.items()])
    rest = [c for c in kept.columns if c not in {f"_{k}" for k in named}]
    if by:
        return kept.select(*rest, *[avg_rank(f"_{k}", by).alias(k) for k in named])
    for k in named:
        kept = ranked(kept, f"_{k}", k)
    return kept.select(*rest, *named)


def pearson(x: str, y: str) -> Column:
    """Correlation over complete pairs as an aggregate; NaN where a side is constant, null without a pair."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    spread = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    # Spark computes every aggregate before a condition on it, and its own corr raises an error there.
    # Merged parts leave a constant's variance a little above 0, so its values tell.
    constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b)) | (spread == 0)
    return F.when(constant, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(x, y), spread))


def spearman(df: DataFrame, x: str, y: str, by: Names = (), least: int = 3) -> DataFrame:
    """Rank correlation over complete pairs; null under ``least`` pairs."""
    both = _ranks(_pairs(df, x, y), {"rx": x, "ry": y}, by)
    n = F.count(F.lit(1))
    return both.groupBy(*by).agg(F.when(n >= least, F.corr("rx", "ry")).alias("rho"), n.alias("n"))


def pair_ranks(df: DataFrame, x: str, y: str, by: Names, rx: str = "rx", ry: str = "ry") -> DataFrame:
    """``df`` with ranks of x and y among the complete pairs of a group, however large; null on other rows."""
    both = df.withColumns({"_x": F.when(F.col(y).isNotNull(), F.col(x)), "_y": F.when(F.col(x).isNotNull(), F.col(y))})
    return ranked_within(both, {rx: "_x", ry: "_y"}, by).drop("_x", "_y")


def rho(rx: str = "rx", ry: str = "ry", least: int = 3) -> Column:
    """Rank correlation as an aggregate of ``pair_ranks``; NaN where a side is constant, null under ``least`` pairs."""
    return F.when(F.count(rx) >= least, pearson(rx, ry))


def spearman_within(df: DataFrame, x: str, y: str, group: str, by: Names = ()) -> DataFrame:
    """Correlation of overall ranks centred within groups; groups of one row are left out."""
    w = Window.partitionBy(*by, group)
    both = _ranks(_pairs(df, x, y, group), {"rx": x, "ry": y}, by, group)
    centred = both.select(
        *by, (F.col("rx") - F.avg("rx").over(w)).alias("a"), (F.col("ry") - F.avg("ry").over(w)).alias("b"), F.count(F.lit(1)).over(w).alias("n")
    ).filter("n > 1")
    return centred.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b")))).alias("rho"),
        F.count(F.lit(1)).alias("n"),
    )


def partial_spearman(df: DataFrame, x: str, y: str, z: str, by: Names = ()) -> DataFrame:
    """Rank correlation of x and y with the ranks of z partialled out."""
    r = _ranks(_pairs(df, x, y, z), {f"r{i}": c for i, c in enumerate((x, y, z))}, by)
    agg = r.groupBy(*by).agg(F.corr("r0", "r1").alias("xy"), F.corr("r0", "r2").alias("xz"), F.corr("r1", "r2").alias("yz"), F.count(F.lit(1)).alias("n"))
    rho = F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))))
    return agg.select(*by, rho.alias("rho"), "n")


def correlation_matrix(df: DataFrame, columns: Names, by: Names = ()) -> DataFrame:
    """``a, b, rho``: rank correlation of all column pairs, each over its own complete pairs."""
    out = None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            one = spearman(df, a, b, by).select(*by, F.lit(a).alias("a"), F.lit(b).alias("b"), "rho")
            out = one if out is None else out.unionByName(one)
    return out


def mad(df: DataFrame, value: str, by: Names = ()) -> DataFrame:
    """Median and median absolute deviation per group."""
    w = Window.partitionBy(*by)
    rows = _pairs(df, value).select(*by, value, F.median(value).over(w).alias("_m"))
    return rows.groupBy(*by).agg(F.min("_m").alias("med"), F.median(F.abs(F.col(value) - F.col("_m"))).alias("mad"))


def robust_z(df: DataFrame, value: str, by: Names = (), out: str = "z") -> DataFrame:
    """``(x - median) / (1.4826 MAD)`` on every row; null where the MAD is zero."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_m", F.median(value).over(w))
    rows = rows.withColumn("_mad", F.median(F.abs(F.col(value) - F.col("_m"))).over(w))
    return rows.withColumn(out, F.try_divide(F.col(value) - F.col("_m"), MAD_FACTOR * F.col("_mad"))).drop("_m", "_mad")


def robust_scale(df: DataFrame, value: str, by: Names = (), out: str = "z") -> DataFrame:
    """Like ``robust_z``, with the standard deviation where the MAD is zero, and 0 where both are."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_m", F.median(value).over(w))
    rows = rows.withColumn("_mad", MAD_FACTOR * F.median(F.abs(F.col(value) - F.col("_m"))).over(w)).withColumn("_sd", F.stddev_pop(value).over(w))
    scale = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.col("_sd"))
    return rows.withColumn(out, F.coalesce(F.try_divide(F.col(value) - F.col("_m"), scale), F.when(F.col(value).isNotNull(), F.lit(0.0)))).drop("_m", "_mad", "_sd")


def weighted_quantile_icdf(df: DataFrame, value: str, weight: str, q: float, by: Names = ()) -> DataFrame:
    """Least value whose share of the weight reaches ``q``."""
    rows = _pairs(df, value, weight).filter(F.col(weight) > 0)
    w = Window.partitionBy(*by)
    cum = F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(w)
    return rows.select(*by, value, cum.alias("_c")).groupBy(*by).agg(F.min(F.when(F.col("_c") >= q - 1e-12, F.col(value))).alias("wq"))


def weighted_quantile_t7(df: DataFrame, value: str, weight: str, q: float, by: Names = ()) -> DataFrame:
    """Type-7 quantile with weights scaled to sum to the number of rows; equal weights give the plain one."""
    rows = _pairs(df, value, weight).filter(F.col(weight) > 0)
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    scaled = F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(w) * n
    h = (n - 1) * F.lit(q) + 1
    rows = rows.select(*by, value, scaled.alias("_c"), h.alias("_h"), (1e-9 * n).alias("_e"))
    at = F.floor(F.col("_h") + F.col("_e"))
    agg = rows.groupBy(*by).agg(
        F.min(F.when(F.col("_c") >= at - F.col("_e"), F.col(value))).alias("_lo"),
        F.min(F.when(F.col("_c") >= at + 1 - F.col("_e"), F.col(value))).alias("_hi"),
        F.max(F.greatest(F.col("_h") - at, F.lit(0.0))).alias("_f"),
    )
    return agg.select(*by, (F.col("_lo") + F.col("_f") * (F.coalesce("_hi", "_lo") - F.col("_lo"))).alias("wq"))


def weighted_mean(df: DataFrame, value: str, weight: str, by: Names = ()) -> DataFrame:
    has = F.col(value).isNotNull() & (F.col(weight) > 0)
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.when(has, F.col(value) * F.col(weight))), F.sum(F.when(has, F.col(weight)))).alias("wmean"))


def eta2(df: DataFrame, value: str, group: str, by: Names = ()) -> DataFrame:
    """Between-group share of the variance, plain and adjusted for the number of groups."""
    rows = _pairs(df, value, group)
    parts = rows.groupBy(*by, group).agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("c"), F.var_pop(value).alias("v"))
    w = Window.partitionBy(*by)
    parts = parts.withColumn("gm", F.sum(F.col("m") * F.col("c")).over(w) / F.sum("c").over(w))
    agg = parts.groupBy(*by).agg(
        F.sum(F.col("c") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("ssb"),
        F.sum(F.col("c") * F.col("v")).alias("ssw"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"),
    )
    e = F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw"))
    adjusted = 1 - (1 - e) * F.try_divide((F.col("n") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double"))
    return agg.select(*by, e.alias("eta2"), adjusted.alias("eta2_adj"), "n", "k")


def epsilon2(df: DataFrame, value: str, group: str, by: Names = ()) -> DataFrame:
    """Kruskal-Wallis H (with the correction for ties) over ``n - 1``."""
    rows = _ranks(_pairs(df, value, group), {"r": value}, by, group)
    parts = rows.groupBy(*by, group).agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("c"))
    between = parts.groupBy(*by).agg(F.sum(F.col("s") * F.col("s") / F.col("c")).alias("b"), F.sum("c").cast("double").alias("n"))
    ties = rows.groupBy(*by, "r").count().groupBy(*by).agg(F.sum(F.pow(F.col("count"), F.lit(3.0)) - F.col("count")).alias("t"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("b") - 3 * (n + 1)) / F.nullif(1 - F.col("t") / (F.pow(n, F.lit(3.0)) - n), F.lit(0.0))
    joined = between.join(ties, list(by)) if by else between.crossJoin(ties)
    return joined.select(*by, h.alias("h"), F.try_divide(h, n - 1).alias("epsilon2"))


def cliff_delta(df: DataFrame, value: str, high: str, by: Names = ()) -> DataFrame:
    """P(x > y) - P(x < y) for rows with ``high`` true against false; also the rank-sum U and its z."""
    rows = _ranks(_pairs(df, value, high), {"r": value}, by, F.col(high).alias("_h"))
    agg = rows.groupBy(*by).agg(
        F.sum(F.when(F.col("_h"), F.col("r"))).alias("r1"),
        F.count_if("_h").cast("double").alias("n1"), F.count_if(~F.col("_h")).cast("double").alias("n2"),
    )
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    both = F.col("n1") * F.col("n2")
    z = F.try_divide(u - both / 2, F.sqrt(both * (F.col("n1") + F.col("n2") + 1) / 12))
    return agg.select(*by, F.try_divide(2 * u, both).alias("_d"), u.alias("u"), z.alias("z")).select(*by, (F.col("_d") - 1).alias("delta"), "u", "z")


def smd(df: DataFrame, value: str, high: str, by: Names = ()) -> DataFrame:
    """Difference of means over the root of the mean of both variances."""
    h = F.col(high)
    agg = _pairs(df, value, high).groupBy(*by).agg(
        *[F.avg(F.when(c, F.col(value))).alias(f"m{i}") for i, c in enumerate((h, ~h))],
        *[F.var_samp(F.when(c, F.col(value))).alias(f"v{i}") for i, c in enumerate((h, ~h))],
    )
    return agg.select(*by, F.try_divide(F.col("m0") - F.col("m1"), F.sqrt((F.col("v0") + F.col("v1")) / 2)).alias("smd"))


def theil_sen(df: DataFrame, x: str, y: str, key: str, by: Names) -> DataFrame:
    """Median of pairwise slopes and median intercept; ``by`` must keep groups small (pairs within a group)."""
    rows = _pairs(df, x, y).select(*by, F.col(key).alias("_k"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    other = rows.select(*by, F.col("_k").alias("_k2"), F.col("_x").alias("_x2"), F.col("_y").alias("_y2"))
    slopes = rows.join(other, list(by)).filter("_k < _k2 and _x <> _x2").groupBy(*by).agg(
        F.median((F.col("_y2") - F.col("_y")) / (F.col("_x2") - F.col("_x"))).alias("slope")
    )
    return rows.join(slopes, list(by)).groupBy(*by).agg(
        F.min("slope").alias("slope"), F.median(F.col("_y") - F.col("slope") * F.col("_x")).alias("intercept")
    )


def fe_residuals(df: DataFrame, x: str, y: str, group: str, by: Names = ()) -> DataFrame:
    """Residuals of y on x with group effects: both demeaned, then one slope."""
    w, all_rows = Window.partitionBy(*by, group), Window.partitionBy(*by)
    rows = _pairs(df, x, y, group).select("*", (F.col(x) - F.avg(x).over(w)).alias("_x"), (F.col(y) - F.avg(y).over(w)).alias("_y"))
    slope = F.try_divide(F.sum(F.col("_x") * F.col("_y")).over(all_rows), F.sum(F.col("_x") * F.col("_x")).over(all_rows))
    return rows.withColumn("resid", F.col("_y") - F.coalesce(slope, F.lit(0.0)) * F.col("_x")).drop("_x", "_y")


def bh_qvalues(df: DataFrame, p: str = "p", by: Names = ()) -> DataFrame:
    """Benjamini-Hochberg q-values on every row."""
    w = Window.partitionBy(*by)
    m, k = F.count(p).over(w), F.rank().over(w.orderBy(F.desc(p)))
    rows = df.filter(F.col(p).isNotNull()).select("*", m.alias("_m"), (m - k + 1).alias("_k"))
    low = F.min(F.col(p) * F.col("_m") / F.col("_k")).over(w.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("q", F.least(low, F.lit(1.0))).drop("_m", "_k")


def holm(df: DataFrame, p: str = "p", tie: str = "id", by: Names = ()) -> DataFrame:
    """Holm-adjusted p-values on every row."""
    w = Window.partitionBy(*by)
    rows = df.filter(F.col(p).isNotNull()).withColumn("_s", (F.count(p).over(w) - F.row_number().over(w.orderBy(p, tie)) + 1) * F.col(p))
    return rows.withColumn("p_holm", F.least(F.max("_s").over(w.orderBy(p, tie).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_s")


def morans_i(values: DataFrame, weights: DataFrame) -> DataFrame:
    """Moran's I of ``id, x`` under pair weights ``a, b, w`` (rows normalised here)."""
    z = values.filter("x is not null").select("id", (F.col("x") - F.avg("x").over(Window.partitionBy())).alias("z"))
    normal = weights.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("a")))
    cross = normal.join(z.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").join(z.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
    top = cross.agg(F.sum(F.col("w") * F.col("za") * F.col("zb")).alias("num"), F.sum("w").alias("s0"))
    low = z.agg(F.sum(F.col("z") * F.col("z")).alias("den"), F.count(F.lit(1)).alias("n"))
    return top.crossJoin(low).select((F.col("n") / F.col("s0") * F.col("num") / F.col("den")).alias("moran_i"), "n")


def quantile_edges(df: DataFrame, value: str, q: int, by: Names = ()) -> DataFrame:
    """Inner value edges of ``q`` equal-count bins, by linear interpolation."""
    shares = F.array(*[F.lit(i / q) for i in range(1, q)])
    return df.groupBy(*by).agg(F.percentile(value, shares).alias("edges"))


def assign_bins(df: DataFrame, edges: DataFrame, value: str, by: Names = ()) -> DataFrame:
    """``bin``: number of edges below the value (bins closed on the right, equal values together)."""
    joined = df.join(edges, list(by)) if by else df.crossJoin(F.broadcast(edges))
    return joined.withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges")


def permutation_p(observed: Column, null_values: str) -> Column:
    """``(1 + #null >= observed) / (1 + #null)`` inside an aggregation."""
    return (1 + F.count_if(F.col(null_values) >= observed)) / (1 + F.count(null_values))
