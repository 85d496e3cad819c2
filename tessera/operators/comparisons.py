"""Runs, gated and filled weights, profiles, agreement of partitions and choices among candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .summaries import beside

#: Fixed value: expected range of twelve standard normal draws.
RANGE_OF_TWELVE = 3.258


def longest_run(df: DataFrame, key: str, order: str, holds: Column, out: str = "run") -> DataFrame:
    """``key, run``: the longest stretch of consecutive whole ``order`` values whose rows hold; 0 without any."""
    marked = df.select(key, F.col(order).alias("_o"), F.coalesce(holds, F.lit(False)).alias("_h"))
    island = F.col("_o") - F.row_number().over(Window.partitionBy(key, "_h").orderBy("_o"))
    lengths = marked.select(key, "_h", island.alias("_i")).groupBy(key, "_h", "_i").agg(F.count(F.lit(1)).alias("_n"))
    return lengths.groupBy(key).agg(F.max(F.when(F.col("_h"), F.col("_n")).otherwise(0)).alias(out))


def fill_from_years(df: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """``df`` with nulls filled from the nearest year before, else from the nearest after."""
    w = Window.partitionBy(key).orderBy(year)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(before, after))


def covered(known: Column, weight: str | Column, least: float) -> Column:
    """Aggregate: whether rows that are known carry the least share of the weight."""
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.coalesce(F.try_divide(F.sum(F.when(known, w)).cast("double"), F.sum(w).cast("double")), F.lit(0.0)) >= least - 1e-12


def cell_codes(df: DataFrame, a: str, b: str, out: str = "code") -> DataFrame:
    """``df`` with a dense number from 0 of each pair that occurs; the pairs are far fewer than the rows."""
    w = Window.orderBy("_a", "_b")
    cells = df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct().withColumn(out, (F.row_number().over(w) - 1).cast("int"))
    return df.join(cells, F.col(a).eqNullSafe(F.col("_a")) & F.col(b).eqNullSafe(F.col("_b"))).drop("_a", "_b")


def ratio_profile(df: DataFrame, key: str, year: Column, month: Column, value: str) -> DataFrame:
    """``m, med, iqr``: spread over series of each month's ratio to its year's mean; years with all twelve months."""
    w = Window.partitionBy(key, "_y")
    rows = df.select(key, year.alias("_y"), month.alias("m"), value)
    rows = rows.select("*", F.avg(value).over(w).alias("_mean"), F.count(value).over(w).alias("_n")).filter("_n = 12")
    q = F.percentile(F.col(value) / F.col("_mean"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy("m").agg(q.alias("_q")).select("m", F.col("_q")[1].alias("med"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"))


def noise_amplitude(deviation: Column) -> Column:
    """Range that noise alone gives a mean profile of twelve months from two years."""
    return RANGE_OF_TWELVE * deviation / F.sqrt(F.lit(2.0))


def shrunk_amplitude(amplitude: Column, reproducibility: Column) -> Column:
    return amplitude * F.greatest(reproducibility, F.lit(0.0))


def skewness(value: str) -> Column:
    """Aggregate: third standardised moment of the population."""
    return F.skewness(value)


def rand_adjusted(cells: DataFrame, by: Sequence[str], x: str, y: str, n: str) -> DataFrame:
    """``by, ari, n`` from contingency counts: one row per cell, whatever the number of elements."""

    def pairs(c: Column) -> Column:
        return c.cast("double") * (c - 1) / 2

    inside = cells.groupBy(*by).agg(F.sum(pairs(F.col(n))).alias("_c"), F.sum(n).alias("n"))
    sides = []
    for side, name in ((x, "_a"), (y, "_b")):
        margin = cells.groupBy(*by, side).agg(F.sum(n).alias("_m"))
        sides.append(margin.groupBy(*by).agg(F.sum(pairs(F.col("_m"))).alias(name)))
    joined = inside
    for s in sides:
        joined = joined.join(s, list(by)) if by else joined.crossJoin(F.broadcast(s))
    expected = F.col("_a") * F.col("_b") / pairs(F.col("n"))
    ari = F.try_divide(F.col("_c") - expected, (F.col("_a") + F.col("_b")) / 2 - expected)
    return joined.select(*by, F.coalesce(ari, F.lit(1.0)).alias("ari"), "n")


def agreement(labels: DataFrame) -> DataFrame:
    """``p, q, ari, n`` for all pairs of candidates of ``cand, id, label``, over the elements both label."""
    a = labels.select("id", F.col("cand").alias("p"), F.col("label").alias("x"))
    b = labels.select("id", F.col("cand").alias("q"), F.col("label").alias("y"))
    cells = a.join(b, "id").filter("p < q").groupBy("p", "q", "x", "y").agg(F.count(F.lit(1)).alias("_n"))
    return rand_adjusted(cells, ["p", "q"], "x", "y", "_n")


def feasibility(labels: DataFrame, least_share: float, noise: int = -1) -> DataFrame:
    """``cand, k, least, noise, entropy, ok``: size of the smallest cluster, share of noise, normalised entropy of sizes."""
    sizes = labels.groupBy("cand", "label").agg(F.count(F.lit(1)).alias("_n"))
    is_noise = F.col("label") == noise
    whole = F.sum("_n").over(Window.partitionBy("cand"))
    kept = F.sum(F.when(~is_noise, F.col("_n"))).over(Window.partitionBy("cand"))
    share = F.when(~is_noise, F.col("_n") / kept.cast("double"))
    rows = sizes.select("cand", "label", "_n", whole.alias("_all"), share.alias("_p"))
    r = rows.groupBy("cand").agg(
        F.count("_p").alias("k"), F.min(F.when(~is_noise, F.col("_n") / F.col("_all").cast("double"))).alias("least"),
        F.coalesce(F.sum(F.when(is_noise, F.col("_n") / F.col("_all").cast("double"))), F.lit(0.0)).alias("noise"), (-F.sum(F.col("_p") * F.ln("_p"))).alias("_e"),
    )
    entropy = F.when(F.col("k") > 1, F.col("_e") / F.ln(F.col("k").cast("double"))).otherwise(0.0)
    return r.select("cand", "k", "least", "noise", entropy.alias("entropy"), F.coalesce((F.col("k") > 1) & (F.col("least") >= least_share), F.lit(False)).alias("ok"))


def winners(scores: DataFrame, by: Sequence[str], score: str, tie: str, feasible: Column | None = None) -> DataFrame:
    """Best feasible candidate of every group: highest score, then least ``tie``."""
    rows = scores if feasible is None else scores.filter(feasible)
    best = rows.groupBy(*by).agg(F.max(F.struct(F.col(score), (-F.col(tie)).alias("_t"))).alias("_b"))
    return best.select(*by, (-F.col("_b._t")).alias(tie), F.col(f"_b.{score}").alias(score))


def threshold_grid(scores: DataFrame, share: str, thresholds: Sequence[float], score: str, tie: str) -> DataFrame:
    """``threshold`` and its winner among candidates whose share reaches it."""
    grid = F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col(share)))
    return winners(scores.withColumn("threshold", grid), ["threshold"], score, tie)


def baseline_percentile(value: Column, base: Column) -> Column:
    """Aggregate over null values: share below plus half the share equal."""
    return (F.count_if(base < value) + 0.5 * F.count_if(base == value)) / F.count(base)


def subsample_interval(value: Column, low: Column, high: Column, m: int, n: Column) -> tuple[Column, Column]:
    """Interval of a value from the quantiles of m-of-n subsamples, rescaled to n."""
    scale = F.sqrt(F.lit(float(m)) / (n - m))
    return value - (high - value) * scale, value - (low - value) * scale


def expected_adjusted(value: Column, expected: Column) -> Column:
    """``(value - expected) / (1 - expected)``: 1 is perfect, 0 is chance."""
    return F.try_divide(value - expected, 1 - expected)


def resolution_limit(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, inside, limit, below``: weight inside each group against ``sqrt(2 m)``, m the weight of all edges."""
    ends = [labels.select(F.col("id").alias(c), F.col("label").alias(f"_{c}")) for c in "ab"]
    met = edges.join(ends[0], "a").join(ends[1], "b")
    inside = met.groupBy(F.col("_a").alias("label")).agg(F.coalesce(F.sum(F.when(F.col("_a") == F.col("_b"), F.col("w"))), F.lit(0.0)).alias("inside"))
    groups = labels.select("label").distinct().join(inside, "label", "left").withColumn("inside", F.coalesce("inside", F.lit(0.0)))
    limit = F.broadcast(edges.agg(F.sqrt(2 * F.sum("w")).alias("limit")))
    return groups.crossJoin(limit).withColumn("below", F.col("inside") < F.col("limit"))


def mean_stratified_delta(df: DataFrame, value: str, high: Column, stratum: str) -> DataFrame:
    """``delta, strata``: mean over strata with both sides of the difference of means."""
    d = df.groupBy(stratum).agg((F.avg(F.when(high, F.col(value))) - F.avg(F.when(~high, F.col(value)))).alias("_d")).filter("_d is not null")
    return d.agg(F.avg("_d").alias("delta"), F.count(F.lit(1)).alias("strata"))


def partial_two(df: DataFrame, x: str, y: str, z: Sequence[str]) -> DataFrame:
    """``r``: correlation of x and y with two controls partialled out, by recursion over one row of correlations."""
    u, v = z
    pairs = [(x, y), (x, u), (y, u), (x, v), (y, v), (u, v)]
    row = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    xy, xu, yu, xv, yv, uv = [F.col(f"_{i}") for i in range(6)]

    def partial(ab: Column, ac: Column, bc: Column) -> Column:
        return F.try_divide(ab - ac * bc, F.sqrt((1 - ac * ac) * (1 - bc * bc)))

    return row.select(partial(partial(xy, xu, yu), partial(xv, xu, uv), partial(yv, yu, uv)).alias("r"))


def counterfactual_gain(df: DataFrame, part: tuple[str, str], whole: tuple[str, str]) -> DataFrame:
    """``df`` with ``gain``: change of a share had every whole grown by the median factor."""
    grown = beside(df, F.median(F.try_divide(F.col(whole[1]), F.col(whole[0]))).alias("_g"))
    gain = F.try_divide(F.col(part[1]), F.col(whole[0]) * F.col("_g")) - F.try_divide(F.col(part[0]), F.col(whole[0]))
    return grown.withColumn("gain", gain).drop("_g")
