"""Cluster-validity indices as aggregations over points or edges with labels.

Label -1 is noise and takes no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import both_ways


def _square(x: Column) -> Column:
    return x * x


def silhouette(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """Silhouette of each point from pair distances ``a, b, d``; 0 for clusters of one."""
    lab = labels.filter("label >= 0")
    near = both_ways(distances, "d").join(lab.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b").groupBy("a", "lb").agg(F.avg("d").alias("m"))
    size = lab.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("label")))
    rows = size.join(near, size["id"] == near["a"], "left")
    agg = rows.groupBy("id", "label", "_n").agg(
        F.min(F.when(F.col("lb") == F.col("label"), F.col("m"))).alias("own"), F.min(F.when(F.col("lb") != F.col("label"), F.col("m"))).alias("other")
    )
    s = F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other"))
    return agg.select("id", "label", F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(F.coalesce(s, F.lit(0.0))).alias("silhouette"))


def silhouette_squared(points: DataFrame) -> DataFrame:
    """Silhouette of each long point ``id, label, j, x`` under squared Euclidean distance.

    A point's mean distance to a cluster follows from the cluster's size, mean
    and mean square, so no pairs are made; clusters of one have 0.
    """
    p = points.filter("label >= 0")
    size = p.groupBy("label").agg(F.countDistinct("id").alias("n"))
    moments = p.groupBy("label", "j").agg(F.avg("x").alias("m"), F.avg(_square(F.col("x"))).alias("q"))
    near = (
        p.join(moments.select(F.col("label").alias("lb"), "j", "m", "q"), "j")
        .groupBy("id", "label", "lb")
        .agg(F.sum(_square(F.col("x")) - 2 * F.col("x") * F.col("m") + F.col("q")).alias("d"))
        .join(size.select(F.col("label").alias("lb"), "n"), "lb")
    )
    own, same = F.col("label") == F.col("lb"), F.try_divide(F.col("d") * F.col("n"), (F.col("n") - 1).cast("double"))
    agg = near.groupBy("id", "label").agg(F.min(F.when(own, same)).alias("own"), F.min(F.when(~own, F.col("d"))).alias("other"))
    s = F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other"))
    return agg.select("id", "label", F.coalesce(s, F.lit(0.0)).alias("silhouette"))


def centers(points: DataFrame) -> DataFrame:
    """``label, j, c, n``: cluster means of long points ``id, label, j, x``."""
    return points.filter("label >= 0").groupBy("label", "j").agg(F.avg("x").alias("c"), F.count(F.lit(1)).alias("n"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """Between over within variance of long points ``id, label, j, x``; null for fewer than two clusters."""
    p = points.filter("label >= 0")
    parts = p.groupBy("label", "j").agg(F.avg("x").alias("c"), F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("v"))
    w = Window.partitionBy("j")
    parts = parts.withColumn("g", F.sum(F.col("c") * F.col("n")).over(w) / F.sum("n").over(w))
    agg = parts.agg(
        F.sum(F.col("n") * _square(F.col("c") - F.col("g"))).alias("b"), F.sum(F.col("n") * F.col("v")).alias("s"),
        F.countDistinct("label").cast("double").alias("k"), F.countDistinct("j").alias("d"), F.sum("n").alias("nd"),
    )
    n = F.col("nd").cast("double") / F.col("d")
    return agg.select(F.try_divide(F.try_divide(F.col("b"), F.col("k") - 1), F.try_divide(F.col("s"), n - F.col("k"))).alias("ch"))


def cluster_matrix(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``k, l, m``: edge weight between clusters, over ordered pairs."""
    lab = labels.filter("label >= 0")
    return (
        both_ways(edges, "w")
        .join(lab.select(F.col("id").alias("a"), F.col("label").alias("k")), "a")
        .join(lab.select(F.col("id").alias("b"), F.col("label").alias("l")), "b")
        .groupBy("k", "l")
        .agg(F.sum("w").alias("m"))
    )


def _volumes(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("k").agg(F.sum("m").alias("vol"), F.sum(F.when(F.col("k") == F.col("l"), F.col("m")).otherwise(0.0)).alias("own"))


def modularity(matrix: DataFrame, gamma: float = 1.0) -> DataFrame:
    v = _volumes(matrix)
    v = v.withColumn("_2w", F.sum("vol").over(Window.partitionBy()))
    return v.agg(F.sum(F.col("own") / F.col("_2w") - gamma * _square(F.col("vol") / F.col("_2w"))).alias("modularity"))


def isolability_unifiability(matrix: DataFrame) -> DataFrame:
    """``avi, avu, anui``: mean isolability, mean unifiability and their combination."""
    v = _volumes(matrix).select("k", "vol", (F.col("vol") - F.col("own")).alias("out"), F.try_divide(F.col("own"), F.col("vol")).alias("iso"))
    size = v.agg(F.avg("iso").alias("avi"), F.count(F.lit(1)).cast("double").alias("n"))
    cross = (
        matrix.filter("k <> l")
        .join(v.select("k", F.col("out").alias("ok")), "k")
        .join(v.select(F.col("k").alias("l"), F.col("out").alias("ol")), "l")
        .agg(F.coalesce(F.sum(F.try_divide(F.col("m"), F.col("ok") + F.col("ol") - F.col("m"))), F.lit(0.0)).alias("u"))
    )
    avu = F.try_divide(F.col("u"), F.col("n"))
    return size.crossJoin(cross).select("avi", avu.alias("avu"), F.try_divide(F.col("avi"), 1 + F.col("avi") * avu).alias("anui"))


def s_dbw_scatter(points: DataFrame) -> DataFrame:
    """The scatter term of S_Dbw: mean norm of cluster variances over the norm of the whole variance."""
    p = points.filter("label >= 0")
    own = p.groupBy("label", "j").agg(F.var_pop("x").alias("v")).groupBy("label").agg(F.sqrt(F.sum(_square(F.col("v")))).alias("s"))
    whole = p.groupBy("j").agg(F.var_pop("x").alias("v")).agg(F.sqrt(F.sum(_square(F.col("v")))).alias("t"))
    return own.agg(F.avg("s").alias("a")).crossJoin(whole).select(F.try_divide(F.col("a"), F.col("t")).alias("scat"))


def s_dbw_density(points: DataFrame) -> DataFrame:
    """The density term of S_Dbw: points within one mean deviation of midpoints against those of centres.

    Density counts points of the two clusters only; pairs whose centres have no
    point near are left out of the sum.
    """
    p = points.filter("label >= 0")
    spread = p.groupBy("label", "j").agg(F.var_pop("x").alias("v")).groupBy("label").agg(F.sqrt(F.sum(_square(F.col("v")))).alias("s"))
    radius = spread.agg((F.sqrt(F.sum("s")) / F.count(F.lit(1))).alias("r"), F.count(F.lit(1)).cast("double").alias("k"))
    c = centers(points).select("label", "j", "c")
    two = c.join(c.select(F.col("label").alias("other"), "j", F.col("c").alias("c2")), "j").filter("label < other")
    spots = F.explode(F.array(
        F.struct(F.lit("mid").alias("at"), ((F.col("c") + F.col("c2")) / 2).alias("u")), F.struct(F.lit("one").alias("at"), F.col("c").alias("u")),
        F.struct(F.lit("two").alias("at"), F.col("c2").alias("u")),
    ))
    spot = two.select("label", "other", "j", spots.alias("s")).select("label", "other", "j", "s.at", "s.u")
    near = (
        spot.join(p.select("id", "j", "x", F.col("label").alias("own")), "j")
        .filter("own = label or own = other")
        .groupBy("label", "other", "at", "id")
        .agg(F.sqrt(F.sum(_square(F.col("x") - F.col("u")))).alias("d"))
        .crossJoin(F.broadcast(radius))
        .groupBy("label", "other")
        .agg(*[F.count_if((F.col("at") == a) & (F.col("d") <= F.col("r"))).cast("double").alias(a) for a in ("mid", "one", "two")], F.max("k").alias("k"))
    )
    ratio = F.try_divide(F.col("mid"), F.greatest("one", "two"))
    return near.agg((2 * F.coalesce(F.sum(ratio), F.lit(0.0)) / (F.max("k") * (F.max("k") - 1))).alias("dens_bw"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """Adjusted Rand index from a contingency table ``x, y, c``."""
    def two(c: Column) -> Column:
        return c * (c - 1) / F.lit(2.0)

    rows = table.groupBy("x").agg(F.sum("c").alias("c")).agg(F.sum(two(F.col("c"))).alias("sx"), F.sum("c").alias("n"))
    cols = table.groupBy("y").agg(F.sum("c").alias("c")).agg(F.sum(two(F.col("c"))).alias("sy"))
    cells = table.agg(F.sum(two(F.col("c"))).alias("s"))
    all_ = F.try_divide(F.col("sx") * F.col("sy"), two(F.col("n")))
    return rows.crossJoin(cols).crossJoin(cells).select(F.try_divide(F.col("s") - all_, (F.col("sx") + F.col("sy")) / 2 - all_).alias("ari"))
