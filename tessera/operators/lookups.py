"""Entity-to-node lookups, absent members, canonical edges, orders, margins and spatial weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels whose centres are sent to every task.
MOST_CENTRES = 4096


def members(entities: DataFrame, parts: DataFrame, mode: str) -> DataFrame:
    """``id, node`` of entities; those in ``parts`` (``id, whole``) stay themselves, become the whole or go.

    ``mode``: ``self``, ``collapse`` or ``exclude``.
    """
    met = entities.select("id").join(parts.select("id", "whole"), "id", "left")
    node = {"self": F.col("id"), "collapse": F.coalesce("whole", "id"), "exclude": F.col("id")}[mode]
    return (met.filter("whole is null") if mode == "exclude" else met).select("id", node.alias("node"))


def nodes_of(df: DataFrame, lookup: DataFrame, key: str = "id") -> DataFrame:
    """``df`` with ``node``; entities that the lookup lacks are their own node."""
    return df.join(lookup.select(F.col("id").alias("_i"), F.col("node").alias("_n")), F.col(key) == F.col("_i"), "left").withColumn("node", F.coalesce("_n", key)).drop("_i", "_n")


def absent_groups(groups: DataFrame, present: DataFrame, group: str) -> DataFrame:
    """Groups without any present member."""
    return groups.select(group).distinct().join(present.select(group).distinct(), group, "left_anti")


def missing_members(entities: DataFrame, present: DataFrame, group: str) -> DataFrame:
    """``id`` and group of absent entities whose group has others that are present."""
    marked = entities.select("id", group).join(present.select("id", F.lit(True).alias("_p")).distinct(), "id", "left")
    some = F.max(F.coalesce("_p", F.lit(False))).over(Window.partitionBy(group))
    return marked.withColumn("_s", some).filter("_s and _p is null").select("id", group)


def edge_set(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs; loops go."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def value_quantiles(df: DataFrame, value: str, q: int, out: str = "bin") -> DataFrame:
    """``df`` with a bin from 0 by quantile edges of the value; equal edges are merged, equal values stay together."""
    shares = F.array(*[F.lit(i / q) for i in range(1, q)])
    edges = F.broadcast(df.agg(F.array_distinct(F.percentile(value, shares)).alias("_e")))
    return df.crossJoin(edges).withColumn(out, F.size(F.filter("_e", lambda e: e < F.col(value)))).drop("_e")


def type_mean_ranks(df: DataFrame, label: str, value: str) -> DataFrame:
    """``label, m, r``: every row takes its type's mean; ranks of these over all rows, ties averaged, from counts by type."""
    types = df.groupBy(label).agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.orderBy("m").rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    tied = F.sum("_n").over(Window.partitionBy("m"))
    return types.select(label, "m", (below - tied + (tied + 1) / 2.0).alias("r"))


def centre_margins(points: DataFrame, vector: str, label: str) -> DataFrame:
    """``points`` with ``near`` (label of the nearest centre), ``d`` and ``margin`` to the second nearest.

    All centres travel in one row; more than ``MOST_CENTRES`` labels are an error.
    """
    v = points.select(label, F.posexplode(vector).alias("_j", "_x"))
    means = v.groupBy(label, "_j").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    centres = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", "_m"))), lambda s: s["_m"]).alias("_c"))
    few = F.when(F.count(F.lit(1)) <= MOST_CENTRES, True).otherwise(F.raise_error(F.lit("too many labels for one row of centres")).cast("boolean"))
    listed = centres.agg(few.alias("_few"), F.collect_list(F.struct(F.col(label).alias("l"), F.col("_c").alias("c"))).alias("_cs"))
    listed = F.broadcast(listed.filter("_few").drop("_few"))

    def distance(c: Column) -> Column:
        squares = F.zip_with(F.col(vector), c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))

    ranked = F.array_sort(F.transform("_cs", lambda c: F.struct(distance(c["c"]).alias("d"), c["l"].alias("l"))))
    found = points.crossJoin(listed).withColumn("_r", ranked)
    first, second = F.try_element_at("_r", F.lit(1)), F.try_element_at("_r", F.lit(2))
    return found.withColumns({"near": first["l"], "d": first["d"], "margin": second["d"] - first["d"]}).drop("_cs", "_r")


def neighbour_weights(distances: DataFrame, k: int) -> DataFrame:
    """``a, b, w``: weight ``1 / k`` of the k nearest of each ``a``, from ``a, b, d`` in both directions; ties by ``b``."""
    w = Window.partitionBy("a").orderBy("d", "b")
    near = distances.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    return near.select("a", "b", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("a"))).alias("w"))


def up_down(moves: DataFrame, ranks: DataFrame) -> DataFrame:
    """``up, down, stay`` of moves ``x, y, n`` between labels with ranks ``label, rank``; unranked labels don't count."""
    x, y = [ranks.select(F.col("label").alias(c), F.col("rank").alias(f"_{c}")) for c in "xy"]
    met = moves.join(x, "x").join(y, "y")
    gap = F.col("_y") - F.col("_x")
    return met.agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (("up", gap > 0), ("down", gap < 0), ("stay", gap == 0))])


def mantel(x: DataFrame, y: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """``r, p, rounds``: correlation of two pair tables ``a, b, d`` (a < b), and the share of node permutations that reach it.

    A permutation is the order of MD5 digests of round and node; every round
    is rows of one plan.
    """
    numbered = nodes.select("id", F.row_number().over(Window.orderBy("id")).alias("_k"))
    drawn = nodes.select("id", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("_r"))
    order = Window.partitionBy("_r").orderBy(F.md5(F.concat_ws(":", F.col("_r").cast("string"), F.col("id").cast("string"))), "id")
    moved = drawn.select("_r", "id", F.row_number().over(order).alias("_k")).join(numbered.withColumnRenamed("id", "_to"), "_k")
    moved = moved.select("_r", "id", "_to").unionByName(nodes.select(F.lit(0).alias("_r"), "id", F.col("id").alias("_to")))
    ends = [moved.select("_r", F.col("id").alias(c), F.col("_to").alias(f"_{c}")) for c in "ab"]
    shifted = x.select("a", "b", F.col("d").alias("_x")).join(ends[0], "a").join(ends[1], ["_r", "b"])
    met = shifted.select("_r", "_x", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).join(y.select("a", "b", F.col("d").alias("_y")), ["a", "b"])
    each = met.groupBy("_r").agg(F.round(F.corr("_x", "_y"), 9).alias("_c"))
    both = each.filter("_r > 0").crossJoin(F.broadcast(each.filter("_r = 0").select(F.col("_c").alias("r"))))
    return both.groupBy("r").agg(((1 + F.count_if(F.col("_c") >= F.col("r"))) / (1 + F.count(F.lit(1)))).alias("p"), F.count(F.lit(1)).alias("rounds"))


def signed_lags(most: int) -> Sequence[int]:
    """0, 1, -1, 2, -2, ... up to the greatest lag."""
    return [0, *[s * lag for lag in range(1, most + 1) for s in (1, -1)]]


def best_lag(scores: DataFrame, by: Sequence[str], lag: str, score: str, most: int) -> DataFrame:
    """The first lag of greatest score in the order 0, 1, -1, 2, -2, ..."""
    place = F.array_position(F.array(*[F.lit(v) for v in signed_lags(most)]), F.col(lag))
    w = Window.partitionBy(*by).orderBy(F.desc(score), place)
    return scores.filter(place > 0).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
