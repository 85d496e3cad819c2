"""Choosing among candidates by several criteria.

Candidates are a long table ``cand, crit, score``, higher is better; the number
of candidates is small by nature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ranks import avg_rank


def pair_wins(scores: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``x, y, wins, losses``: criteria in which x beats y, or y beats x, beyond the tolerance."""
    other = scores.select(F.col("cand").alias("y"), "crit", F.col("score").alias("s2"))
    return (
        scores.select(F.col("cand").alias("x"), "crit", "score").join(other, "crit").filter("x <> y").groupBy("x", "y")
        .agg(F.count_if(F.col("score") > F.col("s2") + tolerance).alias("wins"), F.count_if(F.col("s2") > F.col("score") + tolerance).alias("losses"))
    )


def pareto_front(scores: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Candidates that no other dominates (never worse, somewhere better, beyond the tolerance)."""
    beaten = pair_wins(scores, tolerance).filter("wins = 0 and losses > 0").select(F.col("x").alias("cand")).distinct()
    return scores.select("cand").distinct().join(beaten, "cand", "left_anti")


def copeland(scores: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Pairwise victories minus defeats."""
    w = pair_wins(scores, tolerance)
    mark = F.when(F.col("wins") > F.col("losses"), 1).when(F.col("wins") < F.col("losses"), -1).otherwise(0)
    return w.groupBy(F.col("x").alias("cand")).agg(F.sum(mark).alias("copeland"))


def borda(scores: DataFrame) -> DataFrame:
    """Sum of average ranks over criteria; higher is better."""
    return scores.select("cand", avg_rank("score", ["crit"]).alias("r")).groupBy("cand").agg(F.sum("r").alias("borda"))


def lexicographic(scores: DataFrame, order: list[str], tolerance: float = 0.0) -> DataFrame:
    """Candidates left after keeping, criterion by criterion, those within the tolerance of the best."""
    wide = scores.groupBy("cand").agg(*[F.max(F.when(F.col("crit") == c, F.col("score"))).alias(c) for c in order])
    left = wide
    for c in order:
        best = left.agg(F.max(c).alias("_best"))
        left = left.crossJoin(best).filter(F.col(c) >= F.col("_best") - tolerance).drop("_best")
    return left.select("cand")


def choose(scores: DataFrame, ties: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Front, then Copeland on the front, then the least of ``ties`` (``cand, tie_1, ...``), then the name."""
    front = pareto_front(scores, tolerance)
    on_front = scores.join(front, "cand")
    ranked = front.join(copeland(on_front, tolerance), "cand", "left").withColumn("copeland", F.coalesce("copeland", F.lit(0))).join(ties, "cand", "left")
    order = Window.partitionBy().orderBy(F.desc("copeland"), *[c for c in ties.columns if c != "cand"], "cand")
    return ranked.withColumn("place", F.row_number().over(order)).select("cand", "copeland", "place")


def verdict(low: str, high: str, p: str, alpha: float = 0.05):
    """``confirmed`` (interval above 0 and p small), ``rejected`` (interval below 0), else ``open``."""
    return F.when((F.col(low) > 0) & (F.col(p) <= alpha), "confirmed").when(F.col(high) < 0, "rejected").otherwise("open")
