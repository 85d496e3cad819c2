"""Protocols around clustering: many seeds, medoids, random baselines, and tracks over windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import canonical, lloyd, per_group
from .resample import permute_within
from .validity import _square


def matrix_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the dense matrix of long points ``id, j, x``; missing cells take their column's mean."""
    wide = pdf.pivot_table(index="id", columns="j", values="x", aggfunc="first").sort_index()
    return wide.index.to_numpy(), wide.fillna(wide.mean()).to_numpy()


def many_seeds(points: DataFrame, k: int, seeds: Sequence[int]) -> DataFrame:
    """``seed, id, label, cost``: k-means from each seed, one task a seed."""
    runs = points.select("id", "j", "x").withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = matrix_of(pdf)
        rng = np.random.default_rng(int(pdf["seed"].iloc[0]))
        labels = canonical(lloyd(x, x[rng.choice(len(x), min(k, len(x)), replace=False)]))
        centers = {c: x[labels == c].mean(0) for c in set(labels)}
        cost = float(sum(((row - centers[c]) ** 2).sum() for row, c in zip(x, labels, strict=True)))
        return pd.DataFrame({"seed": pdf["seed"].iloc[0], "id": ids, "label": labels, "cost": cost})

    return per_group(runs, ["seed"], run, "seed int, id long, label int, cost double")


def best_seed(fits: DataFrame) -> DataFrame:
    """Labels of the seed of the least cost, the lower seed on ties."""
    best = fits.groupBy("seed").agg(F.min("cost").alias("cost")).agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "seed")).alias("b"))
    return fits.join(F.broadcast(best.select(F.col("b.seed").alias("seed"))), "seed").select("id", "label")


def seed_agreement(fits: DataFrame) -> DataFrame:
    """``s, t, ari``: adjusted Rand index of every pair of seeds, from their contingency tables."""
    other = fits.select(F.col("seed").alias("t"), "id", F.col("label").alias("y"))
    cells = fits.select(F.col("seed").alias("s"), "id", F.col("label").alias("x")).join(other, "id").filter("s < t").groupBy("s", "t", "x", "y").agg(F.count(F.lit(1)).alias("c"))

    def two(c):
        return c * (c - 1) / F.lit(2.0)

    pair = ["s", "t"]
    rows = cells.groupBy(*pair, "x").agg(F.sum("c").alias("c")).groupBy(*pair).agg(F.sum(two(F.col("c"))).alias("sx"), F.sum("c").alias("n"))
    cols = cells.groupBy(*pair, "y").agg(F.sum("c").alias("c")).groupBy(*pair).agg(F.sum(two(F.col("c"))).alias("sy"))
    same = cells.groupBy(*pair).agg(F.sum(two(F.col("c"))).alias("m"))
    chance = F.col("sx") * F.col("sy") / two(F.col("n"))
    ari = F.try_divide(F.col("m") - chance, (F.col("sx") + F.col("sy")) / 2 - chance)
    return rows.join(cols, pair).join(same, pair).select(*pair, ari.alias("ari"))


def medoid_seed(agreement: DataFrame) -> DataFrame:
    """The seed that agrees best with the others on average, the lower one on ties."""
    both = agreement.select(F.col("s").alias("seed"), "ari").unionByName(agreement.select(F.col("t").alias("seed"), "ari"))
    mean = both.groupBy("seed").agg(F.avg("ari").alias("mean_ari"))
    return mean.orderBy(F.desc(F.round("mean_ari", 9)), "seed").limit(1)


def random_baseline(labels: DataFrame, edges: DataFrame, n: int, salt: str = "") -> DataFrame:
    """``rep, avi``: mean isolability under labels dealt anew, all replicates in one plan."""
    dealt = permute_within(labels.select("id", "label"), "label", "id", [], n, salt)
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    met = both.join(dealt.select("rep", F.col("id").alias("a"), F.col("label").alias("k")), "a").join(
        dealt.select("rep", F.col("id").alias("b"), F.col("label").alias("l")), ["rep", "b"]
    )
    volume = met.groupBy("rep", "k").agg(F.sum("w").alias("vol"), F.sum(F.when(F.col("k") == F.col("l"), F.col("w")).otherwise(0.0)).alias("own"))
    return volume.groupBy("rep").agg(F.avg(F.try_divide(F.col("own"), F.col("vol"))).alias("avi"))


def z_score(draws: DataFrame, value: str, observed: DataFrame, least_sd: float = 1e-12) -> DataFrame:
    """``observed, mean, sd, z``; z is null where the draws hardly vary."""
    agg = draws.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    sd = F.when(F.col("sd") > least_sd * F.greatest(F.lit(1.0), F.abs("mean")), F.col("sd"))
    return agg.crossJoin(observed.select(F.col(observed.columns[0]).alias("observed"))).select("observed", "mean", "sd", ((F.col("observed") - F.col("mean")) / sd).alias("z"))


def fixed_track(points: DataFrame, centers: DataFrame) -> DataFrame:
    """``win, id, label``: nearest of fixed prototypes ``label, j, c`` in every window, ties by label."""
    d = points.join(centers, "j").groupBy("win", "id", "label").agg(F.sum(_square(F.col("x") - F.col("c"))).alias("d"))
    w = Window.partitionBy("win", "id").orderBy("d", "label")
    return d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("win", "id", "label")


def evolutionary_track(points: DataFrame, k: int, memory: float = 0.5) -> DataFrame:
    """``win, id, label``: k-means over windows whose centres keep a share of the window before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, centers = [], None
        for win, part in pdf.groupby("win"):
            ids, x = matrix_of(part)
            if centers is None:
                from .cluster import maxmin_seeds

                labels = lloyd(x, x[maxmin_seeds(x, min(k, len(x)))])
                centers = np.stack([x[labels == c].mean(0) if (labels == c).any() else x.mean(0) for c in range(min(k, len(x)))])
            else:
                history = centers
                for _ in range(50):
                    labels = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
                    new = np.stack([(1 - memory) * x[labels == c].mean(0) + memory * history[c] if (labels == c).any() else history[c] for c in range(len(centers))])
                    if np.allclose(new, centers):
                        break
                    centers = new
            out.append(pd.DataFrame({"win": win, "id": ids, "label": labels}))
        return pd.concat(out)

    return per_group(points.withColumn("_run", F.lit(0)), ["_run"], run, "win int, id long, label int")


def tune(run: Callable[[float], int], target: int, low: float, high: float, rounds: int = 30) -> float:
    """A parameter for which a run gives ``target`` clusters, by bisection (clusters grow with it)."""
    for _ in range(rounds):
        middle = (low + high) / 2
        got = run(middle)
        if got == target:
            return middle
        low, high = (middle, high) if got < target else (low, middle)
    return (low + high) / 2
