"""Partitions over time: contingency, matching, transitions and events.

A partition table is ``win, id, label``; label -1 is noise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import connected_components


def contingency(x: DataFrame, y: DataFrame) -> DataFrame:
    """``x, y, c``: counts of label pairs over common nodes, noise left out."""
    return (
        x.filter("label >= 0").select("id", F.col("label").alias("x"))
        .join(y.filter("label >= 0").select("id", F.col("label").alias("y")), "id")
        .groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    )


def jaccard_matrix(table: DataFrame) -> DataFrame:
    """``x, y, c, jaccard`` from a contingency table over common nodes."""
    wx, wy = Window.partitionBy("x"), Window.partitionBy("y")
    union = F.sum("c").over(wx) + F.sum("c").over(wy) - F.col("c")
    return table.select("x", "y", "c", (F.col("c").cast("double") / union).alias("jaccard"))


def best_match(matrix: DataFrame) -> DataFrame:
    """For each x the y of the largest Jaccard, ties by label."""
    w = Window.partitionBy("x").orderBy(F.desc("jaccard"), "y")
    return matrix.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("x", "y", "jaccard")


def optimal_match(matrix: DataFrame) -> dict[int, int]:
    """One-to-one matching of the largest total Jaccard; the matrix has labels, not entities."""
    rows = [(r.x, r.y, r.jaccard) for r in matrix.select("x", "y", "jaccard").collect()]
    xs, ys = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    if not rows:
        return {}
    gain = {(x, y): j for x, y, j in rows}
    cost = [[-gain.get((x, y), 0.0) for y in ys] for x in xs]
    flip = len(xs) > len(ys)
    found = _assignment([list(c) for c in zip(*cost, strict=True)] if flip else cost)
    chosen = [(b, a) if flip else (a, b) for a, b in found]
    return {xs[a]: ys[b] for a, b in chosen if (xs[a], ys[b]) in gain}


def _assignment(cost: list[list[float]]) -> list[tuple[int, int]]:
    """Least-cost assignment of all rows (no more rows than columns), by shortest augmenting paths."""
    n, m = len(cost), len(cost[0])
    inf = float("inf")
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        least, way, done = [inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[col]:
            done[col] = True
            at, delta, nxt = owner[col], inf, 0
            for j in range(1, m + 1):
                if not done[j]:
                    slack = cost[at - 1][j - 1] - u[at] - v[j]
                    if slack < least[j]:
                        least[j], way[j] = slack, col
                    if least[j] < delta:
                        delta, nxt = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            col = nxt
        while col:
            owner[col] = owner[way[col]]
            col = way[col]
    return [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]


def transition_matrix(partitions: DataFrame, lag: int = 1) -> DataFrame:
    """``x, y, c``: moves between window ``win`` and ``win + lag``."""
    before = partitions.filter("label >= 0").select("id", (F.col("win") + lag).alias("win"), F.col("label").alias("x"))
    after = partitions.filter("label >= 0").select("id", "win", F.col("label").alias("y"))
    return before.join(after, ["id", "win"]).groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))


def share_changed(partitions: DataFrame) -> DataFrame:
    """``win, n, changed``: share of nodes that leave their cluster from one window to the next.

    Labels are names only: the two windows' labels are first matched one to one
    so that most nodes stay.  A window's contingency table, which grows with its
    labels and not with its nodes, is one group.
    """
    before = partitions.filter("label >= 0").select("id", (F.col("win") + 1).alias("win"), F.col("label").alias("x"))
    table = partitions.filter("label >= 0").join(before, ["id", "win"]).groupBy("win", "x", F.col("label").alias("y")).agg(
        F.count(F.lit(1)).alias("c")
    )

    def matched(rows: pd.DataFrame) -> pd.DataFrame:
        grid = rows.pivot(index="x", columns="y", values="c").fillna(0).to_numpy()
        grid = grid.T if grid.shape[0] > grid.shape[1] else grid
        stay = sum(grid[i][j] for i, j in _assignment((-grid).tolist()))
        n = int(rows["c"].sum())
        return pd.DataFrame({"win": rows["win"].iloc[:1], "n": [n], "changed": [1 - stay / n]})

    return table.groupBy("win").applyInPandas(matched, f"win {partitions.schema['win'].dataType.simpleString()}, n long, changed double")


def stable_halves(halves: DataFrame) -> DataFrame:
    """``id, reliable, moved, from_, to_`` from half-year labels ``odd1, even1, odd2, even2``.

    A label is reliable if both halves of each year agree; a reliable node has
    moved if its two years differ.
    """
    reliable = (F.col("odd1") == F.col("even1")) & (F.col("odd2") == F.col("even2"))
    return halves.select(
        "id", reliable.alias("reliable"), (reliable & (F.col("odd1") != F.col("odd2"))).alias("moved"),
        F.when(reliable, F.col("odd1")).otherwise(-1).alias("from_"), F.when(reliable, F.col("odd2")).otherwise(-1).alias("to_"),
    )


def cluster_events(matrix: DataFrame, tau: float) -> DataFrame:
    """``side, label, event`` from links of Jaccard ``tau`` or more between two partitions.

    Clusters joined by links form components, and all of a component share its
    event: one old and one new, ``survive``; one old and several new, ``split``;
    several old and one new, ``merge``; several of both, ``reorganise``.  Without
    a link an old cluster is ``disappear`` and a new one ``emerge``.
    """
    # Old clusters are even nodes, new ones odd.
    links = matrix.filter(F.col("jaccard") >= tau).select((F.col("x") * 2).alias("a"), (F.col("y") * 2 + 1).alias("b"))
    nodes = matrix.select(F.explode(F.array(F.col("x") * 2, F.col("y") * 2 + 1)).alias("id")).distinct()
    found = connected_components(links, nodes)
    sizes = found.groupBy("component").agg(F.count_if(F.col("id") % 2 == 0).alias("old"), F.count_if(F.col("id") % 2 == 1).alias("new"))
    event = (
        F.when(F.col("new") == 0, "disappear")
        .when(F.col("old") == 0, "emerge")
        .when((F.col("old") == 1) & (F.col("new") == 1), "survive")
        .when(F.col("old") == 1, "split")
        .when(F.col("new") == 1, "merge")
        .otherwise("reorganise")
    )
    side = F.when(F.col("id") % 2 == 0, "old").otherwise("new")
    return found.join(sizes, "component").select(side.alias("side"), F.floor(F.col("id") / 2).cast("long").alias("label"), event.alias("event"))


def nearest_center(points: DataFrame, centers: DataFrame) -> DataFrame:
    """``id, label, d, margin``: nearest of few centres ``label, j, c`` for long points ``id, j, x``, ties by label."""
    d = points.join(centers, "j").groupBy("id", "label").agg(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c"))).alias("d"))
    w = Window.partitionBy("id").orderBy("d", "label")
    rows = d.select("id", "label", "d", F.row_number().over(w).alias("_n"), F.lead("d").over(w).alias("_next"))
    return rows.filter("_n = 1").select("id", "label", "d", (F.col("_next") - F.col("d")).alias("margin"))
