"""Queries on clustering protocols and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.compositions import clr as clr_of
from tessera.functions.compositions import closure
from tessera.operators import protocols as Q
from tessera.operators import validity as V

from .base import query
from .inputs import CATEGORIES, PARTS, SQL_FLOWS, SQL_PANEL, panel, read, strong_flows
from .panels import _r, rounded

REPS = 20
_WIN = f"""WITH {SQL_PANEL}, w0 AS (SELECT id, CAST(floor(t / 6.0e0) AS integer) AS win, {", ".join(f"sum(CASE WHEN cat = '{c}' THEN v END) AS {p}" for c, p in zip(CATEGORIES, PARTS, strict=True))} FROM panel GROUP BY 1, 2),
w1 AS (SELECT id, win, {", ".join(f"ln({p} / ({' + '.join(PARTS)})) AS {p}" for p in PARTS)} FROM w0 WHERE {" AND ".join(p + " IS NOT NULL" for p in PARTS)}),
w2 AS (SELECT id, win, {", ".join(f"{p} - ({' + '.join(PARTS)}) / 5 AS {p}" for p in PARTS)} FROM w1),
pts AS ({" UNION ALL ".join(f"SELECT id, win, '{p}' AS j, {p} AS x FROM w2" for p in PARTS)}),
cen AS (SELECT CAST(id % 3 AS integer) AS label, j, avg(x) AS c FROM pts WHERE win = 0 GROUP BY 1, 2)"""


def _window_points(spark, sf_dir):
    sums = panel(spark, sf_dir).groupBy("id", F.floor(F.col("t") / 6).cast("int").alias("win")).agg(
        *[F.sum(F.when(F.col("cat") == c, F.col("v"))).alias(p) for c, p in zip(CATEGORIES, PARTS, strict=True)]
    )
    shares = sums.dropna().select("id", "win", *[x.alias(p) for p, x in closure(PARTS).items()])
    return shares.select("id", "win", *[x.alias(p) for p, x in clr_of(PARTS).items()]).unpivot(["id", "win"], PARTS, "j", "x")


@query("fixed_track", f"{_WIN}, d AS (SELECT win, id, label, sum((x - c) * (x - c)) AS d FROM pts JOIN cen ON pts.j = cen.j GROUP BY win, id, label) SELECT win, id, label FROM (SELECT *, row_number() OVER (PARTITION BY win, id ORDER BY d, label) AS n FROM d) t WHERE n = 1")
def fixed_track(spark, sf_dir):
    p = _window_points(spark, sf_dir)
    centers = p.filter("win = 0").groupBy((F.col("id") % 3).cast("int").alias("label"), "j").agg(F.avg("x").alias("c"))
    return Q.fixed_track(p, centers)


@query("evolutionary_track")
def evolutionary_track(spark, sf_dir):
    return Q.evolutionary_track(_window_points(spark, sf_dir), 3)


_BASE = f"""WITH {SQL_FLOWS}, reps AS (SELECT unnest(range({REPS})) AS rep), x AS (SELECT rep, n_nationkey AS id, n_regionkey AS label FROM nation CROSS JOIN reps),
seat AS (SELECT rep, id, row_number() OVER (PARTITION BY rep ORDER BY id) AS n FROM x), card AS (SELECT rep, label, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('-', CAST(id AS varchar), CAST(rep AS varchar), 'z')), id) AS n FROM x),
lab AS (SELECT seat.rep, seat.id, card.label FROM seat JOIN card ON seat.rep = card.rep AND seat.n = card.n),
vol AS (SELECT p.rep, p.label AS k, sum(w) AS vol, sum(CASE WHEN p.label = q.label THEN w ELSE 0.0 END) AS own FROM both_ways JOIN lab p ON a = p.id JOIN lab q ON b = q.id AND q.rep = p.rep GROUP BY 1, 2),
draws AS (SELECT CAST(rep AS integer) AS rep, avg(own / vol) AS avi FROM vol GROUP BY rep),
obs AS (SELECT avg(own / vol) AS o FROM (SELECT p.n_regionkey AS k, sum(w) AS vol, sum(CASE WHEN p.n_regionkey = q.n_regionkey THEN w ELSE 0.0 END) AS own FROM both_ways JOIN nation p ON a = p.n_nationkey JOIN nation q ON b = q.n_nationkey GROUP BY 1) t)"""


def _labels(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("label"))


@query("random_baseline", f"{_BASE} SELECT rep, {_r('avi')} AS avi FROM draws")
def random_baseline(spark, sf_dir):
    return rounded(Q.random_baseline(_labels(spark, sf_dir), strong_flows(spark, sf_dir), REPS, "z"), "avi")


@query("baseline_z", f"{_BASE} SELECT {_r('o')} AS observed, {_r('avg(avi)')} AS mean, {_r('stddev_samp(avi)')} AS sd, {_r('(o - avg(avi)) / stddev_samp(avi)')} AS z FROM draws, obs GROUP BY o")
def baseline_z(spark, sf_dir):
    labels, edges = _labels(spark, sf_dir), strong_flows(spark, sf_dir)
    observed = V.isolability_unifiability(V.cluster_matrix(edges, labels)).select("avi")
    return rounded(Q.z_score(Q.random_baseline(labels, edges, REPS, "z"), "avi", observed), "observed", "mean", "sd", "z")


def _totals(spark, sf_dir):
    """Log-ratios of each nation over the whole panel."""
    return _window_points(spark, sf_dir).groupBy("id", "j").agg(F.avg("x").alias("x"))


@query("seed_agreement")
def seed_agreement(spark, sf_dir):
    fits = Q.many_seeds(_totals(spark, sf_dir), 4, range(4))
    return rounded(Q.seed_agreement(fits), "ari")


@query("best_seed")
def best_seed(spark, sf_dir):
    return Q.best_seed(Q.many_seeds(_totals(spark, sf_dir), 4, range(4)))
