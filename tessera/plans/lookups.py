"""Node lookups, absent members, orders, margins, spatial weights and pair tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import map_or_fail
from tessera.operators import lookups as L
from tessera.operators import summaries as S

from .agreements import year_labels
from .analyses import distance, n_rows, places
from .base import query
from .composites import _AT
from .inputs import SQL_COORDINATES, SQL_CUSTOMERS, SQL_MONTHLY, SQL_PANEL, customers, monthly, panel, read, vectors
from .panels import _r, rounded

_C, _M = f"WITH {SQL_CUSTOMERS}", f"WITH {SQL_MONTHLY}"


@query("status_groups", "SELECT CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' WHEN 'P' THEN 'open' END AS grp, count(*) AS n FROM orders GROUP BY 1")
def status_groups(spark, sf_dir):
    """Codes to groups; an unknown code is an error."""
    o = read(spark, sf_dir, "orders", "o_orderstatus").select(map_or_fail("o_orderstatus", {"F": "closed", "O": "open", "P": "open"}).alias("grp"))
    return o.groupBy("grp").agg(n_rows().alias("n"))


def wholes(spark, sf_dir) -> DataFrame:
    return places(spark, sf_dir).filter("g < 2").select("id", (F.col("g") + 100).alias("whole"))


@query("collapsed_members", "SELECT n_nationkey AS id, CASE WHEN n_regionkey < 2 THEN n_regionkey + 100 ELSE n_nationkey END AS node FROM nation")
def collapsed_members(spark, sf_dir):
    return L.members(places(spark, sf_dir), wholes(spark, sf_dir), "collapse")


@query("excluded_members", "SELECT n_nationkey AS id, n_nationkey AS node FROM nation WHERE n_regionkey >= 2")
def excluded_members(spark, sf_dir):
    return L.members(places(spark, sf_dir), wholes(spark, sf_dir), "exclude")


@query("customers_by_node", f"{_C} SELECT CASE WHEN n_regionkey < 2 THEN n_regionkey + 100 ELSE g END AS node, count(*) AS n FROM cust LEFT JOIN nation ON g = n_nationkey GROUP BY 1")
def customers_by_node(spark, sf_dir):
    lookup = L.members(places(spark, sf_dir), wholes(spark, sf_dir), "collapse")
    c = customers(spark, sf_dir).groupBy(F.col("g").alias("id")).agg(n_rows().alias("k"))
    return L.nodes_of(c, lookup).groupBy("node").agg(F.sum("k").alias("n"))


_PRESENT = f"WITH {SQL_PANEL}, p AS (SELECT DISTINCT id, g FROM panel WHERE t = 3 AND cat = '1-URGENT' AND v > 1000000)"


def present(spark, sf_dir) -> DataFrame:
    return panel(spark, sf_dir).filter("t = 3 and cat = '1-URGENT' and v > 1000000").select("id", "g").distinct()


@query("absent_groups", f"{_PRESENT} SELECT DISTINCT n_regionkey AS g FROM nation WHERE n_regionkey NOT IN (SELECT g FROM p)")
def absent_groups(spark, sf_dir):
    return L.absent_groups(places(spark, sf_dir), present(spark, sf_dir), "g")


@query("missing_members", f"{_PRESENT} SELECT n_nationkey AS id, n_regionkey AS g FROM nation WHERE n_regionkey IN (SELECT g FROM p) AND n_nationkey NOT IN (SELECT id FROM p)")
def missing_members(spark, sf_dir):
    return L.missing_members(places(spark, sf_dir), present(spark, sf_dir), "g")


@query("edge_set", "SELECT DISTINCT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey <> s_nationkey")
def edge_set(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    return L.edge_set(c.join(s, F.col("c_custkey") == F.col("s_suppkey")).select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")))


@query("order_with_ties", f"{_C} SELECT id, row_number() OVER (ORDER BY n_orders, id) - 1 AS pos FROM cust")
def order_with_ties(spark, sf_dir):
    return S.positions(customers(spark, sf_dir), "n_orders", "id").select("id", "pos")


@query("value_quantiles", f"{_C}, e AS (SELECT unnest([quantile_cont(CAST(n_orders AS double), 0.2), quantile_cont(CAST(n_orders AS double), 0.4), quantile_cont(CAST(n_orders AS double), 0.6), quantile_cont(CAST(n_orders AS double), 0.8)]) AS e FROM cust), d AS (SELECT DISTINCT e FROM e), b AS (SELECT id, (SELECT count(*) FROM d WHERE e < n_orders) AS bin FROM cust) SELECT CAST(bin AS integer) AS bin, count(*) AS n FROM b GROUP BY bin")
def value_quantiles(spark, sf_dir):
    return L.value_quantiles(customers(spark, sf_dir), "n_orders", 5).groupBy("bin").agg(n_rows().alias("n"))


@query("log1p_relative", f"{_C} SELECT id, {_r('ln(1 + spend) - median(ln(1 + spend)) OVER (PARTITION BY seg)')} AS x FROM cust")
def log1p_relative(spark, sf_dir):
    c = customers(spark, sf_dir).select("id", "seg", F.log1p("spend").alias("l"))
    middle = c.groupBy("seg").agg(F.median("l").alias("m"))
    return rounded(c.join(middle, "seg").select("id", (F.col("l") - F.col("m")).alias("x")), "x")


@query("type_mean_ranks", f"{_C}, m AS (SELECT n_orders % 7 AS label, avg(bal) OVER (PARTITION BY n_orders % 7) AS m FROM cust), r AS (SELECT label, m, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0e0 AS r FROM m) SELECT label, {_r('min(m)', 4)} AS m, min(r) AS r FROM r GROUP BY label")
def type_mean_ranks(spark, sf_dir):
    return rounded(L.type_mean_ranks(customers(spark, sf_dir).withColumn("label", F.col("n_orders") % 7), "label", "bal"), "m", digits=4)


@query("robust_sd_rows", f"{_M}, m AS (SELECT id, y, median(y) OVER (PARTITION BY id) AS m FROM monthly) SELECT id, {_r('1.4826e0 * median(abs(y - m))')} AS sd FROM m GROUP BY id")
def robust_sd_rows(spark, sf_dir):
    m = monthly(spark, sf_dir).select("id", "y", F.median("y").over(Window.partitionBy("id")).alias("m"))
    return rounded(m.groupBy("id").agg((1.4826 * F.median(F.abs(F.col("y") - F.col("m")))).alias("sd")), "sd")


@query("group_month_residual", f"{_M} SELECT id, t, {_r('y - avg(y) OVER (PARTITION BY g, t)')} AS r FROM monthly")
def group_month_residual(spark, sf_dir):
    """A series less its group's mean of the month."""
    return rounded(monthly(spark, sf_dir).select("id", "t", (F.col("y") - F.avg("y").over(Window.partitionBy("g", "t"))).alias("r")), "r")


_YEARS = f"{_M}, q AS (SELECT id, CAST(floor(t / 12.0e0) AS integer) AS win, sum(v) AS v FROM monthly GROUP BY 1, 2), l AS (SELECT id, win, ntile(3) OVER (PARTITION BY win ORDER BY v, id) - 1 AS label FROM q)"


@query("up_down_moves", f"{_YEARS} SELECT count(CASE WHEN a.label < b.label THEN 1 END) AS up, count(CASE WHEN a.label > b.label THEN 1 END) AS down, count(CASE WHEN a.label = b.label THEN 1 END) AS stay FROM l a JOIN l b ON a.id = b.id AND b.win = a.win + 1")
def up_down_moves(spark, sf_dir):
    labels = year_labels(spark, sf_dir)
    after = labels.select("id", (F.col("win") - 1).alias("win"), F.col("label").alias("y"))
    moves = labels.withColumnRenamed("label", "x").join(after, ["id", "win"]).groupBy("x", "y").agg(n_rows().alias("n"))
    return L.up_down(moves, labels.select("label", F.col("label").alias("rank")).distinct())


@query("centre_margins", f"""WITH {SQL_COORDINATES}, c AS (SELECT label AS l, j, avg(x) AS m FROM pts GROUP BY 1, 2), d AS (SELECT id, label, l, sqrt(sum((x - m) * (x - m))) AS d FROM pts JOIN c ON pts.j = c.j GROUP BY id, label, l),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, l) AS n FROM d) SELECT id, max(CASE WHEN n = 1 THEN l END) AS near, {_r('max(CASE WHEN n = 1 THEN d END)')} AS d, {_r('max(CASE WHEN n = 2 THEN d END) - max(CASE WHEN n = 1 THEN d END)')} AS margin FROM r GROUP BY id""")
def centre_margins(spark, sf_dir):
    return rounded(L.centre_margins(vectors(spark, sf_dir), "v", "label").select("id", "near", "d", "margin"), "d", "margin")


_DIST = f"WITH {_AT}, d AS (SELECT a.id AS a, b.id AS b, sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS double)) AS d FROM at_ a JOIN at_ b ON a.id <> b.id)"


def distances(spark, sf_dir) -> DataFrame:
    """``a, b, d`` of all places, both directions."""
    at = places(spark, sf_dir)
    met = at.alias("p").join(at.alias("q"), F.col("p.id") != F.col("q.id"))
    return met.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), distance("p", "q").alias("d"))


@query("neighbour_weights", f"{_DIST}, k AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS n FROM d) SELECT a, b, 0.25e0 AS w FROM k WHERE n <= 4")
def neighbour_weights(spark, sf_dir):
    return L.neighbour_weights(distances(spark, sf_dir), 4)


@query("mantel", f"""{_DIST}, v AS (SELECT c_nationkey AS id, avg(c_acctbal) AS v FROM customer GROUP BY 1), y AS (SELECT p.id AS a, q.id AS b, abs(p.v - q.v) AS d FROM v p JOIN v q ON p.id < q.id),
    k AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM v), o AS (SELECT r, id, row_number() OVER (PARTITION BY r ORDER BY md5(CAST(r AS varchar) || ':' || CAST(id AS varchar)), id) AS k FROM v CROSS JOIN range(1, 20) AS t(r)),
    m AS (SELECT r, o.id, k.id AS to_ FROM o JOIN k ON o.k = k.k UNION ALL SELECT 0, id, id FROM v),
    c AS (SELECT p.r, round(corr(d.d, y.d), 9) AS c FROM d JOIN m p ON p.id = d.a JOIN m q ON q.id = d.b AND q.r = p.r JOIN y ON y.a = least(p.to_, q.to_) AND y.b = greatest(p.to_, q.to_) WHERE d.a < d.b GROUP BY p.r)
    SELECT o.c + 0.0 AS r, (1 + count(CASE WHEN c.c >= o.c THEN 1 END)) / CAST(1 + count(*) AS double) AS p, count(*) AS rounds FROM c JOIN c o ON o.r = 0 WHERE c.r > 0 GROUP BY o.c""")
def mantel(spark, sf_dir):
    """Do nations that are near each other have like balances?"""
    v = read(spark, sf_dir, "customer", "c_nationkey", "c_acctbal").groupBy(F.col("c_nationkey").alias("id")).agg(F.avg("c_acctbal").alias("v"))
    met = v.alias("p").join(v.alias("q"), F.col("p.id") < F.col("q.id"))
    like = met.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.abs(F.col("p.v") - F.col("q.v")).alias("d"))
    return L.mantel(distances(spark, sf_dir).filter("a < b"), like, v.select("id"), 19)


@query("tie_tolerance", f"{_C}, s AS (SELECT g, seg, avg(bal) AS x FROM cust GROUP BY g, seg), d AS (SELECT g, stddev_samp(x) AS sd FROM s GROUP BY g) SELECT {_r('median(sd)', 4)} AS tolerance, count(sd) AS n FROM d")
def tie_tolerance(spark, sf_dir):
    """Median over candidates of the deviation of their replicates."""
    s = customers(spark, sf_dir).groupBy("g", "seg").agg(F.avg("bal").alias("x"))
    return rounded(s.groupBy("g").agg(F.stddev_samp("x").alias("sd")).agg(F.median("sd").alias("tolerance"), F.count("sd").alias("n")), "tolerance", digits=4)


@query("signed_best_lag", f"""{_M}, s AS (SELECT a.id, k.l AS lag, corr(a.y, b.v) AS r FROM monthly a CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS l) k JOIN monthly b ON a.id = b.id AND b.t = a.t + k.l GROUP BY a.id, k.l),
    n AS (SELECT id, lag, r, row_number() OVER (PARTITION BY id ORDER BY round(r, 9) DESC, abs(lag), lag DESC) AS n FROM s) SELECT id, CAST(lag AS integer) AS lag, {_r('r')} AS r FROM n WHERE n = 1""")
def signed_best_lag(spark, sf_dir):
    m = monthly(spark, sf_dir)
    shifted = m.select("id", F.col("v").alias("w"), "t", F.explode(F.array(*[F.lit(v) for v in L.signed_lags(2)])).alias("lag")).withColumn("t", F.col("t") - F.col("lag"))
    s = m.select("id", "t", "y").join(shifted, ["id", "t"]).groupBy("id", "lag").agg(F.round(F.corr("y", "w"), 9).alias("r"))
    return rounded(L.best_lag(s, ["id"], "lag", "r", 2), "r")


@query("percentile_of_value", f"{_C} SELECT seg, {_r('avg(CASE WHEN bal <= 5000 THEN 1.0e0 ELSE 0.0e0 END)')} AS share FROM cust GROUP BY seg")
def percentile_of_value(spark, sf_dir):
    return rounded(customers(spark, sf_dir).groupBy("seg").agg(F.avg((F.col("bal") <= 5000).cast("double")).alias("share")), "share")
