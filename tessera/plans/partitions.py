"""Queries on partitions: validity indices, agreement, tracking and selection among candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import selection as C
from tessera.operators import tracking as T
from tessera.operators import validity as V

from .base import query
from .inputs import SQL_COORDINATES, SQL_CUSTOMERS, SQL_MONTHLY, coordinates, customers, monthly
from .panels import _r, rounded

_PTS = f"WITH {SQL_COORDINATES}"


@query("silhouette", f"""{_PTS}, z AS (SELECT label, count(DISTINCT id) AS n FROM pts GROUP BY label), m AS (SELECT label AS lb, j, avg(x) AS m, avg(x * x) AS q FROM pts GROUP BY 1, 2),
    d AS (SELECT id, pts.label, lb, sum(x * x - 2 * x * m + q) AS d FROM pts JOIN m ON pts.j = m.j GROUP BY 1, 2, 3),
    s AS (SELECT id, d.label, min(CASE WHEN d.label = lb THEN d * n / nullif(n - 1, 0) END) AS own, min(CASE WHEN d.label <> lb THEN d END) AS other FROM d JOIN z ON z.label = lb GROUP BY 1, 2)
    SELECT id, label, {_r("coalesce((other - own) / greatest(own, other), 0.0)")} AS silhouette FROM s""")
def silhouette(spark, sf_dir):
    return rounded(V.silhouette_squared(coordinates(spark, sf_dir)), "silhouette")


@query("calinski_harabasz", f"""{_PTS}, m AS (SELECT j, label, avg(x) OVER (PARTITION BY j, label) AS c, avg(x) OVER (PARTITION BY j) AS g, x FROM pts),
    s AS (SELECT sum((c - g) * (c - g)) AS b, sum((x - c) * (x - c)) AS w, count(DISTINCT label) AS k, count(*) / count(DISTINCT j) AS n FROM m) SELECT {_r("b / (k - 1) / (w / (n - k))")} AS ch FROM s""")
def calinski_harabasz(spark, sf_dir):
    return rounded(V.calinski_harabasz(coordinates(spark, sf_dir)), "ch")


_OWN = _PTS + ", own AS (SELECT label, sqrt(sum(v * v)) AS s FROM (SELECT label, j, var_pop(x) AS v FROM pts GROUP BY 1, 2) GROUP BY 1)"


@query("s_dbw_scatter", f"{_OWN} SELECT {_r('(SELECT avg(s) FROM own) / sqrt(sum(v * v))')} AS scat FROM (SELECT j, var_pop(x) AS v FROM pts GROUP BY j)")
def s_dbw_scatter(spark, sf_dir):
    return rounded(V.s_dbw_scatter(coordinates(spark, sf_dir)), "scat")


@query(
    "s_dbw_density",
    f"""{_OWN}, r AS (SELECT sqrt(sum(s)) / count(*) AS r, count(*) AS k FROM own), c AS (SELECT label, j, avg(x) AS c FROM pts GROUP BY 1, 2),
    spot AS (SELECT a.label, b.label AS other, a.j, unnest([{{'at': 'mid', 'u': (a.c + b.c) / 2}}, {{'at': 'one', 'u': a.c}}, {{'at': 'two', 'u': b.c}}]) AS s FROM c a JOIN c b ON a.j = b.j AND a.label < b.label),
    d AS (SELECT spot.label, other, s.at AS at_, p.id, sqrt(sum((x - s.u) * (x - s.u))) AS d FROM spot JOIN pts p ON p.j = spot.j AND (p.label = spot.label OR p.label = other) GROUP BY ALL),
    n AS (SELECT label, other, CAST(count(*) FILTER (WHERE at_ = 'mid' AND d <= r) AS double) AS mid, count(*) FILTER (WHERE at_ = 'one' AND d <= r) AS one, count(*) FILTER (WHERE at_ = 'two' AND d <= r) AS two FROM d, r GROUP BY 1, 2)
    SELECT {_r("2 * coalesce(sum(mid / nullif(greatest(one, two), 0)), 0) / ((SELECT k FROM r) * ((SELECT k FROM r) - 1))")} AS dens_bw FROM n""",
)
def s_dbw_density(spark, sf_dir):
    return rounded(V.s_dbw_density(coordinates(spark, sf_dir)), "dens_bw")


@query("cluster_centers", f"{_PTS} SELECT label, CAST(j AS integer) AS j, {_r('avg(x)')} AS c, count(*) AS n FROM pts GROUP BY 1, 2")
def cluster_centers(spark, sf_dir):
    return rounded(V.centers(coordinates(spark, sf_dir)), "c")


@query("nearest_center", f"""{_PTS}, c AS (SELECT label, j, avg(x) AS c FROM pts GROUP BY 1, 2), d AS (SELECT id, c.label, sum((x - c) * (x - c)) AS d FROM pts JOIN c USING (j) GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, label) AS n, lead(d) OVER (PARTITION BY id ORDER BY d, label) AS nx FROM d)
    SELECT id, label, {_r("d")} AS d, {_r("nx - d")} AS margin FROM o WHERE n = 1""")
def nearest_center(spark, sf_dir):
    p = coordinates(spark, sf_dir)
    return rounded(T.nearest_center(p.select("id", "j", "x"), V.centers(p).select("label", "j", "c")), "d", "margin")


_TWO = f"""WITH {SQL_CUSTOMERS}, lx AS (SELECT id, CAST(id % 5 AS bigint) AS label FROM cust), ly AS (SELECT id, CASE WHEN id % 11 = 0 THEN CAST(-1 AS bigint) ELSE CAST(ascii(seg) % 4 AS bigint) END AS label FROM cust),
ct AS (SELECT lx.label AS x, ly.label AS y, count(*) AS c FROM lx JOIN ly USING (id) WHERE ly.label >= 0 GROUP BY 1, 2)"""


def _table(spark, sf_dir):
    c = customers(spark, sf_dir)
    y = F.when(F.col("id") % 11 == 0, F.lit(-1).cast("long")).otherwise((F.ascii("seg") % 4).cast("long"))
    return T.contingency(c.select("id", (F.col("id") % 5).alias("label")), c.select("id", y.alias("label")))


@query("contingency", f"{_TWO} SELECT x, y, c FROM ct")
def contingency(spark, sf_dir):
    return _table(spark, sf_dir)


@query("adjusted_rand", f"""{_TWO}, s AS (SELECT (SELECT sum(c * (c - 1) / 2.0e0) FROM ct) AS s, (SELECT sum(n * (n - 1) / 2.0e0) FROM (SELECT sum(c) AS n FROM ct GROUP BY x)) AS sx,
    (SELECT sum(n * (n - 1) / 2.0e0) FROM (SELECT sum(c) AS n FROM ct GROUP BY y)) AS sy, (SELECT sum(c) FROM ct) AS n) SELECT {_r("(s - sx * sy / (n * (n - 1) / 2.0e0)) / ((sx + sy) / 2 - sx * sy / (n * (n - 1) / 2.0e0))")} AS ari FROM s""")
def adjusted_rand(spark, sf_dir):
    return rounded(V.adjusted_rand(_table(spark, sf_dir)), "ari")


_JAC = _TWO + ", jac AS (SELECT x, y, c, c / CAST(sum(c) OVER (PARTITION BY x) + sum(c) OVER (PARTITION BY y) - c AS double) AS jaccard FROM ct)"


@query("partition_jaccard", f"{_JAC} SELECT x, y, c, {_r('jaccard')} AS jaccard FROM jac")
def partition_jaccard(spark, sf_dir):
    return rounded(T.jaccard_matrix(_table(spark, sf_dir)), "jaccard")


@query("best_match", f"{_JAC} SELECT x, y, {_r('jaccard')} AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY jaccard DESC, y) AS n FROM jac) WHERE n = 1")
def best_match(spark, sf_dir):
    return rounded(T.best_match(T.jaccard_matrix(_table(spark, sf_dir))), "jaccard")


#: Quarterly labels of nations: the third of the quarter's ranking that a nation is in.
_TRACK = f"""WITH {SQL_MONTHLY}, q AS (SELECT id, t // 3 AS win, sum(v) AS v FROM monthly GROUP BY 1, 2),
trk AS (SELECT id, CAST(win AS integer) AS win, CAST((row_number() OVER (PARTITION BY win ORDER BY v, id) - 1) * 3 // count(*) OVER (PARTITION BY win) AS bigint) AS label FROM q)"""


def _track(spark, sf_dir):
    from pyspark.sql import Window

    q = monthly(spark, sf_dir).groupBy("id", F.floor(F.col("t") / 3).cast("int").alias("win")).agg(F.sum("v").alias("v"))
    w = Window.partitionBy("win")
    label = F.floor((F.row_number().over(w.orderBy("v", "id")) - 1) * 3 / F.count(F.lit(1)).over(w))
    return q.select("id", "win", label.cast("long").alias("label"))


@query("transition_matrix", f"{_TRACK} SELECT p.label AS x, n.label AS y, count(*) AS c FROM trk p JOIN trk n ON p.id = n.id AND n.win = p.win + 1 GROUP BY 1, 2")
def transition_matrix(spark, sf_dir):
    return T.transition_matrix(_track(spark, sf_dir))


@query("share_changed", f"""{_TRACK}, m AS (SELECT n.win, p.label AS x, n.label AS y, count(*) AS c FROM trk p JOIN trk n ON p.id = n.id AND n.win = p.win + 1 GROUP BY 1, 2, 3),
perms AS (SELECT * FROM (VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) AS v(p0, p1, p2)),
kept AS (SELECT win, p0, p1, sum(CASE WHEN y = CASE x WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END THEN c ELSE 0 END) AS stay, sum(c) AS n FROM m, perms GROUP BY 1, 2, 3)
SELECT win, CAST(max(n) AS bigint) AS n, {_r('1 - max(stay) / CAST(max(n) AS double)')} AS changed FROM kept GROUP BY 1""")
def share_changed(spark, sf_dir):
    return rounded(T.share_changed(_track(spark, sf_dir)), "changed")


@query("stable_halves", f"""{_TRACK}, h AS (SELECT id, max(CASE WHEN win = 0 THEN label END) AS odd1, max(CASE WHEN win = 1 THEN label END) AS even1, max(CASE WHEN win = 4 THEN label END) AS odd2, max(CASE WHEN win = 5 THEN label END) AS even2 FROM trk GROUP BY id)
    SELECT id, odd1 = even1 AND odd2 = even2 AS reliable, odd1 = even1 AND odd2 = even2 AND odd1 <> odd2 AS moved, CASE WHEN odd1 = even1 AND odd2 = even2 THEN odd1 ELSE -1 END AS from_, CASE WHEN odd1 = even1 AND odd2 = even2 THEN odd2 ELSE -1 END AS to_ FROM h""")
def stable_halves(spark, sf_dir):
    at = {"odd1": 0, "even1": 1, "odd2": 4, "even2": 5}
    h = _track(spark, sf_dir).groupBy("id").agg(*[F.max(F.when(F.col("win") == w, F.col("label"))).alias(n) for n, w in at.items()])
    return T.stable_halves(h)


_EVENT = _TRACK.replace("WITH", "WITH RECURSIVE", 1) + """, ev0 AS (SELECT p.label AS x, n.label AS y, count(*) AS c FROM trk p JOIN trk n ON p.id = n.id AND p.win = 0 AND n.win = 7 GROUP BY 1, 2),
ev AS (SELECT x, y, c / CAST(sum(c) OVER (PARTITION BY x) + sum(c) OVER (PARTITION BY y) - c AS double) AS jaccard FROM ev0),
lk AS (SELECT 'o' || x AS a, 'n' || y AS b FROM ev WHERE jaccard >= 0.25e0), lk2 AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
nd AS (SELECT DISTINCT 'o' || x AS a, 'old' AS side, x AS label FROM ev UNION SELECT DISTINCT 'n' || y, 'new', y FROM ev),
reach AS (SELECT a, a AS b FROM nd UNION SELECT r.a, l.b FROM reach r JOIN lk2 l ON r.b = l.a),
sz AS (SELECT a, count(*) FILTER (WHERE b LIKE 'o%') AS n_old, count(*) FILTER (WHERE b LIKE 'n%') AS n_new FROM reach GROUP BY a)"""


@query("cluster_events", f"""{_EVENT} SELECT side, label, CASE WHEN n_new = 0 THEN 'disappear' WHEN n_old = 0 THEN 'emerge' WHEN n_old = 1 AND n_new = 1 THEN 'survive'
    WHEN n_old = 1 THEN 'split' WHEN n_new = 1 THEN 'merge' ELSE 'reorganise' END AS event FROM nd JOIN sz USING (a)""")
def cluster_events(spark, sf_dir):
    t = _track(spark, sf_dir)
    table = T.contingency(t.filter("win = 0").select("id", "label"), t.filter("win = 7").select("id", "label"))
    return T.cluster_events(T.jaccard_matrix(table), 0.25)


_CAND = f"""WITH {SQL_CUSTOMERS}, sc AS (SELECT seg AS cand, unnest([{{'crit': 'bal', 'score': round(avg(bal), 2)}}, {{'crit': 'n_orders', 'score': round(avg(n_orders), 2)}}, {{'crit': 'size', 'score': CAST(count(*) AS double)}}]) AS s FROM cust GROUP BY seg),
scores AS (SELECT cand, s.crit AS crit, s.score AS score FROM sc),
wins AS (SELECT x.cand AS x, y.cand AS y, count(*) FILTER (WHERE x.score > y.score + 0.05e0) AS wins, count(*) FILTER (WHERE y.score > x.score + 0.05e0) AS losses FROM scores x JOIN scores y ON x.crit = y.crit AND x.cand <> y.cand GROUP BY 1, 2)"""


def _scores(spark, sf_dir):
    agg = customers(spark, sf_dir).groupBy(F.col("seg").alias("cand")).agg(
        F.round(F.avg("bal"), 2).alias("bal"), F.round(F.avg("n_orders"), 2).alias("n_orders"), F.count(F.lit(1)).cast("double").alias("size")
    )
    return agg.unpivot(["cand"], ["bal", "n_orders", "size"], "crit", "score")


@query("pair_wins", f"{_CAND} SELECT x, y, wins, losses FROM wins")
def pair_wins(spark, sf_dir):
    return C.pair_wins(_scores(spark, sf_dir), 0.05)


@query("pareto_front", f"{_CAND} SELECT DISTINCT cand FROM scores WHERE cand NOT IN (SELECT x FROM wins WHERE wins = 0 AND losses > 0)")
def pareto_front(spark, sf_dir):
    return C.pareto_front(_scores(spark, sf_dir), 0.05)


@query("copeland", f"{_CAND} SELECT x AS cand, CAST(sum(CASE WHEN wins > losses THEN 1 WHEN wins < losses THEN -1 ELSE 0 END) AS bigint) AS copeland FROM wins GROUP BY x")
def copeland(spark, sf_dir):
    return C.copeland(_scores(spark, sf_dir), 0.05)


@query("borda", f"{_CAND} SELECT cand, sum(r) AS borda FROM (SELECT cand, rank() OVER (PARTITION BY crit ORDER BY score) + (count(*) OVER (PARTITION BY crit, score) - 1) / 2.0e0 AS r FROM scores) GROUP BY cand")
def borda(spark, sf_dir):
    return C.borda(_scores(spark, sf_dir))


@query("lexicographic", f"""{_CAND}, w AS (SELECT cand, max(score) FILTER (WHERE crit = 'n_orders') AS n, max(score) FILTER (WHERE crit = 'bal') AS b FROM scores GROUP BY cand),
    k AS (SELECT * FROM w WHERE n >= (SELECT max(n) FROM w) - 0.05e0) SELECT cand FROM k WHERE b >= (SELECT max(b) FROM k) - 0.05e0""")
def lexicographic(spark, sf_dir):
    return C.lexicographic(_scores(spark, sf_dir), ["n_orders", "bal"], 0.05)


@query("choose_candidate", f"""{_CAND}, f AS (SELECT DISTINCT cand FROM scores WHERE cand NOT IN (SELECT x FROM wins WHERE wins = 0 AND losses > 0)),
    c AS (SELECT f.cand, CAST(coalesce(sum(CASE WHEN wins > losses THEN 1 WHEN wins < losses THEN -1 ELSE 0 END), 0) AS bigint) AS copeland FROM f LEFT JOIN (SELECT * FROM wins WHERE y IN (SELECT cand FROM f)) w ON w.x = f.cand GROUP BY 1)
    SELECT cand, copeland, CAST(row_number() OVER (ORDER BY copeland DESC, length(cand), cand) AS integer) AS place FROM c""")
def choose_candidate(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return C.choose(s, s.select("cand").distinct().withColumn("tie_1", F.length("cand")), 0.05)
