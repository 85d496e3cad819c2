"""Network queries: pair similarities, neighbour graphs and graph measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.scalars import gravity_log, haversine_km
from tessera.operators import graphs as G
from tessera.operators import stats as S
from tessera.operators import validity as V

from .base import query
from .inputs import SQL_CUSTOMERS, SQL_FLOWS, SQL_MONTHLY, customers, monthly, read, strong_flows, vectors
from .panels import _r, rounded

#: Pairs are those within a peer group, here the vectors' label.
_VEC = """WITH vec AS (SELECT vec_id AS id, CAST(embedding AS double[]) AS v, CAST(label AS bigint) AS label FROM embeddings),
pr AS (SELECT x.id AS a, y.id AS b, x.v AS va, y.v AS vb FROM vec x JOIN vec y ON x.label = y.label AND x.id < y.id)"""


@query("cosine_pairs", f"{_VEC} SELECT a, b, {_r('list_dot_product(va, vb) / sqrt(list_dot_product(va, va) * list_dot_product(vb, vb))')} AS s FROM pr")
def cosine_pairs(spark, sf_dir):
    return G.cosine(vectors(spark, sf_dir), "v", "label", 6)


@query("euclid_pairs", f"{_VEC} SELECT a, b, {_r('list_distance(va, vb)')} AS d FROM pr")
def euclid_pairs(spark, sf_dir):
    return G.euclid(vectors(spark, sf_dir), "v", "label", 6)


_GAUSS = _VEC + ",\nds AS (SELECT a, b, list_distance(va, vb) AS d FROM pr)"


@query("gaussian_kernel", f"{_GAUSS} SELECT a, b, {_r('exp(-pow(d / (SELECT median(d) FROM ds), 2))')} AS s FROM ds")
def gaussian_kernel(spark, sf_dir):
    return G.gaussian(vectors(spark, sf_dir), "v", "label", 6)


_KNN = _GAUSS + """,
two AS (SELECT a, b, d FROM ds UNION ALL SELECT b, a, d FROM ds),
lists AS (SELECT * FROM (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rk FROM two) WHERE rk <= 5),
uni AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(d) AS w, count(*) AS n FROM lists GROUP BY 1, 2)"""


def _lists(spark, sf_dir, k=5):
    v = vectors(spark, sf_dir)
    return G.nearest(v, v, k, block="label")


@query("knn_lists", f"{_KNN} SELECT a, b, {_r('d')} AS d, CAST(rk AS integer) AS rank FROM lists")
def knn_lists(spark, sf_dir):
    return rounded(_lists(spark, sf_dir), "d").select("a", "b", "d", "rank")


@query("knn_edges", f"{_KNN} SELECT a, b, {_r('w')} AS w FROM uni")
def knn_edges(spark, sf_dir):
    return rounded(G.knn_edges(_lists(spark, sf_dir), "d"), "w")


@query("mutual_knn_edges", f"{_KNN} SELECT a, b, {_r('w')} AS w FROM uni WHERE n = 2")
def mutual_knn_edges(spark, sf_dir):
    return rounded(G.knn_edges(_lists(spark, sf_dir), "d", mutual=True), "w")


@query("k_occurrence", f"{_KNN} SELECT vec.id, count(l.b) AS k_occ FROM vec LEFT JOIN lists l ON l.b = vec.id GROUP BY vec.id")
def k_occurrence(spark, sf_dir):
    return G.k_occurrence(_lists(spark, sf_dir), vectors(spark, sf_dir))


@query("edge_jaccard", f"{_KNN}, l3 AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM lists WHERE rk <= 3) SELECT {_r('(SELECT count(*) FROM l3) / CAST((SELECT count(*) FROM uni) AS double)')} AS jaccard")
def edge_jaccard(spark, sf_dir):
    return rounded(G.depth_jaccard(_lists(spark, sf_dir), 3), "jaccard")


#: The neighbour queries over all vectors, whatever their label.
_ALL = """WITH vec AS (SELECT vec_id AS id, CAST(embedding AS double[]) AS v, CAST(label AS bigint) AS label FROM embeddings),
two AS (SELECT x.id AS a, y.id AS b, list_distance(x.v, y.v) AS d FROM vec x JOIN vec y ON x.id <> y.id),
lists AS (SELECT * FROM (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rk FROM two) WHERE rk <= 5),
uni AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(d) AS w, count(*) AS n FROM lists GROUP BY 1, 2)"""


def _all_lists(spark, sf_dir, k=5):
    v = vectors(spark, sf_dir)
    return G.nearest(v, v, k)


@query("all_knn_lists", f"{_ALL} SELECT a, b, {_r('d')} AS d, CAST(rk AS integer) AS rank FROM lists")
def all_knn_lists(spark, sf_dir):
    return rounded(_all_lists(spark, sf_dir), "d").select("a", "b", "d", "rank")


@query("all_knn_edges", f"{_ALL} SELECT a, b, {_r('w')} AS w FROM uni")
def all_knn_edges(spark, sf_dir):
    return rounded(G.knn_edges(_all_lists(spark, sf_dir), "d"), "w")


@query("all_mutual_knn_edges", f"{_ALL} SELECT a, b, {_r('w')} AS w FROM uni WHERE n = 2")
def all_mutual_knn_edges(spark, sf_dir):
    return rounded(G.knn_edges(_all_lists(spark, sf_dir), "d", mutual=True), "w")


@query("all_k_occurrence", f"{_ALL} SELECT vec.id, count(l.b) AS k_occ FROM vec LEFT JOIN lists l ON l.b = vec.id GROUP BY vec.id")
def all_k_occurrence(spark, sf_dir):
    return G.k_occurrence(_all_lists(spark, sf_dir), vectors(spark, sf_dir))


@query("all_edge_jaccard", f"{_ALL}, l3 AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM lists WHERE rk <= 3) SELECT {_r('(SELECT count(*) FROM l3) / CAST((SELECT count(*) FROM uni) AS double)')} AS jaccard")
def all_edge_jaccard(spark, sf_dir):
    lists = _all_lists(spark, sf_dir)
    return rounded(G.edge_jaccard(G.knn_edges(lists, "d"), G.knn_edges(lists.filter("rank <= 3"), "d")), "jaccard")


@query("neighbor_label_agreement", f"{_ALL} SELECT x.label, {_r('avg(CASE WHEN x.label = y.label THEN 1.0 ELSE 0.0 END)')} AS same, count(*) AS n FROM lists JOIN vec x ON lists.a = x.id JOIN vec y ON lists.b = y.id GROUP BY x.label")
def neighbor_label_agreement(spark, sf_dir):
    lab = vectors(spark, sf_dir).select("id", "label")
    met = _all_lists(spark, sf_dir).join(lab.select(F.col("id").alias("a"), "label"), "a").join(lab.select(F.col("id").alias("b"), F.col("label").alias("l2")), "b")
    return rounded(met.groupBy("label").agg(F.avg((F.col("label") == F.col("l2")).cast("double")).alias("same"), F.count(F.lit(1)).alias("n")), "same")


_CORR = f"WITH {SQL_MONTHLY}"


@query("corr_pairs", f"{_CORR} SELECT a.id AS a, b.id AS b, {_r('corr(a.y, b.y)')} AS s, count(*) AS n FROM monthly a JOIN monthly b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 3")
def corr_pairs(spark, sf_dir):
    return rounded(G.series_correlation(monthly(spark, sf_dir)), "s")


@query(
    "lagged_corr",
    f"""{_CORR}, lags AS (SELECT unnest(range(-3, 4)) AS lag), c AS (SELECT a.id AS a, b.id AS b, lag, corr(a.y, b.y) AS s, count(*) AS n
      FROM monthly a CROSS JOIN lags JOIN monthly b ON b.t = a.t + lag AND a.id < b.id GROUP BY 1, 2, 3 HAVING count(*) >= 3)
    SELECT a, b, CAST(lag AS integer) AS lag, {_r("s")} AS s, n FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(s, 9) DESC, abs(lag), lag DESC) AS k FROM c WHERE s IS NOT NULL) WHERE k = 1""",
)
def lagged_corr(spark, sf_dir):
    return rounded(G.lagged_correlation(monthly(spark, sf_dir), 3), "s").select("a", "b", "lag", "s", "n")


@query("top_pairs", f"{_CORR}, c AS (SELECT a.id AS a, b.id AS b, round(corr(a.y, b.y), 6) AS w FROM monthly a JOIN monthly b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 3) SELECT a, b, w FROM c WHERE w >= (SELECT min(w) FROM (SELECT w FROM c ORDER BY w DESC LIMIT 20))")
def top_pairs(spark, sf_dir):
    return G.top_pairs(G.series_correlation(monthly(spark, sf_dir)).withColumn("s", F.round("s", 6)), 20)


_GRAV = f"""WITH {SQL_CUSTOMERS}, n AS (SELECT g AS id, count(*) AS mass, (g * 37 % 120) - 60.0 AS lat, (g * 53 % 300) - 150.0 AS lon FROM cust GROUP BY g),
d AS (SELECT a.id AS a, b.id AS b, a.mass AS ma, b.mass AS mb, 2 * 6371.0088e0 * asin(sqrt(least(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2), 1.0))) AS km FROM n a JOIN n b ON a.id < b.id)"""


def _places(spark, sf_dir):
    lat, lon = (F.col("id") * 37 % 120) - F.lit(60.0), (F.col("id") * 53 % 300) - F.lit(150.0)
    n = customers(spark, sf_dir).groupBy(F.col("g").alias("id")).agg(F.count(F.lit(1)).alias("mass")).select("id", "mass", lat.alias("lat"), lon.alias("lon"))
    two = n.toDF("b", "mb", "lat2", "lon2")
    return n.toDF("a", "ma", "lat1", "lon1").join(two, F.col("a") < F.col("b")).withColumn("km", haversine_km("lat1", "lon1", "lat2", "lon2"))


@query("haversine", f"{_GRAV} SELECT a, b, {_r('km', 4)} AS km FROM d")
def haversine(spark, sf_dir):
    return rounded(_places(spark, sf_dir).select("a", "b", "km"), "km", digits=4)


@query("gravity", f"{_GRAV} SELECT a, b, {_r('ln(ma) + ln(mb) - 1.5 * ln(greatest(km, 50.0))')} AS s FROM d")
def gravity(spark, sf_dir):
    return rounded(_places(spark, sf_dir).select("a", "b", gravity_log("ma", "mb", "km", 1.5, 50).alias("s")), "s")


_FLOW = f"WITH {SQL_FLOWS}"


def _nations(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("g"))


@query("flow_edges", f"{_FLOW} SELECT a, b, w FROM strong")
def flow_edges(spark, sf_dir):
    return strong_flows(spark, sf_dir)


@query("degrees", f"{_FLOW} SELECT n_nationkey AS id, count(b) AS degree, coalesce(sum(w), 0.0) AS strength FROM nation LEFT JOIN both_ways ON a = n_nationkey GROUP BY 1")
def degrees(spark, sf_dir):
    return G.degrees(strong_flows(spark, sf_dir), _nations(spark, sf_dir))


_DEG = _FLOW + ", deg AS (SELECT n_nationkey AS id, n_regionkey AS g, count(b) AS degree FROM nation LEFT JOIN both_ways ON a = n_nationkey GROUP BY 1, 2)"


@query("clustering_coefficient", f"""{_DEG}, tri AS (SELECT x.a AS id, count(*) AS t2 FROM both_ways x JOIN both_ways y ON x.b = y.a JOIN both_ways z ON y.b = z.a AND z.b = x.a GROUP BY x.a)
    SELECT deg.id, degree, coalesce(t2 // 2, 0) AS triangles, {_r("coalesce(CAST(t2 // 2 AS double) / nullif(degree * (degree - 1) / CAST(2 AS double), 0), 0.0)")} AS clustering FROM deg LEFT JOIN tri USING (id)""")
def clustering_coefficient(spark, sf_dir):
    return rounded(G.clustering_coefficient(strong_flows(spark, sf_dir), _nations(spark, sf_dir)), "clustering")


@query("assortativity", f"{_DEG} SELECT {_r('corr(p.degree, q.degree)')} AS assortativity FROM both_ways JOIN deg p ON a = p.id JOIN deg q ON b = q.id")
def assortativity(spark, sf_dir):
    e = strong_flows(spark, sf_dir)
    d = G.degrees(e, _nations(spark, sf_dir)).select("id", F.col("degree").cast("double").alias("x"))
    return rounded(G.assortativity(e, d), "assortativity")


@query("components", f"""WITH RECURSIVE {SQL_FLOWS}, part_ AS (SELECT a, b FROM both_ways WHERE w >= (SELECT avg(w) + stddev_samp(w) FROM strong)),
    reach AS (SELECT n_nationkey AS id, n_nationkey AS r FROM nation UNION SELECT part_.b, reach.r FROM reach JOIN part_ ON part_.a = reach.id)
    SELECT id, min(r) AS component FROM reach GROUP BY id""")
def components(spark, sf_dir):
    every = Window.partitionBy()
    strong = strong_flows(spark, sf_dir).withColumn("_t", F.avg("w").over(every) + F.stddev_samp("w").over(every))
    some = strong.filter("w >= _t").drop("_t")
    return G.connected_components(some, _nations(spark, sf_dir))


@query("passport", f"""{_DEG}, e AS (SELECT count(*) AS m, count(*) FILTER (WHERE p.g = q.g) AS i FROM strong JOIN deg p ON a = p.id JOIN deg q ON b = q.id),
    d AS (SELECT count(*) AS n_nodes, count(*) FILTER (WHERE degree = 0) AS n_isolated, max(degree) AS max_degree FROM deg)
    SELECT n_nodes, m AS n_edges, n_isolated, max_degree, {_r("2 * m / (CAST(n_nodes AS double) * (n_nodes - 1))")} AS density, {_r("2 * m / CAST(n_nodes AS double)")} AS mean_degree, {_r("i / CAST(m AS double)")} AS within_share FROM d, e""")
def passport(spark, sf_dir):
    n = _nations(spark, sf_dir)
    return rounded(G.passport(strong_flows(spark, sf_dir), n, n), "density", "mean_degree", "within_share")


@query("morans_i", f"""{_FLOW}, x AS (SELECT c_nationkey AS id, round(avg(c_acctbal), 4) AS x FROM customer GROUP BY 1), z AS (SELECT id, x - (SELECT avg(x) FROM x) AS z FROM x),
    nw AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS w FROM both_ways), s AS (SELECT sum(w * p.z * q.z) AS num, sum(w) AS s0 FROM nw JOIN z p ON a = p.id JOIN z q ON b = q.id)
    SELECT {_r("(SELECT count(*) FROM z) / s0 * num / (SELECT sum(z * z) FROM z)")} AS moran_i, (SELECT count(*) FROM z) AS n FROM s""")
def morans_i(spark, sf_dir):
    x = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.round(F.avg("c_acctbal"), 4).alias("x"))
    return rounded(S.morans_i(x, G.both_ways(strong_flows(spark, sf_dir), "w")), "moran_i")


_LAB = _FLOW + """, lab AS (SELECT n_nationkey AS id, n_regionkey AS label FROM nation),
m AS (SELECT p.label AS k, q.label AS l, sum(w) AS m FROM both_ways JOIN lab p ON a = p.id JOIN lab q ON b = q.id GROUP BY 1, 2),
v AS (SELECT k, sum(m) AS vol, sum(CASE WHEN k = l THEN m ELSE 0.0 END) AS own FROM m GROUP BY k)"""


def _matrix(spark, sf_dir):
    labels = _nations(spark, sf_dir).select("id", F.col("g").alias("label"))
    return V.cluster_matrix(strong_flows(spark, sf_dir), labels)


@query("cluster_matrix", f"{_LAB} SELECT k, l, m FROM m")
def cluster_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query("modularity", f"{_LAB} SELECT {_r('sum(own / w2 - pow(vol / w2, 2))')} AS modularity FROM v, (SELECT sum(vol) AS w2 FROM v)")
def modularity(spark, sf_dir):
    return rounded(V.modularity(_matrix(spark, sf_dir)), "modularity")


@query("avi_avu", f"""{_LAB}, a AS (SELECT avg(own / vol) AS avi, CAST(count(*) AS double) AS n FROM v),
    u AS (SELECT coalesce(sum(m / nullif(p.vol - p.own + q.vol - q.own - m, 0)), 0) AS u FROM m JOIN v p ON m.k = p.k JOIN v q ON m.l = q.k WHERE m.k <> m.l)
    SELECT {_r("avi")} AS avi, {_r("u / n")} AS avu, {_r("avi / (1 + avi * (u / n))")} AS anui FROM a, u""")
def avi_avu(spark, sf_dir):
    return rounded(V.isolability_unifiability(_matrix(spark, sf_dir)), "avi", "avu", "anui")
