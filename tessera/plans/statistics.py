"""Statistics queries: robust scales, effect sizes, correlations, fits and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.ranks import avg_rank, pct_rank, quantile_group, rank01
from tessera.functions.scalars import compare_errors
from tessera.operators import stats as S

from .base import query
from .inputs import SQL_CUSTOMERS, SQL_MONTHLY, customers, monthly, read
from .panels import _r, rounded

_C = f"WITH {SQL_CUSTOMERS}"


def _rk(value: str, by: str = "") -> str:
    """SQL of an average rank."""
    over = f"PARTITION BY {by} " if by else ""
    ties = f"PARTITION BY {by}, {value}" if by else f"PARTITION BY {value}"
    return f"(rank() OVER ({over}ORDER BY {value}) + (count(*) OVER ({ties}) - 1) / CAST(2 AS double))"


@query("mad_by_group", f"{_C}, m AS (SELECT g, bal, median(bal) OVER (PARTITION BY g) AS m FROM cust) SELECT g, {_r('min(m)', 6)} AS med, {_r('median(abs(bal - m))', 6)} AS mad FROM m GROUP BY g")
def mad_by_group(spark, sf_dir):
    return rounded(S.mad(customers(spark, sf_dir), "bal", ["g"]), "med", "mad", digits=6)


_ROBUST = f"{_C}, m AS (SELECT *, median(n_orders) OVER (PARTITION BY seg) AS m, stddev_pop(n_orders) OVER (PARTITION BY seg) AS sd FROM cust), d AS (SELECT *, median(abs(n_orders - m)) OVER (PARTITION BY seg) AS d FROM m)"


@query("robust_z_group", f"{_ROBUST} SELECT id, {_r('(n_orders - m) / nullif(CAST(1.4826 AS double) * d, 0)')} AS z FROM d")
def robust_z_group(spark, sf_dir):
    return rounded(S.robust_z(customers(spark, sf_dir), "n_orders", ["seg"]).select("id", "z"), "z")


@query("robust_scale", f"{_ROBUST} SELECT id, {_r('coalesce((n_orders - m) / nullif(CASE WHEN d > 0 THEN CAST(1.4826 AS double) * d ELSE sd END, 0), 0.0)')} AS z FROM d")
def robust_scale(spark, sf_dir):
    return rounded(S.robust_scale(customers(spark, sf_dir), "n_orders", ["seg"]).select("id", "z"), "z")


@query("weighted_quantile_icdf", f"""{_C}, c AS (SELECT seg, bal, sum(n_orders) OVER (PARTITION BY seg ORDER BY bal) / CAST(sum(n_orders) OVER (PARTITION BY seg) AS double) AS c FROM cust WHERE n_orders > 0)
    SELECT seg, min(bal) AS wq FROM c WHERE c >= 0.5 - 1e-12 GROUP BY seg""")
def weighted_quantile_icdf(spark, sf_dir):
    return S.weighted_quantile_icdf(customers(spark, sf_dir), "bal", "n_orders", 0.5, ["seg"])


@query(
    "weighted_quantile_t7",
    f"""{_C}, c AS (SELECT seg, bal, sum(n_orders) OVER (PARTITION BY seg ORDER BY bal) / CAST(sum(n_orders) OVER (PARTITION BY seg) AS double) * count(*) OVER (PARTITION BY seg) AS c,
      (count(*) OVER (PARTITION BY seg) - 1) * CAST(0.75 AS double) + 1 AS h, 1e-9 * count(*) OVER (PARTITION BY seg) AS e FROM cust WHERE n_orders > 0),
    a AS (SELECT seg, min(CASE WHEN c >= floor(h + e) - e THEN bal END) AS lo, min(CASE WHEN c >= floor(h + e) + 1 - e THEN bal END) AS hi, max(greatest(h - floor(h + e), 0.0)) AS f FROM c GROUP BY seg)
    SELECT seg, {_r("lo + f * (coalesce(hi, lo) - lo)")} AS wq FROM a""",
)
def weighted_quantile_t7(spark, sf_dir):
    return rounded(S.weighted_quantile_t7(customers(spark, sf_dir), "bal", "n_orders", 0.75, ["seg"]), "wq")


@query("weighted_mean_by_group", f"{_C} SELECT g, {_r('sum(bal * n_orders) / nullif(sum(n_orders), 0)')} AS wmean FROM cust WHERE n_orders > 0 GROUP BY g")
def weighted_mean_by_group(spark, sf_dir):
    return rounded(S.weighted_mean(customers(spark, sf_dir).filter("n_orders > 0"), "bal", "n_orders", ["g"]), "wmean")


@query("smd", f"""{_C} SELECT seg, {_r("(avg(CASE WHEN n_orders > 8 THEN bal END) - avg(CASE WHEN n_orders <= 8 THEN bal END)) / nullif(sqrt((var_samp(CASE WHEN n_orders > 8 THEN bal END) + var_samp(CASE WHEN n_orders <= 8 THEN bal END)) / 2), 0)")} AS smd FROM cust GROUP BY seg""")
def smd(spark, sf_dir):
    return rounded(S.smd(customers(spark, sf_dir).withColumn("high", F.col("n_orders") > 8), "bal", "high", ["seg"]), "smd")


_ETA = f"""{_C}, m AS (SELECT bal, avg(bal) OVER (PARTITION BY g) AS m, avg(bal) OVER () AS gm, g FROM cust),
    e AS (SELECT sum((m - gm) * (m - gm)) / sum((bal - gm) * (bal - gm)) AS e, count(*) AS n, count(DISTINCT g) AS k FROM m)"""


@query("eta2", f"{_ETA} SELECT {_r('e')} AS eta2, {_r('1 - (1 - e) * (CAST(n - 1 AS double) / (n - k))')} AS eta2_adj, n, k FROM e")
def eta2(spark, sf_dir):
    return rounded(S.eta2(customers(spark, sf_dir), "bal", "g"), "eta2", "eta2_adj")


@query(
    "epsilon2",
    f"""{_C}, r AS (SELECT seg, {_rk('bal')} AS r FROM cust), p AS (SELECT sum(s * s / c) AS b, CAST(sum(c) AS double) AS n FROM (SELECT seg, sum(r) AS s, count(*) AS c FROM r GROUP BY seg)),
    t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT r, count(*) AS c FROM r GROUP BY r)), h AS (SELECT (12 / (n * (n + 1)) * b - 3 * (n + 1)) / (1 - t / (pow(n, 3) - n)) AS h, n FROM p, t)
    SELECT {_r("h", 5)} AS h, {_r("h / (n - 1)")} AS epsilon2 FROM h""",
)
def epsilon2(spark, sf_dir):
    return rounded(rounded(S.epsilon2(customers(spark, sf_dir), "bal", "seg"), "h", digits=5), "epsilon2")


_CLIFF = f"""{_C}, r AS (SELECT g, n_orders > 8 AS hi, {_rk('bal', 'g')} AS r FROM cust),
    s AS (SELECT g, sum(CASE WHEN hi THEN r END) AS r1, CAST(count(*) FILTER (WHERE hi) AS double) AS n1, CAST(count(*) FILTER (WHERE NOT hi) AS double) AS n2 FROM r GROUP BY g),
    u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM s)"""


@query("cliff_delta", f"{_CLIFF} SELECT g, {_r('2 * u / nullif(n1 * n2, 0) - 1')} AS delta, {_r('u', 1)} AS u, {_r('(u - n1 * n2 / 2) / nullif(sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 0)')} AS z FROM u")
def cliff_delta(spark, sf_dir):
    d = S.cliff_delta(customers(spark, sf_dir).withColumn("high", F.col("n_orders") > 8), "bal", "high", ["g"])
    return rounded(rounded(d, "delta", "z"), "u", digits=1)


@query("status_delta", f"""{_CLIFF}, w AS (SELECT 2 * u / (n1 * n2) - 1 AS d, n1 * n2 / (n1 + n2) AS w FROM u WHERE n1 > 0 AND n2 > 0) SELECT {_r("sum(d * w) / sum(w)")} AS delta FROM w""")
def status_delta(spark, sf_dir):
    rows = customers(spark, sf_dir).withColumn("high", F.col("n_orders") > 8)
    sizes = rows.groupBy("g").agg(F.count_if("high").cast("double").alias("n1"), F.count_if(~F.col("high")).cast("double").alias("n2")).filter("n1 > 0 and n2 > 0")
    d = S.cliff_delta(rows, "bal", "high", ["g"]).join(sizes.select("g", (F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))).alias("w")), "g")
    return rounded(d.agg((F.sum(F.col("delta") * F.col("w")) / F.sum("w")).alias("delta")), "delta")


@query("spearman_by_group", f"{_C}, r AS (SELECT seg, {_rk('bal', 'seg')} AS a, {_rk('spend', 'seg')} AS b FROM cust) SELECT seg, {_r('corr(a, b)')} AS rho, count(*) AS n FROM r GROUP BY seg")
def spearman_by_group(spark, sf_dir):
    return rounded(S.spearman(customers(spark, sf_dir), "bal", "spend", ["seg"]), "rho")


_WITHIN = f"""{_C}, r AS (SELECT g, {_rk('bal')} AS a, {_rk('spend')} AS b FROM cust), c AS (SELECT a - avg(a) OVER (PARTITION BY g) AS a, b - avg(b) OVER (PARTITION BY g) AS b, count(*) OVER (PARTITION BY g) AS n FROM r)"""


@query("spearman_within", f"{_WITHIN} SELECT {_r('sum(a * b) / sqrt(sum(a * a) * sum(b * b))')} AS rho, count(*) AS n FROM c WHERE n > 1")
def spearman_within(spark, sf_dir):
    return rounded(S.spearman_within(customers(spark, sf_dir), "bal", "spend", "g"), "rho")


@query("partial_spearman", f"""{_C}, r AS (SELECT seg, {_rk('bal', 'seg')} AS x, {_rk('spend', 'seg')} AS y, {_rk('n_orders', 'seg')} AS z FROM cust),
    c AS (SELECT seg, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz, count(*) AS n FROM r GROUP BY seg)
    SELECT seg, {_r("(xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))")} AS rho, n FROM c""")
def partial_spearman(spark, sf_dir):
    return rounded(S.partial_spearman(customers(spark, sf_dir), "bal", "spend", "n_orders", ["seg"]), "rho")


@query("spearman_matrix", f"{_C} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {_r('corr(x, y)')} AS rho FROM (SELECT {_rk(a)} AS x, {_rk(b)} AS y FROM cust)" for a, b in (("bal", "n_orders"), ("bal", "spend"), ("n_orders", "spend"))))
def spearman_matrix(spark, sf_dir):
    return rounded(S.correlation_matrix(customers(spark, sf_dir), ["bal", "n_orders", "spend"]), "rho")


@query("theil_sen", f"""WITH {SQL_MONTHLY}, s AS (SELECT a.id, median((b.y - a.y) / (b.t - a.t)) AS slope FROM monthly a JOIN monthly b ON a.id = b.id AND a.t < b.t GROUP BY a.id)
    SELECT m.id, {_r("min(slope)")} AS slope, {_r("median(y - slope * t)")} AS intercept FROM monthly m JOIN s USING (id) GROUP BY m.id""")
def theil_sen(spark, sf_dir):
    return rounded(S.theil_sen(monthly(spark, sf_dir), "t", "y", "t", ["id"]), "slope", "intercept")


@query("fe_residuals", f"""{_C}, d AS (SELECT id, bal - avg(bal) OVER (PARTITION BY g) AS x, n_orders - avg(n_orders) OVER (PARTITION BY g) AS y FROM cust)
    SELECT id, {_r("y - sum(x * y) OVER () / sum(x * x) OVER () * x")} AS resid FROM d""")
def fe_residuals(spark, sf_dir):
    return rounded(S.fe_residuals(customers(spark, sf_dir), "bal", "n_orders", "g").select("id", "resid"), "resid")


_P = "p AS (SELECT s_suppkey AS id, (abs(s_acctbal) + 1) / 10001.0e0 AS p FROM supplier)"


def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), ((F.abs("s_acctbal") + 1) / 10001.0).alias("p"))


@query("bh_qvalues", f"""WITH {_P}, k AS (SELECT *, count(*) OVER () AS m, count(*) OVER () - rank() OVER (ORDER BY p DESC) + 1 AS k FROM p)
    SELECT id, {_r("least(min(p * m / k) OVER (ORDER BY p DESC), 1.0)")} AS q FROM k""")
def bh_qvalues(spark, sf_dir):
    return rounded(S.bh_qvalues(_p_values(spark, sf_dir)).select("id", "q"), "q")


@query("holm_adjusted", f"""WITH {_P}, k AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, id) + 1) * p AS s FROM p)
    SELECT id, {_r("least(max(s) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING), 1.0)")} AS p_holm FROM k""")
def holm_adjusted(spark, sf_dir):
    return rounded(S.holm(_p_values(spark, sf_dir)).select("id", "p_holm"), "p_holm")


@query("value_bins", f"""{_C}, e AS (SELECT seg, quantile_cont(bal, [0.2, 0.4, 0.6, 0.8]) AS e FROM cust GROUP BY seg),
    b AS (SELECT seg, len(list_filter(e, lambda x: x < bal)) AS bin, spend FROM cust JOIN e USING (seg)) SELECT seg, CAST(bin AS integer) AS bin, count(*) AS n, {_r("median(spend)", 6)} AS med FROM b GROUP BY 1, 2""")
def value_bins(spark, sf_dir):
    c = customers(spark, sf_dir)
    b = S.assign_bins(c, S.quantile_edges(c, "bal", 5, ["seg"]), "bal", ["seg"])
    return rounded(b.groupBy("seg", "bin").agg(F.count(F.lit(1)).alias("n"), F.median("spend").alias("med")), "med", digits=6)


@query("rank_quantiles", f"{_C} SELECT id, CAST(floor((row_number() OVER (PARTITION BY g ORDER BY bal, id) - 1) * 5 / count(*) OVER (PARTITION BY g)) AS integer) AS q FROM cust")
def rank_quantiles(spark, sf_dir):
    return customers(spark, sf_dir).select("id", quantile_group("bal", "id", 5, ["g"]).alias("q"))


@query("rank01", f"{_C} SELECT id, {_r('CASE WHEN count(*) OVER (PARTITION BY g) = 1 THEN 1.0 ELSE (' + _rk('n_orders', 'g') + ' - 1) / nullif(count(*) OVER (PARTITION BY g) - 1, 0) END')} AS r FROM cust")
def rank01_query(spark, sf_dir):
    return rounded(customers(spark, sf_dir).select("id", rank01("n_orders", ["g"]).alias("r")), "r")


@query("within_ranks", f"{_C} SELECT id, {_r(_rk('bal', 'g') + ' / count(*) OVER (PARTITION BY g)')} AS r FROM cust")
def within_ranks(spark, sf_dir):
    return rounded(customers(spark, sf_dir).select("id", pct_rank("bal", ["g"]).alias("r")), "r")


@query("rank_sum", f"{_C} SELECT id, {_r(_rk('bal') + ' + ' + _rk('n_orders'), 1)} AS s FROM cust")
def rank_sum(spark, sf_dir):
    return rounded(customers(spark, sf_dir).select("id", (avg_rank("bal") + avg_rank("n_orders")).alias("s")), "s", digits=1)


@query("extremes_topn", f"""{_C}, r AS (SELECT id, seg, bal, row_number() OVER (PARTITION BY seg ORDER BY bal DESC, id) AS hi, row_number() OVER (PARTITION BY seg ORDER BY bal, id) AS lo FROM cust)
    SELECT id, seg, bal, CASE WHEN hi <= 5 THEN 'top' ELSE 'bottom' END AS side FROM r WHERE hi <= 5 OR lo <= 5""")
def extremes_topn(spark, sf_dir):
    w = Window.partitionBy("seg")
    r = customers(spark, sf_dir).select("id", "seg", "bal", F.row_number().over(w.orderBy(F.desc("bal"), "id")).alias("hi"), F.row_number().over(w.orderBy("bal", "id")).alias("lo"))
    return r.filter("hi <= 5 or lo <= 5").select("id", "seg", "bal", F.when(F.col("hi") <= 5, "top").otherwise("bottom").alias("side"))


@query("median_example", f"""{_C}, d AS (SELECT id, seg, abs(bal - median(bal) OVER (PARTITION BY seg)) AS d FROM cust) SELECT seg, id FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY round(d, 6), id) AS n FROM d) WHERE n = 1""")
def median_example(spark, sf_dir):
    d = customers(spark, sf_dir).select("id", "seg", F.abs(F.col("bal") - F.median("bal").over(Window.partitionBy("seg"))).alias("d"))
    return d.withColumn("n", F.row_number().over(Window.partitionBy("seg").orderBy(F.round("d", 6), "id"))).filter("n = 1").select("seg", "id")


@query("impute_group_median", f"""{_C}, x AS (SELECT id, g, CASE WHEN id % 7 <> 0 AND g <> 3 THEN bal END AS v FROM cust)
    SELECT id, {_r("coalesce(v, median(v) OVER (PARTITION BY g), median(v) OVER ())", 6)} AS v FROM x""")
def impute_group_median(spark, sf_dir):
    x = customers(spark, sf_dir).select("id", "g", F.when((F.col("id") % 7 != 0) & (F.col("g") != 3), F.col("bal")).alias("v"))
    return rounded(x.select("id", F.coalesce("v", F.median("v").over(Window.partitionBy("g")), F.median("v").over(Window.partitionBy())).alias("v")), "v", digits=6)


@query("compare_groups", f"{_C} SELECT seg, count(*) AS n, {_r('median(bal)', 6)} AS med, {_r('median(CASE WHEN n_orders > 8 THEN bal END) / nullif(median(CASE WHEN n_orders <= 8 THEN bal END), 0)')} AS ratio FROM cust GROUP BY seg")
def compare_groups(spark, sf_dir):
    hi, lo = (F.median(F.when(c, F.col("bal"))) for c in (F.col("n_orders") > 8, F.col("n_orders") <= 8))
    agg = customers(spark, sf_dir).groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.median("bal").alias("med"), F.try_divide(hi, lo).alias("ratio"))
    return rounded(rounded(agg, "med", digits=6), "ratio")


@query("paired_by_region", f"""{_C}, p AS (SELECT g, median(CASE WHEN seg = 'BUILDING' THEN bal END) AS a, median(CASE WHEN seg = 'MACHINERY' THEN bal END) AS b FROM cust GROUP BY g)
    SELECT count(*) AS n, count(*) FILTER (WHERE a > b) AS above, {_r("median(a - b)", 6)} AS med FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_by_region(spark, sf_dir):
    p = customers(spark, sf_dir).groupBy("g").agg(*[F.median(F.when(F.col("seg") == s, F.col("bal"))).alias(n) for n, s in (("a", "BUILDING"), ("b", "MACHINERY"))])
    agg = p.dropna().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") > F.col("b")).alias("above"), F.median(F.col("a") - F.col("b")).alias("med"))
    return rounded(agg, "med", digits=6)


@query("compare_errors", f"""{_C}, e AS (SELECT g, abs(bal - 4000) AS a, abs(bal - 5000) AS b FROM cust), c AS (SELECT g, CASE WHEN a < b - 1e-12 THEN 'a' WHEN b < a - 1e-12 THEN 'b' ELSE 'tie' END AS closer FROM e)
    SELECT g, closer, count(*) AS n FROM c GROUP BY g, closer""")
def compare_errors_query(spark, sf_dir):
    e = customers(spark, sf_dir).select("g", compare_errors(F.abs(F.col("bal") - 4000), F.abs(F.col("bal") - 5000)).alias("closer"))
    return e.groupBy("g", "closer").agg(F.count(F.lit(1)).alias("n"))


@query("moments", f"{_C} SELECT seg, {_r('skewness(bal)')} AS skew, {_r('stddev_samp(bal)', 6)} AS sd, count(DISTINCT g) AS groups FROM cust GROUP BY seg".replace("skewness(bal)", "(avg(pow(bal, 3)) - 3 * avg(bal) * avg(bal * bal) + 2 * pow(avg(bal), 3)) / pow(var_pop(bal), 1.5)"))
def moments(spark, sf_dir):
    agg = customers(spark, sf_dir).groupBy("seg").agg(F.skewness("bal").alias("skew"), F.stddev_samp("bal").alias("sd"), F.countDistinct("g").alias("groups"))
    return rounded(rounded(agg, "skew"), "sd", digits=6)


@query("missingness_smd", f"""WITH d AS (SELECT doc_id, n_chars, lang, doc_id IN (SELECT doc_id FROM labels) AS has FROM documents)
    SELECT lang, count(*) AS n, count(*) FILTER (WHERE has) AS labelled, {_r("(avg(CASE WHEN has THEN n_chars END) - avg(CASE WHEN NOT has THEN n_chars END)) / nullif(sqrt((var_samp(CASE WHEN has THEN n_chars END) + var_samp(CASE WHEN NOT has THEN n_chars END)) / 2), 0)")} AS smd
    FROM d GROUP BY lang""")
def missingness_smd(spark, sf_dir):
    has = read(spark, sf_dir, "labels", "doc_id").distinct().withColumn("has", F.lit(True))
    d = read(spark, sf_dir, "documents", "doc_id", "n_chars", "lang").join(has, "doc_id", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    counts = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("has").alias("labelled"))
    return rounded(counts.join(S.smd(d, "n_chars", "has", ["lang"]), "lang"), "smd")
