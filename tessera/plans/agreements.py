"""Runs, filled weights, profiles, partition agreement, feasibility and choices among candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ranks import pct_rank
from tessera.operators import comparisons as C
from tessera.operators import stats
from tessera.operators import summaries as S

from .analyses import n_rows, share_of
from .base import query
from .inputs import PARTS, SQL_CUSTOMERS, SQL_FLOWS, SQL_MONTHLY, SQL_WIDE, customers, flows, monthly, read, strong_flows
from .panels import _r, clr, complete, rounded, shares

_C, _M, _W = f"WITH {SQL_CUSTOMERS}", f"WITH {SQL_MONTHLY}", f"WITH {SQL_WIDE}"
_SUM = "(" + " + ".join(PARTS) + ")"


# ---- runs, weights and coverage ------------------------------------------------------
@query("longest_low_run", f"""{_M}, m AS (SELECT id, t, v < avg(v) OVER (PARTITION BY id) AS low FROM monthly),
    s AS (SELECT id, t, low, CASE WHEN low AND lag(low) OVER w AND lag(t) OVER w = t - 1 THEN 0 ELSE 1 END AS starts FROM m WINDOW w AS (PARTITION BY id ORDER BY t)),
    r AS (SELECT id, low, sum(starts) OVER (PARTITION BY id ORDER BY t) AS run FROM s), n AS (SELECT id, run, count(*) AS n FROM r WHERE low GROUP BY id, run)
    SELECT m.id, coalesce(max(n), 0) AS run FROM (SELECT DISTINCT id FROM m) m LEFT JOIN n ON n.id = m.id GROUP BY m.id""")
def longest_low_run(spark, sf_dir):
    m = monthly(spark, sf_dir).select("id", "t", (F.col("v") < F.avg("v").over(Window.partitionBy("id"))).alias("low"))
    return C.longest_run(m, "id", "t", F.col("low"))


_YEARLY = f"{_M}, yr AS (SELECT id, CAST(floor(t / 12.0e0) AS integer) AS y, round(sum(v), 2) AS w FROM monthly GROUP BY 1, 2), gap AS (SELECT id, y, CASE WHEN (id + y) % 3 = 0 THEN NULL ELSE w END AS w FROM yr)"


def yearly(spark, sf_dir) -> DataFrame:
    """``id, y, w``: yearly totals, every third one unknown."""
    y = monthly(spark, sf_dir).groupBy("id", F.floor(F.col("t") / 12.0).cast("int").alias("y")).agg(F.round(F.sum("v"), 2).alias("w"))
    return y.withColumn("w", F.when((F.col("id") + F.col("y")) % 3 != 0, F.col("w")))


@query("filled_weights", f"{_YEARLY} SELECT id, y, coalesce(w, (SELECT p.w FROM gap p WHERE p.id = gap.id AND p.y < gap.y AND p.w IS NOT NULL ORDER BY p.y DESC LIMIT 1), (SELECT p.w FROM gap p WHERE p.id = gap.id AND p.y > gap.y AND p.w IS NOT NULL ORDER BY p.y LIMIT 1)) AS w FROM gap")
def filled_weights(spark, sf_dir):
    return C.fill_from_years(yearly(spark, sf_dir), "id", "y", "w")


@query("covered_groups", f"{_C} SELECT g, coalesce(sum(CASE WHEN bal > 0 THEN n_orders END) / nullif(CAST(sum(n_orders) AS double), 0), 0) >= 0.9e0 - 1e-12 AS covered FROM cust GROUP BY g")
def covered_groups(spark, sf_dir):
    return customers(spark, sf_dir).groupBy("g").agg(C.covered(F.col("bal") > 0, "n_orders", 0.9).alias("covered"))


@query("cell_codes", f"{_C} SELECT id, CAST(dense_rank() OVER (ORDER BY seg, g) - 1 AS integer) AS code FROM cust")
def cell_codes(spark, sf_dir):
    return C.cell_codes(customers(spark, sf_dir), "seg", "g").select("id", "code")


# ---- composition and profiles --------------------------------------------------------
@query("entity_and_resident", f"""{_C}, n AS (SELECT g AS id, count(*) AS pop FROM cust GROUP BY g), {SQL_WIDE}, l AS (SELECT id, t, p, x FROM full_ UNPIVOT (x FOR p IN ({', '.join(PARTS)})))
    SELECT p, {_r('median(x)', 4)} AS entity, {_r('avg(x)', 4)} AS mean, {_r('sum(x * pop) / CAST(sum(pop) AS double)', 4)} AS resident FROM l JOIN n ON l.id = n.id GROUP BY p""")
def entity_and_resident(spark, sf_dir):
    """Each part for the typical nation and, weighted by customers, for the typical customer."""
    pop = customers(spark, sf_dir).groupBy(F.col("g").alias("id")).agg(n_rows().alias("pop"))
    long = S.unpivot_values(complete(spark, sf_dir).join(pop, "id"), ["pop"], {p: p for p in PARTS}, "p")
    resident = F.sum(F.col("x") * F.col("pop")) / F.sum("pop").cast("double")
    return rounded(long.groupBy("p").agg(F.median("x").alias("entity"), F.avg("x").alias("mean"), resident.alias("resident")), "entity", "mean", "resident", digits=4)


@query("part_spread", f"""{_W}, s AS (SELECT id, t, {', '.join(f'{p} / {_SUM} AS {p}' for p in PARTS)} FROM full_), l AS (SELECT p, x FROM s UNPIVOT (x FOR p IN ({', '.join(PARTS)})))
    SELECT p, {_r('quantile_cont(x, 0.25)')} AS q1, {_r('median(x)')} AS med, {_r('quantile_cont(x, 0.75)')} AS q3, {_r('quantile_cont(x, 0.75) / quantile_cont(x, 0.25)')} AS ratio FROM l GROUP BY p""")
def part_spread(spark, sf_dir):
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    l = S.unpivot_values(shares(spark, sf_dir), [], {p: p for p in PARTS}, "p").groupBy("p").agg(q.alias("q"))  # noqa: E741
    low, mid, high = [F.col("q")[i] for i in range(3)]
    return rounded(l.select("p", low.alias("q1"), mid.alias("med"), high.alias("q3"), (high / low).alias("ratio")), "q1", "med", "q3", "ratio")


@query("clr_variance", f"""{_W}, c AS (SELECT {', '.join(f'ln({p}) - ({" + ".join(f"ln({q})" for q in PARTS)}) / 5 AS {p}' for p in PARTS)} FROM full_), l AS (SELECT p, x FROM c UNPIVOT (x FOR p IN ({', '.join(PARTS)})))
    SELECT p, {_r('var_samp(x)')} AS v, {_r('var_samp(x) / sum(var_samp(x)) OVER ()')} AS share FROM l GROUP BY p""")
def clr_variance(spark, sf_dir):
    v = S.unpivot_values(clr(spark, sf_dir), [], {p: p for p in PARTS}, "p").groupBy("p").agg(F.var_samp("x").alias("v"))
    return rounded(S.beside(v, F.sum("v").alias("_all")).select("p", "v", (F.col("v") / F.col("_all")).alias("share")), "v", "share")


@query("month_set_share", f"{_W} SELECT id, {_r('sum(p1) / sum' + _SUM)} AS share FROM full_ WHERE t % 12 IN (10, 11) GROUP BY id")
def month_set_share(spark, sf_dir):
    f = complete(spark, sf_dir).filter((F.col("t") % 12).isin(10, 11))
    return rounded(f.groupBy("id").agg((F.sum("p1") / F.sum(sum((F.col(p) for p in PARTS[1:]), F.col("p1")))).alias("share")), "share")


@query("two_year_composition", f"{_W}, s AS (SELECT id, {', '.join(f'sum({p}) AS {p}' for p in PARTS)} FROM full_ WHERE t < 24 GROUP BY id) SELECT id, {', '.join(f'{_r(f"{p} / {_SUM}")} AS {p}' for p in PARTS)}, {_r(f'ln({_SUM})')} AS level FROM s")
def two_year_composition(spark, sf_dir):
    s = complete(spark, sf_dir).filter("t < 24").groupBy("id").agg(*[F.sum(p).alias(f"_{p}") for p in PARTS])
    whole = sum((F.col(f"_{p}") for p in PARTS[1:]), F.col("_p1"))
    return rounded(s.select("id", *[(F.col(f"_{p}") / whole).alias(p) for p in PARTS], F.ln(whole).alias("level")), *PARTS, "level")


_TWO = f"{_W}, w2 AS (SELECT id, sum(CASE WHEN t < 12 THEN p1 END) AS a, sum(CASE WHEN t BETWEEN 12 AND 23 THEN p1 END) AS b, sum(CASE WHEN t < 12 THEN {_SUM} END) AS wa, sum(CASE WHEN t BETWEEN 12 AND 23 THEN {_SUM} END) AS wb FROM full_ WHERE t < 24 GROUP BY id)"


@query("counterfactual_gain", f"{_TWO}, g AS (SELECT median(wb / wa) AS g FROM w2) SELECT id, {_r('b / (wa * g) - a / wa')} AS gain FROM w2 CROSS JOIN g")
def counterfactual_gain(spark, sf_dir):
    """How much a part's share would have grown had every nation's total grown by the median."""
    whole, first = sum((F.col(p) for p in PARTS[1:]), F.col("p1")), F.col("t") < 12
    w = complete(spark, sf_dir).filter("t < 24").groupBy("id").agg(*[F.sum(F.when(c, x)).alias(n) for n, c, x in (("a", first, F.col("p1")), ("b", ~first, F.col("p1")), ("wa", first, whole), ("wb", ~first, whole))])
    return rounded(C.counterfactual_gain(w, ("a", "b"), ("wa", "wb")).select("id", "gain"), "gain")


@query("whole_year_profile", f"""{_M}, y AS (SELECT id, t % 12 AS m, v / avg(v) OVER w AS r, count(*) OVER w AS n FROM monthly WINDOW w AS (PARTITION BY id, floor(t / 12.0e0)))
    SELECT m, {_r('median(r)')} AS med, {_r('quantile_cont(r, 0.75) - quantile_cont(r, 0.25)')} AS iqr FROM y WHERE n = 12 GROUP BY m""")
def whole_year_profile(spark, sf_dir):
    return rounded(C.ratio_profile(monthly(spark, sf_dir), "id", F.floor(F.col("t") / 12), F.col("t") % 12, "v"), "med", "iqr")


@query("year_on_year_index", f"{_M}, m AS (SELECT t, avg(v) AS x FROM monthly GROUP BY t) SELECT a.t, {_r('a.x / b.x')} AS ratio FROM m a JOIN m b ON b.t = a.t - 12")
def year_on_year_index(spark, sf_dir):
    m = monthly(spark, sf_dir).groupBy("t").agg(F.avg("v").alias("x"))
    return rounded(m.join(m.select((F.col("t") + 12).alias("t"), F.col("x").alias("before")), "t").select("t", (F.col("x") / F.col("before")).alias("ratio")), "ratio")


_PROFILE = f"{_M}, d AS (SELECT id, t % 12 AS m, t, y - avg(y) OVER (PARTITION BY id, floor(t / 12.0e0)) AS d FROM monthly WHERE t < 24), h AS (SELECT id, m, avg(d) AS p, avg(CASE WHEN t < 12 THEN d END) AS a, avg(CASE WHEN t >= 12 THEN d END) AS b FROM d GROUP BY id, m), k AS (SELECT id, max(p) - min(p) AS amp, corr(a, b) AS r, stddev_samp(a - b) / sqrt(2.0e0) AS s FROM h WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY id HAVING count(*) >= 3)"


@query("rhythm_against_noise", f"{_PROFILE} SELECT id, {_r('amp')} AS amp, {_r('3.258e0 * s / sqrt(2.0e0)')} AS noise, {_r('amp * greatest(r, 0.0e0)')} AS shrunk, round(r, 6) > 0.3e0 AND round(amp, 6) > 0.2e0 AS reliable FROM k")
def rhythm_against_noise(spark, sf_dir):
    """Amplitude of the monthly profile of two years, the range noise would give, and whether both years agree."""
    w = Window.partitionBy("id", F.floor(F.col("t") / 12))
    d = monthly(spark, sf_dir).filter("t < 24").select("id", "t", (F.col("y") - F.avg("y").over(w)).alias("d"))
    first = F.col("t") < 12
    h = d.groupBy("id", (F.col("t") % 12).alias("m")).agg(F.avg("d").alias("p"), F.avg(F.when(first, F.col("d"))).alias("a"), F.avg(F.when(~first, F.col("d"))).alias("b")).dropna()
    k = h.groupBy("id").agg((F.max("p") - F.min("p")).alias("amp"), F.corr("a", "b").alias("r"), (F.stddev_samp(F.col("a") - F.col("b")) / F.sqrt(F.lit(2.0))).alias("s"), n_rows().alias("_n")).filter("_n >= 3")
    out = k.select("id", "amp", C.noise_amplitude(F.col("s")).alias("noise"), C.shrunk_amplitude(F.col("amp"), F.col("r")).alias("shrunk"), ((F.round("r", 6) > 0.3) & (F.round("amp", 6) > 0.2)).alias("reliable"))
    return rounded(out, "amp", "noise", "shrunk")


@query("peak_shares", f"{_M}, p AS (SELECT id, g, t % 12 AS m, row_number() OVER (PARTITION BY id ORDER BY v DESC, t) AS n FROM monthly) SELECT g, {_r('avg(CASE WHEN m IN (11, 0, 1) THEN 1.0e0 ELSE 0.0e0 END)')} AS winter, count(*) AS n FROM p WHERE n = 1 GROUP BY g")
def peak_shares(spark, sf_dir):
    p = S.top_rows(monthly(spark, sf_dir), ["id"], [F.desc("v"), "t"]).withColumn("m", F.col("t") % 12)
    return rounded(p.groupBy("g").agg(share_of(F.col("m").isin(11, 0, 1)).alias("winter"), n_rows().alias("n")), "winter")


# ---- groups and effects ------------------------------------------------------------------
@query("skew_by_group", f"{_C}, m AS (SELECT seg, spend - avg(spend) OVER (PARTITION BY seg) AS d FROM cust) SELECT seg, {_r('avg(d * d * d) / pow(avg(d * d), 1.5e0)')} AS skew FROM m GROUP BY seg")
def skew_by_group(spark, sf_dir):
    return rounded(customers(spark, sf_dir).groupBy("seg").agg(C.skewness("spend").alias("skew")), "skew")


@query("simple_partitions", f"""{_C}, b AS (SELECT id, ntile(5) OVER (ORDER BY spend, id) AS q FROM cust)
    SELECT 'segment' AS part, seg AS label, count(*) AS n FROM cust GROUP BY seg UNION ALL SELECT 'nation', CAST(g AS varchar), count(*) FROM cust GROUP BY g UNION ALL SELECT 'quintile', CAST(q AS varchar), count(*) FROM b GROUP BY q""")
def simple_partitions(spark, sf_dir):
    c = S.tiles(customers(spark, sf_dir), "spend", "id", 5, "q")
    parts = {"segment": F.col("seg"), "nation": F.col("g").cast("string"), "quintile": F.col("q").cast("string")}
    return c.select(F.inline(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("label")) for k, v in parts.items()]))).groupBy("part", "label").agg(n_rows().alias("n"))


@query("status_difference", f"{_C} SELECT seg, {_r('avg(CASE WHEN spend > 1500000 THEN 1.0e0 ELSE 0.0e0 END)')} AS share, {_r('avg(CASE WHEN bal > 5000 THEN CASE WHEN spend > 1500000 THEN 1.0e0 ELSE 0.0e0 END END) - avg(CASE WHEN bal <= 5000 THEN CASE WHEN spend > 1500000 THEN 1.0e0 ELSE 0.0e0 END END)')} AS delta FROM cust GROUP BY seg")
def status_difference(spark, sf_dir):
    works, high = (F.col("spend") > 1_500_000).cast("double"), F.col("bal") > 5000
    delta = F.avg(F.when(high, works)) - F.avg(F.when(~high, works))
    return rounded(customers(spark, sf_dir).groupBy("seg").agg(F.avg(works).alias("share"), delta.alias("delta")), "share", "delta")


@query("stratified_delta", f"{_C}, s AS (SELECT g, avg(CASE WHEN n_orders > 8 THEN bal END) - avg(CASE WHEN n_orders <= 8 THEN bal END) AS d FROM cust GROUP BY g) SELECT {_r('avg(d)', 4)} AS delta, count(d) AS strata FROM s")
def stratified_delta(spark, sf_dir):
    return rounded(C.mean_stratified_delta(customers(spark, sf_dir), "bal", F.col("n_orders") > 8, "g"), "delta", digits=4)


@query("flagged_subset", f"{_C} SELECT count(CASE WHEN bal < 0 THEN 1 END) AS n, {_r('count(CASE WHEN bal < 0 THEN 1 END) / CAST(count(*) AS double)')} AS share, {_r('sum(CASE WHEN bal < 0 THEN spend END) / sum(spend)')} AS spend_share, count(DISTINCT CASE WHEN bal < 0 THEN g END) AS groups FROM cust")
def flagged_subset(spark, sf_dir):
    flag = F.col("bal") < 0
    r = customers(spark, sf_dir).agg(F.count_if(flag).alias("n"), share_of(flag).alias("share"), (F.sum(F.when(flag, F.col("spend"))) / F.sum("spend")).alias("spend_share"), F.countDistinct(F.when(flag, F.col("g"))).alias("groups"))
    return rounded(r, "share", "spend_share")


@query("split_growth_level", f"""{_M}, x AS (SELECT id, ln(sum(CASE WHEN t < 12 AND t % 2 = 0 THEN v END)) AS lv, ln(sum(CASE WHEN t BETWEEN 12 AND 23 AND t % 2 = 1 THEN v END)) - ln(sum(CASE WHEN t < 12 AND t % 2 = 1 THEN v END)) AS gr FROM monthly GROUP BY id),
    r AS (SELECT rank() OVER (ORDER BY lv) AS a, rank() OVER (ORDER BY gr) AS b FROM x WHERE lv IS NOT NULL AND gr IS NOT NULL) SELECT {_r('corr(a, b)')} AS rho, count(*) AS n FROM r""")
def split_growth_level(spark, sf_dir):
    """Rank correlation of level and growth from disjoint months, so that noise in the level isn't growth."""
    t = F.col("t")
    months = {"level": (t < 12) & (t % 2 == 0), "late": t.between(12, 23) & (t % 2 == 1), "early": (t < 12) & (t % 2 == 1)}
    x = monthly(spark, sf_dir).groupBy("id").agg(*[F.ln(F.sum(F.when(c, F.col("v")))).alias(k) for k, c in months.items()])
    return rounded(stats.spearman(x.select("level", (F.col("late") - F.col("early")).alias("growth")), "level", "growth"), "rho")


@query("partial_two_controls", f"""{_C}, k AS (SELECT corr(bal, spend) AS xy, corr(bal, n_orders) AS xu, corr(spend, n_orders) AS yu, corr(bal, g) AS xv, corr(spend, g) AS yv, corr(n_orders, g) AS uv FROM cust),
    q AS (SELECT (xy - xu * yu) / sqrt((1 - xu * xu) * (1 - yu * yu)) AS xy, (xv - xu * uv) / sqrt((1 - xu * xu) * (1 - uv * uv)) AS xv, (yv - yu * uv) / sqrt((1 - yu * yu) * (1 - uv * uv)) AS yv FROM k)
    SELECT {_r('(xy - xv * yv) / sqrt((1 - xv * xv) * (1 - yv * yv))')} AS r FROM q""")
def partial_two_controls(spark, sf_dir):
    c = customers(spark, sf_dir).select("bal", "spend", F.col("n_orders").cast("double").alias("n"), F.col("g").cast("double").alias("g"))
    return rounded(C.partial_two(c, "bal", "spend", ("n", "g")), "r")


@query("within_r2", f"""{_C}, d AS (SELECT bal - avg(bal) OVER w AS x, spend - avg(spend) OVER w AS y, n_orders - avg(CAST(n_orders AS double)) OVER w AS z FROM cust WINDOW w AS (PARTITION BY seg))
    SELECT 'spend' AS target, {_r('pow(sum(x * y), 2) / (sum(x * x) * sum(y * y))')} AS r2 FROM d UNION ALL SELECT 'orders', {_r('pow(sum(x * z), 2) / (sum(x * x) * sum(z * z))')} FROM d""")
def within_r2(spark, sf_dir):
    """Explained variance of two targets by the balance within segments, from moments by segment."""
    c = customers(spark, sf_dir).withColumn("orders", F.col("n_orders").cast("double"))
    n = F.count(F.lit(1))
    m = c.groupBy("seg").agg((n * F.var_pop("bal")).alias("xx"), *[x for y in ("spend", "orders") for x in ((n * F.covar_pop("bal", y)).alias(f"c_{y}"), (n * F.var_pop(y)).alias(f"v_{y}"))])
    r = m.agg(*[(F.sum(f"c_{y}") * F.sum(f"c_{y}") / (F.sum("xx") * F.sum(f"v_{y}"))).alias(y) for y in ("spend", "orders")])
    return rounded(S.unpivot_values(r, [], {"spend": "spend", "orders": "orders"}, "target", "r2"), "r2")


# ---- partitions and candidates ----------------------------------------------------------
_CANDS = f"""{_C}, lab AS (SELECT 'a' AS cand, id, CAST(n_orders % 3 AS integer) AS label FROM cust UNION ALL SELECT 'b', id, CAST(CASE WHEN bal < 0 THEN -1 ELSE floor(bal / 2500.0e0) END AS integer) FROM cust
    UNION ALL SELECT 'c', id, CAST(floor(n_orders / 8.0e0) AS integer) FROM cust)"""


def candidate_labels(spark, sf_dir) -> DataFrame:
    """``cand, id, label`` of three partitions of the customers; -1 is noise."""
    n, bal = F.col("n_orders"), F.col("bal")
    labels = {"a": n % 3, "b": F.when(bal < 0, -1).otherwise(F.floor(bal / 2500.0)), "c": F.floor(n / 8.0)}
    return customers(spark, sf_dir).select("id", F.inline(F.array(*[F.struct(F.lit(k).alias("cand"), v.cast("int").alias("label")) for k, v in labels.items()])))


@query("candidate_agreement", f"""{_CANDS}, x AS (SELECT p.cand AS p, q.cand AS q, p.label AS x, q.label AS y, CAST(count(*) AS double) AS n FROM lab p JOIN lab q ON p.id = q.id AND p.cand < q.cand GROUP BY ALL),
    a AS (SELECT p, q, sum(m * (m - 1) / 2) AS a FROM (SELECT p, q, x, sum(n) AS m FROM x GROUP BY p, q, x) t GROUP BY p, q), b AS (SELECT p, q, sum(m * (m - 1) / 2) AS b FROM (SELECT p, q, y, sum(n) AS m FROM x GROUP BY p, q, y) t GROUP BY p, q),
    c AS (SELECT p, q, sum(n * (n - 1) / 2) AS c, sum(n) AS n FROM x GROUP BY p, q)
    SELECT c.p, c.q, CAST(n AS bigint) AS n, {_r('(c - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2))')} AS ari FROM c JOIN a ON a.p = c.p AND a.q = c.q JOIN b ON b.p = c.p AND b.q = c.q""")
def candidate_agreement(spark, sf_dir):
    return rounded(C.agreement(candidate_labels(spark, sf_dir)), "ari")


_FEASIBLE = f"""{_CANDS}, s AS (SELECT cand, label, count(*) AS n FROM lab GROUP BY cand, label), w AS (SELECT cand, sum(n) AS n, sum(CASE WHEN label <> -1 THEN n END) AS kept FROM s GROUP BY cand),
    f AS (SELECT s.cand, count(CASE WHEN label <> -1 THEN 1 END) AS k, min(CASE WHEN label <> -1 THEN s.n / CAST(w.n AS double) END) AS least, coalesce(sum(CASE WHEN label = -1 THEN s.n / CAST(w.n AS double) END), 0) AS noise,
      -sum(CASE WHEN label <> -1 THEN s.n / CAST(kept AS double) * ln(s.n / CAST(kept AS double)) END) AS e FROM s JOIN w ON s.cand = w.cand GROUP BY s.cand)"""


@query("candidate_feasibility", f"{_FEASIBLE} SELECT cand, k, {_r('least')} AS least, {_r('noise')} AS noise, {_r('e / ln(CAST(k AS double))')} AS entropy, k > 1 AND least >= 0.05e0 AS ok FROM f")
def candidate_feasibility(spark, sf_dir):
    return rounded(C.feasibility(candidate_labels(spark, sf_dir), 0.05), "least", "noise", "entropy")


@query("threshold_winners", f"{_FEASIBLE}, t AS (SELECT 0.0e0 AS threshold UNION ALL SELECT 0.01e0 UNION ALL SELECT 0.1e0), r AS (SELECT threshold, cand, k, row_number() OVER (PARTITION BY threshold ORDER BY k DESC, cand DESC) AS n FROM f JOIN t ON least >= threshold) SELECT threshold, ascii(cand) AS cand, k FROM r WHERE n = 1")
def threshold_winners(spark, sf_dir):
    f = C.feasibility(candidate_labels(spark, sf_dir), 0.0).select(F.ascii("cand").alias("_code"), "least", "k")
    return C.threshold_grid(f.select((-F.col("_code")).alias("cand"), "least", "k"), "least", [0.0, 0.01, 0.1], "k", "cand").withColumn("cand", -F.col("cand"))


_SCORES = f"{_C}, sc AS (SELECT g AS cand, g % 4 + 2 AS k, g % 2 AS space, avg(bal) AS a, avg(CAST(n_orders AS double)) AS b FROM cust GROUP BY g)"


def candidate_scores(spark, sf_dir) -> DataFrame:
    """``cand, k, space, a, b``: two metrics of every candidate with its number of clusters and space."""
    g = F.col("g")
    return customers(spark, sf_dir).groupBy("g").agg(F.avg("bal").alias("a"), F.avg(F.col("n_orders").cast("double")).alias("b")).select(g.alias("cand"), (g % 4 + 2).alias("k"), (g % 2).alias("space"), "a", "b")


@query("agreement_within_k", f"{_SCORES}, p AS (SELECT x.k, sign(x.a - y.a) AS u, sign(x.b - y.b) AS v FROM sc x JOIN sc y ON x.k = y.k AND x.cand < y.cand) SELECT k, {_r('sum(u * v) / sqrt(CAST(sum(abs(u)) AS double) * sum(abs(v)))')} AS tau, count(*) AS pairs FROM p GROUP BY k")
def agreement_within_k(spark, sf_dir):
    s = candidate_scores(spark, sf_dir)
    met = s.alias("p").join(s.alias("q"), (F.col("p.k") == F.col("q.k")) & (F.col("p.cand") < F.col("q.cand")))
    u, v = [F.signum(F.col(f"p.{m}") - F.col(f"q.{m}")) for m in "ab"]
    return rounded(met.groupBy(F.col("p.k").alias("k")).agg((F.sum(u * v) / F.sqrt(F.sum(F.abs(u)) * F.sum(F.abs(v)))).alias("tau"), n_rows().alias("pairs")), "tau")


@query("metric_with_k", f"{_SCORES}, r AS (SELECT rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0e0 AS x, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0e0 AS y FROM sc) SELECT {_r('corr(x, y)')} AS rho, count(*) AS n FROM r")
def metric_with_k(spark, sf_dir):
    return rounded(stats.spearman(candidate_scores(spark, sf_dir), "k", "a"), "rho")


@query("space_ranks", f"{_SCORES}, r AS (SELECT space, (rank() OVER (PARTITION BY k ORDER BY a) + (count(*) OVER (PARTITION BY k, a) - 1) / 2.0e0) / count(*) OVER (PARTITION BY k) AS r FROM sc) SELECT space, {_r('avg(r)')} AS r, count(*) AS n FROM r GROUP BY space")
def space_ranks(spark, sf_dir):
    """Mean percentile rank of each space's candidates among those with as many clusters."""
    r = candidate_scores(spark, sf_dir).select("space", pct_rank("a", ["k"]).alias("q"))
    return rounded(r.groupBy("space").agg(F.avg("q").alias("r"), n_rows().alias("n")), "r")


@query("choice_by_k", f"{_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a DESC, cand) AS n FROM sc) SELECT k, cand, {_r('a')} AS a FROM r WHERE n = 1")
def choice_by_k(spark, sf_dir):
    return rounded(C.winners(candidate_scores(spark, sf_dir), ["k"], "a", "cand"), "a")


@query("baseline_percentile", f"{_SCORES}, o AS (SELECT max(CASE WHEN cand = 7 THEN b END) AS o FROM sc) SELECT {_r('(count(CASE WHEN b < o THEN 1 END) + 0.5e0 * count(CASE WHEN b = o THEN 1 END)) / count(b)')} AS pct FROM sc CROSS JOIN o WHERE cand <> 7")
def baseline_percentile(spark, sf_dir):
    s = candidate_scores(spark, sf_dir)
    one = F.broadcast(s.filter("cand = 7").select(F.col("b").alias("o")))
    return rounded(s.filter("cand <> 7").crossJoin(one).agg(C.baseline_percentile(F.col("o"), F.col("b")).alias("pct")), "pct")


@query("chance_corrected", f"{_SCORES}, e AS (SELECT k, cand, (rank() OVER (ORDER BY b) - 1) / 24.0e0 AS x FROM sc) SELECT cand, {_r('(x - 1.0e0 / k) / (1 - 1.0e0 / k)')} AS fair FROM e")
def chance_corrected(spark, sf_dir):
    """A metric in [0, 1] less what chance gives for that many clusters."""
    s = candidate_scores(spark, sf_dir).select("cand", "k", ((F.rank().over(Window.orderBy("b")) - 1) / 24.0).alias("x"))
    return rounded(s.select("cand", C.expected_adjusted(F.col("x"), 1.0 / F.col("k")).alias("fair")), "fair")


@query("subsample_bounds", f"{_C}, q AS (SELECT seg, count(*) AS n, avg(bal) AS v, quantile_cont(bal, 0.05) AS lo, quantile_cont(bal, 0.95) AS hi FROM cust GROUP BY seg) SELECT seg, {_r('v - (hi - v) * sqrt(10.0e0 / (n - 10))', 4)} AS low, {_r('v - (lo - v) * sqrt(10.0e0 / (n - 10))', 4)} AS high FROM q WHERE n > 10")
def subsample_bounds(spark, sf_dir):
    q = customers(spark, sf_dir).groupBy("seg").agg(n_rows().alias("n"), F.avg("bal").alias("v"), F.percentile("bal", 0.05).alias("lo"), F.percentile("bal", 0.95).alias("hi")).filter("n > 10")
    low, high = C.subsample_interval(F.col("v"), F.col("lo"), F.col("hi"), 10, F.col("n"))
    return rounded(q.select("seg", low.alias("low"), high.alias("high")), "low", "high", digits=4)


@query("weakest_verdict", f"{_C}, v AS (SELECT seg, g, CASE WHEN avg(bal) >= 4800 THEN 'strong' WHEN avg(bal) >= 4200 THEN 'weak' ELSE 'none' END AS verdict FROM cust GROUP BY seg, g) SELECT seg, CASE min(CASE verdict WHEN 'none' THEN 0 WHEN 'weak' THEN 1 ELSE 2 END) WHEN 0 THEN 'none' WHEN 1 THEN 'weak' ELSE 'strong' END AS verdict FROM v GROUP BY seg")
def weakest_verdict(spark, sf_dir):
    """The lowest verdict over a segment's nations."""
    order = F.array(*[F.lit(v) for v in ("none", "weak", "strong")])
    v = customers(spark, sf_dir).groupBy("seg", "g").agg(S.steps(F.avg("bal"), [(4800, "strong"), (4200, "weak")], "none").alias("verdict"))
    return v.groupBy("seg").agg(F.min_by("verdict", F.array_position(order, F.col("verdict"))).alias("verdict"))


# ---- graphs and tracks --------------------------------------------------------------------
@query("internal_weight_limit", f"WITH {SQL_FLOWS}, l AS (SELECT n_nationkey AS id, n_regionkey AS label FROM nation), i AS (SELECT p.label, sum(CASE WHEN p.label = q.label THEN w END) AS inside FROM strong JOIN l p ON a = p.id JOIN l q ON b = q.id GROUP BY p.label), m AS (SELECT sqrt(2 * sum(w)) AS limit_ FROM strong) SELECT d.label, coalesce(inside, 0) + 0.0 AS inside, {_r('limit_')} AS limit_, coalesce(inside, 0) < limit_ AS below FROM (SELECT DISTINCT label FROM l) d LEFT JOIN i ON d.label = i.label CROSS JOIN m")
def internal_weight_limit(spark, sf_dir):
    labels = read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("label"))
    return rounded(C.resolution_limit(strong_flows(spark, sf_dir), labels).withColumnRenamed("limit", "limit_"), "limit_")


@query("median_pair_value", f"WITH {SQL_FLOWS} SELECT {_r('median(w)')} AS med, count(*) AS n FROM flows")
def median_pair_value(spark, sf_dir):
    return rounded(flows(spark, sf_dir).agg(F.median("w").alias("med"), n_rows().alias("n")), "med")


_YEARS = f"{_M}, q AS (SELECT id, CAST(floor(t / 12.0e0) AS integer) AS win, sum(v) AS v FROM monthly GROUP BY 1, 2), l AS (SELECT id, win, CAST(ntile(3) OVER (PARTITION BY win ORDER BY v, id) - 1 AS integer) AS label FROM q)"


def year_labels(spark, sf_dir) -> DataFrame:
    q = monthly(spark, sf_dir).groupBy("id", F.floor(F.col("t") / 12.0).cast("int").alias("win")).agg(F.sum("v").alias("v"))
    return q.select("id", "win", (F.ntile(3).over(Window.partitionBy("win").orderBy("v", "id")) - 1).alias("label"))


@query("transition_codes", f"{_YEARS} SELECT a.win, a.label * 3 + b.label AS code, count(*) AS n FROM l a JOIN l b ON a.id = b.id AND b.win = a.win + 1 GROUP BY 1, 2")
def transition_codes(spark, sf_dir):
    l = year_labels(spark, sf_dir)  # noqa: E741
    after = l.select("id", (F.col("win") - 1).alias("win"), F.col("label").alias("then"))
    return l.join(after, ["id", "win"]).groupBy("win", (F.col("label") * 3 + F.col("then")).alias("code")).agg(n_rows().alias("n"))


@query("window_sizes", f"{_YEARS} SELECT win, count(CASE WHEN label = 0 THEN 1 END) AS s0, count(CASE WHEN label = 1 THEN 1 END) AS s1, count(CASE WHEN label = 2 THEN 1 END) AS s2 FROM l GROUP BY win")
def window_sizes(spark, sf_dir):
    return year_labels(spark, sf_dir).groupBy("win").agg(*[F.count_if(F.col("label") == k).alias(f"s{k}") for k in range(3)])


@query("rank_of_ranks", f"{_SCORES}, r AS (SELECT cand, rank() OVER (ORDER BY a DESC) AS x, rank() OVER (ORDER BY b DESC) AS y FROM sc) SELECT cand, {_r('(x + y) / 2.0e0')} AS r, least(x, y) AS best FROM r")
def rank_of_ranks(spark, sf_dir):
    s = candidate_scores(spark, sf_dir).select("cand", *[F.rank().over(Window.orderBy(F.desc(m))).alias(f"r{m}") for m in "ab"])
    return rounded(s.select("cand", ((F.col("ra") + F.col("rb")) / 2).alias("r"), F.least("ra", "rb").alias("best")), "r")
