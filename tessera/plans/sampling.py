"""Queries on permutations, bootstraps and multiplicity, reproducible in any engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import resample as B
from tessera.operators import selection as C
from tessera.operators import stats as S

from .base import query
from .inputs import MONTHS, SQL_CUSTOMERS, SQL_MONTHLY, customers, monthly, read
from .panels import _r, rounded

REPS = 20
_C = f"WITH {SQL_CUSTOMERS}"
_PERM = f"""{_C}, reps AS (SELECT unnest(range({REPS})) AS rep), x AS (SELECT rep, g, id, n_orders FROM cust CROSS JOIN reps),
seat AS (SELECT rep, g, id, row_number() OVER (PARTITION BY rep, g ORDER BY id) AS n FROM x),
card AS (SELECT rep, g, n_orders, row_number() OVER (PARTITION BY rep, g ORDER BY md5(concat_ws('-', CAST(id AS varchar), CAST(rep AS varchar), 'p')), id) AS n FROM x),
perm AS (SELECT CAST(seat.rep AS integer) AS rep, seat.g, seat.id, card.n_orders FROM seat JOIN card ON seat.rep = card.rep AND seat.g = card.g AND seat.n = card.n)"""


def _permuted(spark, sf_dir, *keep):
    return B.permute_within(customers(spark, sf_dir), "n_orders", "id", ["g"], REPS, "p", keep)


@query("permute_within", f"{_PERM} SELECT rep, g, id, n_orders FROM perm")
def permute_within(spark, sf_dir):
    return _permuted(spark, sf_dir).select("rep", "g", "id", "n_orders")


_NULL = _PERM + ", stat AS (SELECT rep, avg(CASE WHEN bal > 5000 THEN p.n_orders END) - avg(CASE WHEN bal <= 5000 THEN p.n_orders END) AS d FROM perm p JOIN cust USING (id) GROUP BY rep), obs AS (SELECT avg(CASE WHEN bal > 5000 THEN n_orders END) - avg(CASE WHEN bal <= 5000 THEN n_orders END) AS o FROM cust)"


def _high():
    return F.avg(F.when(F.col("bal") > 5000, F.col("n_orders"))) - F.avg(F.when(F.col("bal") <= 5000, F.col("n_orders")))


def _null(spark, sf_dir):
    return _permuted(spark, sf_dir, "bal").filter("id is not null").groupBy("rep").agg(_high().alias("d"))


@query("null_distribution", f"{_NULL} SELECT rep, {_r('d')} AS d FROM stat")
def null_distribution(spark, sf_dir):
    return rounded(_null(spark, sf_dir), "d")


@query("empirical_p", f"{_NULL} SELECT {_r('(1 + count(*) FILTER (WHERE round(d, 9) >= round(o, 9))) / CAST(1 + count(*) AS double)')} AS p_greater, {_r('(1 + count(*) FILTER (WHERE abs(round(d, 9)) >= abs(round(o, 9)))) / CAST(1 + count(*) AS double)')} AS p_two_sided FROM stat, obs")
def empirical_p(spark, sf_dir):
    o = customers(spark, sf_dir).agg(F.round(_high(), 9).alias("o"))
    n = _null(spark, sf_dir).withColumn("d", F.round("d", 9)).crossJoin(F.broadcast(o)).withColumn("ad", F.abs("d"))
    return rounded(n.agg(S.permutation_p(F.col("o"), "d").alias("p_greater"), S.permutation_p(F.abs("o"), "ad").alias("p_two_sided")), "p_greater", "p_two_sided")


_BOOT = f"""{_C}, lst AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i FROM (SELECT DISTINCT g FROM cust)), m AS (SELECT count(*) AS m FROM lst),
draws AS (SELECT rep, CAST('0x' || substr(md5(concat_ws('-', CAST(i AS varchar), CAST(rep AS varchar), 'b')), 1, 8) AS bigint) % m AS i FROM lst, m, (SELECT unnest(range({REPS})) AS rep)),
tm AS (SELECT rep, i, count(*) AS times FROM draws GROUP BY 1, 2), boot AS (SELECT CAST(rep AS integer) AS rep, g, times FROM tm JOIN lst USING (i)),
sums AS (SELECT g, sum(bal) AS s, count(bal) AS c FROM cust GROUP BY g), bm AS (SELECT rep, sum(times * s) / sum(times * c) AS mean FROM boot JOIN sums USING (g) GROUP BY rep)"""


@query("bootstrap_groups", f"{_BOOT} SELECT rep, g, times FROM boot")
def bootstrap_groups(spark, sf_dir):
    return B.bootstrap_groups(customers(spark, sf_dir), "g", REPS, "b")


@query("bootstrap_mean", f"{_BOOT} SELECT rep, {_r('mean')} AS mean FROM bm")
def bootstrap_mean(spark, sf_dir):
    return rounded(B.bootstrap_mean(customers(spark, sf_dir), "g", "bal", REPS, "b"), "mean")


@query("cluster_bootstrap_ci", f"{_BOOT} SELECT {_r('quantile_cont(mean, 0.025)')} AS low, {_r('quantile_cont(mean, 0.975)')} AS high FROM bm")
def cluster_bootstrap_ci(spark, sf_dir):
    return rounded(B.percentile_interval(B.bootstrap_mean(customers(spark, sf_dir), "g", "bal", REPS, "b"), "mean"), "low", "high")


@query("verdict", f"{_BOOT}, ci AS (SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM bm) SELECT CASE WHEN low > 0 AND 0.01 <= 0.05 THEN 'confirmed' WHEN high < 0 THEN 'rejected' ELSE 'open' END AS verdict FROM ci")
def verdict(spark, sf_dir):
    ci = B.percentile_interval(B.bootstrap_mean(customers(spark, sf_dir), "g", "bal", REPS, "b"), "mean").withColumn("p", F.lit(0.01))
    return ci.select(C.verdict("low", "high", "p").alias("verdict"))


@query("subsample", f"{_C} SELECT id, g FROM cust WHERE CAST('0x' || substr(md5(concat_ws('-', CAST(id AS varchar), '0', 's')), 1, 8) AS bigint) / 4294967296.0e0 < 0.8e0")
def subsample(spark, sf_dir):
    return B.subsample(customers(spark, sf_dir).select("id", "g"), "id", 0.8, salt="s")


_SHIFTS = B.allowed_shifts(MONTHS, reach=2, guard=2)


@query("circular_shift_null", f"""WITH {SQL_MONTHLY}, s AS (SELECT unnest({_SHIFTS}) AS shift), z AS (SELECT id, shift, (t + shift) % {MONTHS} AS t, y FROM monthly, s)
    SELECT CAST(shift AS integer) AS shift, {_r("avg(r)")} AS mean_r, count(*) AS n FROM (SELECT shift, a.id AS a, z.id AS b, corr(a.y, z.y) AS r FROM monthly a JOIN z ON a.t = z.t AND a.id < z.id GROUP BY ALL HAVING count(*) >= 3) GROUP BY shift""")
def circular_shift_null(spark, sf_dir):
    m = monthly(spark, sf_dir).select("id", "t", "y")
    z = m.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in _SHIFTS])))
    z = z.select(F.col("id").alias("b"), "shift", F.pmod(F.col("t") + F.col("shift"), F.lit(MONTHS)).alias("t"), F.col("y").alias("y2"))
    r = m.select(F.col("id").alias("a"), "t", "y").join(z, "t").filter("a < b").groupBy("shift", "a", "b").agg(F.corr("y", "y2").alias("r"), F.count(F.lit(1)).alias("k")).filter("k >= 3")
    return rounded(r.groupBy("shift").agg(F.avg("r").alias("mean_r"), F.count(F.lit(1)).alias("n")), "mean_r")


@query("share_difference", f"""{_C}, s AS (SELECT g, avg(CASE WHEN bal > 5000 THEN 1.0 ELSE 0.0 END) AS share FROM cust GROUP BY g) SELECT {_r("avg(CASE WHEN g % 2 = 0 THEN share END) - avg(CASE WHEN g % 2 = 1 THEN share END)")} AS diff FROM s""")
def share_difference(spark, sf_dir):
    s = customers(spark, sf_dir).groupBy("g").agg(F.avg((F.col("bal") > 5000).cast("double")).alias("share"))
    even = F.avg(F.when(F.col("g") % 2 == 0, F.col("share"))) - F.avg(F.when(F.col("g") % 2 == 1, F.col("share")))
    return rounded(s.agg(even.alias("diff")), "diff")


@query("label_quality", "SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def label_quality(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
