"""Panel queries: quality, windows, levels, compositions and rhythm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import compositions as comp
from tessera.functions.ranks import group_mean, group_median, relative
from tessera.functions.scalars import shown_pct
from tessera.operators import panel as P
from tessera.operators import stats

from .base import query
from .inputs import CATEGORIES, HALF, MONTHS, PARTS, SQL_MONTHLY, SQL_ORDERS, SQL_PANEL, SQL_WIDE, monthly, orders_by_nation, panel, read


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded doubles, without negative zero."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation x month with a column per priority, in one aggregation of the orders."""
    rows = orders_by_nation(spark, sf_dir).withColumnRenamed("price", "v")
    sums = P.to_wide(rows, CATEGORIES, PARTS, ["id", "g", "t"])
    return sums.withColumns({p: F.round(p, 2) for p in PARTS})


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).dropna(subset=PARTS)


_LIST = ", ".join(PARTS)
_SUM = "(" + " + ".join(PARTS) + ")"
_SHARES = SQL_WIDE + ",\nshares AS (SELECT id, g, t, " + ", ".join(f"{p} / {_SUM} AS {p}" for p in PARTS) + " FROM full_)"
_MEANLOG = "(" + " + ".join(f"ln({p})" for p in PARTS) + ") / 5"
_CLR = _SHARES + ",\nclr AS (SELECT id, g, t, " + ", ".join(f"ln({p}) - {_MEANLOG} AS {p}" for p in PARTS) + " FROM shares)"


def _r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = complete(spark, sf_dir)
    return c.select("id", "g", "t", *[x.alias(p) for p, x in comp.closure(PARTS).items()])


def clr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(spark, sf_dir).select("id", "g", "t", *[x.alias(p) for p, x in comp.clr(PARTS).items()])


@query("panel_clr_relative", f"WITH {_CLR} SELECT id, t, " + ", ".join(f"{_r(f'{p} - avg({p}) OVER (PARTITION BY g, t)')} AS {p}" for p in PARTS) + " FROM clr")
def panel_clr_relative(spark, sf_dir):
    return rounded(comp.relative_clr(clr(spark, sf_dir), PARTS, ["g", "t"]), *PARTS).select("id", "t", *PARTS)


_MED = _CLR + ",\nmed AS (SELECT id, t, " + ", ".join(f"{p} - median({p}) OVER (PARTITION BY g, t) AS {p}" for p in PARTS) + " FROM clr)"


@query("panel_clr_relative_median", f"WITH {_MED} SELECT id, t, " + ", ".join(f"{_r(f'{p} - {_SUM} / 5')} AS {p}" for p in PARTS) + " FROM med")
def panel_clr_relative_median(spark, sf_dir):
    return rounded(comp.relative_clr(clr(spark, sf_dir), PARTS, ["g", "t"], "median"), *PARTS).select("id", "t", *PARTS)


@query("panel_wide", f"WITH {SQL_WIDE} SELECT id, g, t, {', '.join(_r(p, 2) + ' AS ' + p for p in PARTS)} FROM wide")
def panel_wide(spark, sf_dir):
    return rounded(wide(spark, sf_dir), *PARTS, digits=2)


@query("panel_long", f"WITH {SQL_PANEL} SELECT id, t, CASE cat " + " ".join(f"WHEN '{c}' THEN '{p}'" for c, p in zip(CATEGORIES, PARTS, strict=True)) + " END AS cat, v FROM panel")
def panel_long(spark, sf_dir):
    return P.to_long(wide(spark, sf_dir).select("id", "t", *PARTS), PARTS)


@query("closure_shares", f"WITH {_SHARES} SELECT id, t, {', '.join(_r(p) + ' AS ' + p for p in PARTS)} FROM shares")
def closure_shares(spark, sf_dir):
    return rounded(shares(spark, sf_dir), *PARTS).select("id", "t", *PARTS)


@query("clr_parts", f"WITH {_CLR} SELECT id, t, {', '.join(_r(p) + ' AS ' + p for p in PARTS)} FROM clr")
def clr_parts(spark, sf_dir):
    return rounded(clr(spark, sf_dir), *PARTS).select("id", "t", *PARTS)


_K = " + ".join(f"CASE WHEN {p} < 0.1 THEN 1.0 ELSE 0.0 END" for p in PARTS)
_REST = " + ".join(f"CASE WHEN {p} < 0.1 THEN 0.0 ELSE {p} END" for p in PARTS)


@query(
    "replace_small_shares",
    f"WITH {_SHARES} SELECT id, t, "
    + ", ".join(_r(f"CASE WHEN {p} < 0.1 THEN 0.1 ELSE {p} * ((1 - ({_K}) * CAST(0.1 AS double)) / ({_REST})) END") + f" AS {p}" for p in PARTS)
    + " FROM shares",
)
def replace_small_shares(spark, sf_dir):
    s = shares(spark, sf_dir)
    return rounded(s.select("id", "t", *[x.alias(p) for p, x in comp.replace_small(PARTS, 0.1).items()]), *PARTS)


@query(
    "residual_category",
    f"""WITH {SQL_PANEL}, w AS (SELECT id, t, sum(v) AS whole FROM panel GROUP BY id, t),
    rest AS (SELECT id, t, 'other' AS cat, round(w.whole - coalesce(sum(p.v), 0), 2) AS v, true AS is_derived
      FROM w LEFT JOIN (SELECT * FROM panel WHERE cat IN ('1-URGENT', '2-HIGH')) p USING (id, t) GROUP BY id, t, w.whole)
    SELECT id, t, cat, round(v, 2) AS v, false AS is_derived FROM panel WHERE cat IN ('1-URGENT', '2-HIGH')
    UNION ALL SELECT id, t, 'whole', round(whole, 2), false FROM w
    UNION ALL SELECT * FROM rest WHERE v > 0""",
)
def residual_category(spark, sf_dir):
    p = panel(spark, sf_dir).select("id", "t", "cat", "v")
    whole = p.groupBy("id", "t").agg(F.sum("v").alias("v")).select("id", "t", F.lit("whole").alias("cat"), "v")
    some = p.filter(F.col("cat").isin("1-URGENT", "2-HIGH"))
    return rounded(P.add_residual(some.unionByName(whole), "whole"), "v", digits=2).filter("v > 0")


_YEARS = ", ".join(f"count(*) FILTER (WHERE t >= {12 * y} AND t < {12 * y + 12}) AS y{y}" for y in range(MONTHS // 12))
_STATUS = f"CASE WHEN n_months = {MONTHS} THEN 'full' " + " ".join(f"WHEN y{y} = 12 AND n_months = 12 THEN 'only_{y}'" for y in range(MONTHS // 12)) + " ELSE 'partial' END"
_QUALITY = f"""WITH {SQL_PANEL}, m AS (SELECT DISTINCT id, t FROM panel WHERE cat = '1-URGENT'),
    gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY id ORDER BY t) - 1 AS gap FROM m),
    q AS (SELECT id, count(*) AS n_months, min(t) AS first_t, max(t) AS last_t, CAST(coalesce(max(gap), 0) AS integer) AS longest_gap,
          list(t) AS seen, {_YEARS} FROM gaps GROUP BY id)"""


def _quality(spark, sf_dir):
    return P.series_quality(panel(spark, sf_dir).filter("cat = '1-URGENT'"), MONTHS)


@query(
    "series_quality",
    f"""{_QUALITY} SELECT id, n_months, first_t, last_t, longest_gap,
    array_to_string(list_transform(range({MONTHS}), lambda i: CASE WHEN list_contains(seen, CAST(i AS integer)) THEN '1' ELSE '0' END), '') AS coverage,
    {_STATUS} AS status
    FROM q""",
)
def series_quality(spark, sf_dir):
    return _quality(spark, sf_dir)


@query("series_summary", f"""{_QUALITY} SELECT {_STATUS} AS status, count(*) AS n FROM q GROUP BY 1""")
def series_summary(spark, sf_dir):
    return _quality(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("month_coverage", f"WITH {SQL_PANEL} SELECT t, count(DISTINCT id) AS n_ids FROM panel WHERE cat = '1-URGENT' GROUP BY t")
def month_coverage(spark, sf_dir):
    return P.months_coverage(panel(spark, sf_dir).filter("cat = '1-URGENT'"))


@query(
    "month_ladder",
    f"""{_QUALITY}, w AS (SELECT id, sum(v) AS w FROM panel GROUP BY id), r AS (SELECT q.id, n_months, coalesce(w, 0.0) AS w FROM q LEFT JOIN w USING (id))
    SELECT CAST(k AS integer) AS k, count(*) FILTER (WHERE n_months >= k) AS n_ids,
    {_r("sum(CASE WHEN n_months >= k THEN w ELSE 0.0 END) / sum(w)")} AS w_share FROM r, (SELECT unnest([6, 12, 24, 48, 80]) AS k) GROUP BY k""",
)
def month_ladder(spark, sf_dir):
    weights = panel(spark, sf_dir).groupBy("id").agg(F.sum("v").alias("w"))
    return rounded(P.month_ladder(_quality(spark, sf_dir), weights, [6, 12, 24, 48, 80]), "w_share")


def _window_sql(cases: str) -> str:
    return f"""WITH {SQL_PANEL}, win AS (SELECT * FROM (VALUES {cases}) AS x(win, s, n))
    SELECT id, cat, win, round(sum(v), 2) AS v, max(n) AS n_months FROM panel JOIN win ON t >= s AND t < s + n
    GROUP BY id, cat, win HAVING count(DISTINCT t) = max(n)"""


def _cases(windows) -> str:
    return ", ".join(f"('{name}', {s}, {n})" for name, s, n in windows)


for _kind in ("year", "half", "quarter"):

    @query(f"window_sums_{_kind}", _window_sql(_cases(P.calendar_windows(MONTHS, [_kind]))).replace("max(n) AS n_months", "CAST(max(n) AS bigint) AS n_months"))
    def window_sums(spark, sf_dir, kind=_kind):
        return rounded(P.window_sums(panel(spark, sf_dir), P.calendar_windows(MONTHS, [kind])), "v", digits=2)


@query("rolling12_sums", _window_sql(_cases(P.rolling_windows(MONTHS))).replace("max(n) AS n_months", "CAST(max(n) AS bigint) AS n_months"))
def rolling12_sums(spark, sf_dir):
    return rounded(P.window_sums(panel(spark, sf_dir), P.rolling_windows(MONTHS)), "v", digits=2)


@query("level_relative", f"""WITH {SQL_PANEL}, m AS (SELECT *, median(v) OVER (PARTITION BY cat, t) AS m FROM panel)
    SELECT id, cat, {_r("exp(avg(ln(v / m)))")} AS level, count(*) AS n_months FROM m GROUP BY id, cat HAVING count(*) >= 12""")
def level_relative(spark, sf_dir):
    return rounded(P.level_relative(panel(spark, sf_dir), 12), "level")


@query("yoy_share_pp", f"""WITH {_SHARES} SELECT a.id, a.t, {_r("100 * (a.p1 - b.p1)")} AS diff FROM shares a JOIN shares b ON a.id = b.id AND a.t = b.t + 12""")
def yoy_share_pp(spark, sf_dir):
    s = shares(spark, sf_dir).select("id", "t", (100 * F.col("p1")).alias("share"))
    return rounded(P.yoy(s, "share", ["id"]), "diff")


@query(
    "national_quantiles",
    f"""WITH {SQL_PANEL} SELECT t, cat, count(*) AS n, {_r("median(v)", 6)} AS med, {_r("quantile_cont(v, 0.25)", 6)} AS q25, {_r("quantile_cont(v, 0.75)", 6)} AS q75
    FROM panel GROUP BY t, cat""",
)
def national_quantiles(spark, sf_dir):
    agg = panel(spark, sf_dir).groupBy("t", "cat").agg(
        F.count(F.lit(1)).alias("n"), F.median("v").alias("med"), F.percentile("v", 0.25).alias("q25"), F.percentile("v", 0.75).alias("q75")
    )
    return rounded(agg, "med", "q25", "q75", digits=6)


@query("weighted_share", f"""WITH {_SHARES}, w AS (SELECT id, sum(v) AS w FROM panel GROUP BY id)
    SELECT t, {_r("sum(p1 * w) / sum(w)")} AS wmean FROM shares JOIN w USING (id) GROUP BY t""")
def weighted_share(spark, sf_dir):
    w = panel(spark, sf_dir).groupBy("id").agg(F.sum("v").alias("w"))
    return rounded(stats.weighted_mean(shares(spark, sf_dir).join(w, "id"), "p1", "w", ["t"]), "wmean")


_DETREND = SQL_MONTHLY + """,
fit AS (SELECT id, regr_slope(y, t) AS b, avg(y) AS my, avg(t) AS mt FROM monthly GROUP BY id),
res AS (SELECT m.id, m.g, m.t, y - my - coalesce(b, 0.0) * (t - mt) AS resid FROM monthly m JOIN fit USING (id)),
own AS (SELECT *, resid - median(resid) OVER (PARTITION BY t) AS o FROM res)"""


def _own(spark, sf_dir):
    rows = P.detrend(monthly(spark, sf_dir))
    return rows.withColumn("o", relative("resid", ["t"]))


@query("detrend_residuals", f"WITH {_DETREND} SELECT id, t, {_r('resid')} AS resid FROM res")
def detrend_residuals(spark, sf_dir):
    return rounded(P.detrend(monthly(spark, sf_dir)).select("id", "t", "resid"), "resid")


@query("own_rhythm", f"WITH {_DETREND} SELECT id, t, {_r('o')} AS o FROM own")
def own_rhythm(spark, sf_dir):
    return rounded(_own(spark, sf_dir).select("id", "t", "o"), "o")


@query("profile_amplitude", f"""WITH {_DETREND}, prof AS (SELECT id, t % 12 AS m, avg(o) AS p FROM own GROUP BY 1, 2)
    SELECT id, {_r("max(p) - min(p)")} AS amplitude, {_r("avg(CASE WHEN m IN (5, 6, 7) THEN p END) - avg(CASE WHEN m NOT IN (5, 6, 7, 11) THEN p END)")} AS summer,
    count(*) AS n FROM prof GROUP BY id""")
def profile_amplitude(spark, sf_dir):
    prof = _own(spark, sf_dir).groupBy("id", (F.col("t") % 12).alias("m")).agg(F.avg("o").alias("p"))
    summer = F.avg(F.when(F.col("m").isin(5, 6, 7), F.col("p"))) - F.avg(F.when(~F.col("m").isin(5, 6, 7, 11), F.col("p")))
    return rounded(prof.groupBy("id").agg((F.max("p") - F.min("p")).alias("amplitude"), summer.alias("summer"), F.count(F.lit(1)).alias("n")), "amplitude", "summer")


@query("rhythm_reproducibility", f"""WITH {_DETREND} SELECT a.id, {_r("corr(a.o, b.o)")} AS r, count(*) AS n FROM own a JOIN own b ON a.id = b.id AND b.t = a.t + 12
    GROUP BY a.id HAVING count(*) >= 6""")
def rhythm_reproducibility(spark, sf_dir):
    rows = _own(spark, sf_dir).select("id", "t", "o")
    later = rows.select("id", (F.col("t") - 12).alias("t"), F.col("o").alias("o2"))
    agg = rows.join(later, ["id", "t"]).groupBy("id").agg(F.corr("o", "o2").alias("r"), F.count(F.lit(1)).alias("n"))
    return rounded(agg.filter("n >= 6"), "r")


@query("common_share", f"WITH {_DETREND} SELECT {_r('1 - sum(o * o) / sum(resid * resid)')} AS common_share, count(*) AS n FROM own")
def common_share(spark, sf_dir):
    return rounded(_own(spark, sf_dir).agg((1 - F.sum(F.col("o") * F.col("o")) / F.sum(F.col("resid") * F.col("resid"))).alias("common_share"), F.count(F.lit(1)).alias("n")), "common_share")


@query("seasonal_excess", f"""WITH {_DETREND}, y AS (SELECT id, t // 12 AS yr, avg(CASE WHEN t % 12 IN (5, 6, 7) THEN resid END) - avg(CASE WHEN t % 12 NOT IN (5, 6, 7, 11) THEN resid END) AS d
    FROM res GROUP BY 1, 2) SELECT id, {_r("exp(avg(d)) - 1")} AS excess FROM y GROUP BY id""")
def seasonal_excess(spark, sf_dir):
    month = F.col("t") % 12
    by_year = P.detrend(monthly(spark, sf_dir)).groupBy("id", F.floor(F.col("t") / 12).alias("yr")).agg(
        (F.avg(F.when(month.isin(5, 6, 7), F.col("resid"))) - F.avg(F.when(~month.isin(5, 6, 7, 11), F.col("resid")))).alias("d")
    )
    return rounded(by_year.groupBy("id").agg(F.expm1(F.avg("d")).alias("excess")), "excess")


@query("peak_month", f"""WITH {SQL_MONTHLY} SELECT id, yr, t AS peak_t FROM (SELECT id, t // 12 AS yr, t, row_number() OVER (PARTITION BY id, t // 12 ORDER BY v DESC, t) AS n FROM monthly) WHERE n = 1""")
def peak_month(spark, sf_dir):
    rows = monthly(spark, sf_dir).withColumn("yr", F.floor(F.col("t") / 12).cast("int"))
    w = Window.partitionBy("id", "yr").orderBy(F.desc("v"), "t")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("id", "yr", F.col("t").alias("peak_t"))


@query("month_ratio_profile", f"""WITH {SQL_MONTHLY}, r AS (SELECT t % 12 AS m, v / avg(v) OVER (PARTITION BY id, t // 12) AS ratio FROM monthly)
    SELECT m, {_r("median(ratio)")} AS med, {_r("quantile_cont(ratio, 0.75) - quantile_cont(ratio, 0.25)")} AS iqr, count(*) AS n FROM r GROUP BY m""")
def month_ratio_profile(spark, sf_dir):
    rows = monthly(spark, sf_dir).withColumn("yr", F.floor(F.col("t") / 12))
    rows = rows.select((F.col("t") % 12).alias("m"), (F.col("v") / group_mean("v", ["id", "yr"])).alias("ratio"))
    agg = rows.groupBy("m").agg(F.median("ratio").alias("med"), (F.percentile("ratio", 0.75) - F.percentile("ratio", 0.25)).alias("iqr"), F.count(F.lit(1)).alias("n"))
    return rounded(agg, "med", "iqr")


@query("annual_growth_median", f"""WITH {SQL_MONTHLY}, a AS (SELECT id, sum(CASE WHEN t < {HALF} THEN v END) AS a0, sum(CASE WHEN t >= {HALF} THEN v END) AS a1 FROM monthly GROUP BY id)
    SELECT {_r("median(a1 / a0 - 1)")} AS growth, count(*) AS n FROM a WHERE a0 > 0 AND a1 IS NOT NULL""")
def annual_growth_median(spark, sf_dir):
    a = monthly(spark, sf_dir).groupBy("id").agg(F.sum(F.when(F.col("t") < HALF, F.col("v"))).alias("a0"), F.sum(F.when(F.col("t") >= HALF, F.col("v"))).alias("a1"))
    return rounded(a.filter("a0 > 0 and a1 is not null").agg(F.median(F.col("a1") / F.col("a0") - 1).alias("growth"), F.count(F.lit(1)).alias("n")), "growth")


@query("yoy_by_month", f"""WITH {SQL_MONTHLY} SELECT a.t % 12 AS m, {_r("median(b.v / a.v - 1)")} AS growth, count(*) AS n FROM monthly a JOIN monthly b ON a.id = b.id AND b.t = a.t + 12 GROUP BY 1""")
def yoy_by_month(spark, sf_dir):
    a = monthly(spark, sf_dir).select("id", "t", "v")
    b = a.select("id", (F.col("t") - 12).alias("t"), F.col("v").alias("v2"))
    agg = a.join(b, ["id", "t"]).groupBy((F.col("t") % 12).alias("m")).agg(F.median(F.col("v2") / F.col("v") - 1).alias("growth"), F.count(F.lit(1)).alias("n"))
    return rounded(agg, "growth")


@query("half_year_growth", f"""WITH {SQL_PANEL}, h AS (SELECT id, cat, sum(CASE WHEN t BETWEEN 0 AND 5 THEN v END) AS h1, sum(CASE WHEN t BETWEEN 12 AND 17 THEN v END) AS h2 FROM panel GROUP BY id, cat)
    SELECT cat, {_r("median(h2 / h1 - 1)")} AS growth, count(*) AS n FROM h WHERE h1 > 0 AND h2 > 0 GROUP BY cat""")
def half_year_growth(spark, sf_dir):
    h = panel(spark, sf_dir).groupBy("id", "cat").agg(
        F.sum(F.when(F.col("t").between(0, 5), F.col("v"))).alias("h1"), F.sum(F.when(F.col("t").between(12, 17), F.col("v"))).alias("h2")
    )
    return rounded(h.filter("h1 > 0 and h2 > 0").groupBy("cat").agg(F.median(F.col("h2") / F.col("h1") - 1).alias("growth"), F.count(F.lit(1)).alias("n")), "growth")


@query("chain_index", f"""WITH {SQL_ORDERS}, m AS (SELECT t, avg(price) AS p FROM ord GROUP BY t), r AS (SELECT t, coalesce(p / lag(p) OVER (ORDER BY t), 1.0) AS ratio FROM m)
    SELECT t, {_r("exp(sum(ln(ratio)) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING))")} AS idx FROM r""")
def chain_index(spark, sf_dir):
    m = orders_by_nation(spark, sf_dir).groupBy("t").agg(F.avg("price").alias("p"))
    r = m.withColumn("ratio", F.coalesce(F.col("p") / F.lag("p").over(Window.partitionBy().orderBy("t")), F.lit(1.0)))
    return rounded(r.select("t", P.chain_index(r, "ratio", [], "t").alias("idx")), "idx")


@query("panel_cube", f"""WITH {SQL_PANEL} SELECT g, cat, CAST(grouping(g, cat) AS bigint) AS level, round(sum(v), 2) AS v, count(*) AS n FROM panel GROUP BY CUBE (g, cat)""")
def panel_cube(spark, sf_dir):
    agg = panel(spark, sf_dir).cube("g", "cat").agg(F.grouping_id().cast("long").alias("level"), F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return rounded(agg, "v", digits=2)


@query("panel_pivot", f"""WITH {SQL_PANEL} SELECT g, {', '.join(f"round(sum(CASE WHEN cat = '{c}' THEN v END), 2) AS {p}" for c, p in zip(CATEGORIES, PARTS, strict=True))} FROM panel GROUP BY g""")
def panel_pivot(spark, sf_dir):
    agg = panel(spark, sf_dir).groupBy("g").pivot("cat", CATEGORIES).agg(F.sum("v"))
    return rounded(agg.toDF("g", *PARTS), *PARTS, digits=2)


@query("share_spread", f"WITH {_CLR} SELECT " + ", ".join(f"{_r(f'var_samp({p})')} AS {p}" for p in PARTS) + ", count(*) AS n FROM clr")
def share_spread(spark, sf_dir):
    return rounded(clr(spark, sf_dir).agg(*[F.var_samp(p).alias(p) for p in PARTS], F.count(F.lit(1)).alias("n")), *PARTS)


@query("pooled_share", f"""WITH {SQL_PANEL} SELECT t, cat, {_r("100 * sum(v) / sum(sum(v)) OVER (PARTITION BY t)", 1)} AS pct FROM panel GROUP BY t, cat""")
def pooled_share(spark, sf_dir):
    agg = panel(spark, sf_dir).groupBy("t", "cat").agg(F.sum("v").alias("s"))
    return agg.select("t", "cat", shown_pct(F.col("s") / F.sum("s").over(Window.partitionBy("t"))).alias("pct"))


@query("events_daily", """SELECT event_type, CAST(ts AS date) AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS value FROM events GROUP BY 1, 2""")
def events_daily(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_type", "ts", "user_id", "value")
    return e.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("value")
    )


@query("level_summary", f"""WITH {SQL_MONTHLY} SELECT g, {_r("median(v)", 6)} AS med, {_r("avg(v)", 6)} AS mean, {_r("quantile_cont(v, 0.1)", 6)} AS p10, {_r("quantile_cont(v, 0.9)", 6)} AS p90, count(*) AS n FROM monthly GROUP BY g""")
def level_summary(spark, sf_dir):
    agg = monthly(spark, sf_dir).groupBy("g").agg(F.median("v").alias("med"), F.avg("v").alias("mean"), F.percentile("v", 0.1).alias("p10"), F.percentile("v", 0.9).alias("p90"), F.count(F.lit(1)).alias("n"))
    return rounded(agg, "med", "mean", "p10", "p90", digits=6)


@query("rel_level_median", f"WITH {SQL_MONTHLY} SELECT id, t, {_r('y - median(y) OVER (PARTITION BY g, t)')} AS rel FROM monthly")
def rel_level_median(spark, sf_dir):
    m = monthly(spark, sf_dir)
    return rounded(m.select("id", "t", (F.col("y") - group_median("y", ["g", "t"])).alias("rel")), "rel")
