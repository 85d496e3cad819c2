"""Queries on versioned dimensions, matching, context facts, codes and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import code_prefix, has_flag, join_flags, log1p_abs, map_or_fail, normalize_code, real_growth, safe_log, transform_value, version_distance
from tessera.operators import resolve as R

from .base import query
from .inputs import SQL_CUSTOMERS, SQL_PANEL, customers, panel, read
from .panels import _r, rounded

#: Made versions of suppliers: code changes at a year that depends on the key; every fifth pair shares a stable code.
_VERSIONS = """versions AS (
  SELECT s_suppkey AS id, printf('%02d-%06d', s_nationkey, s_suppkey) AS code, 'S' || (s_suppkey - s_suppkey % 5 % 2) AS stable, 1990 AS year_from, CAST(1994 + s_suppkey % 4 AS integer) AS year_to FROM supplier
  UNION ALL SELECT s_suppkey, printf('%02d-%06d', s_nationkey, s_suppkey + 500000), 'S' || (s_suppkey - s_suppkey % 5 % 2), CAST(1994 + s_suppkey % 4 AS integer), 9999 FROM supplier WHERE s_suppkey % 13 <> 0)"""
#: Made rows: the code current in 1996 for most; the old code, a foreign code with the stable one, or nothing for others.
_ROWS = """src AS (
  SELECT printf('%02d-%06d', s_nationkey, s_suppkey + CASE WHEN s_suppkey % 7 IN (0, 1) THEN 0 WHEN s_suppkey % 7 = 2 THEN 900000 ELSE 500000 END) AS code,
         'S' || (s_suppkey - s_suppkey % 5 % 2) AS stable, CAST(y AS integer) AS year, s_acctbal AS value
  FROM supplier, (SELECT unnest([1995, 1996, 1997]) AS y) WHERE s_suppkey % 7 <> 3)"""
_V = f"WITH {_VERSIONS}, {_ROWS}, yrs AS (SELECT CAST(unnest([1995, 1996, 1997]) AS integer) AS year), here AS (SELECT id, year, code AS own, stable FROM versions JOIN yrs ON year_from <= year AND year_to > year)"
YEARS = [1995, 1996, 1997]


def _versions(spark, sf_dir):
    s = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").withColumn("stable", F.expr("concat('S', s_suppkey - s_suppkey % 5 % 2)"))
    change = F.expr("cast(1994 + s_suppkey % 4 as int)")
    old = s.select(F.col("s_suppkey").alias("id"), F.format_string("%02d-%06d", "s_nationkey", "s_suppkey").alias("code"), "stable", F.lit(1990).alias("year_from"), change.alias("year_to"))
    new = s.filter("s_suppkey % 13 <> 0").select(
        F.col("s_suppkey").alias("id"), F.format_string("%02d-%06d", F.col("s_nationkey"), F.col("s_suppkey") + 500000).alias("code"), "stable", change.alias("year_from"), F.lit(R.OPEN_YEAR).alias("year_to")
    )
    return old.unionByName(new)


def _rows(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").filter("s_suppkey % 7 <> 3").withColumn("year", F.explode(F.array(*[F.lit(y) for y in YEARS])))
    moved = F.expr("s_suppkey + case when s_suppkey % 7 in (0, 1) then 0 when s_suppkey % 7 = 2 then 900000 else 500000 end")
    return s.select(F.format_string("%02d-%06d", F.col("s_nationkey"), moved).alias("code"), F.expr("concat('S', s_suppkey - s_suppkey % 5 % 2)").alias("stable"), "year", F.col("s_acctbal").alias("value"))


@query("interval_slice", f"WITH {_VERSIONS} SELECT * FROM versions WHERE year_from <= 1995 AND year_to > 1995")
def interval_slice(spark, sf_dir):
    return R.interval_slice(_versions(spark, sf_dir), 1995)


@query("slices", f"{_V} SELECT id, year, own AS code FROM here")
def slices(spark, sf_dir):
    return R.slices(_versions(spark, sf_dir), YEARS).select("id", "year", "code")


@query("latest_version", f"WITH {_VERSIONS} SELECT id, code, stable, year_from, year_to FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (year_from <= 1998 AND year_to > 1998) DESC, year_from DESC, year_to DESC, code) AS n FROM versions) WHERE n = 1")
def latest_version(spark, sf_dir):
    return R.latest_versions(_versions(spark, sf_dir), 1998)


@query("version_distance", f"WITH {_VERSIONS} SELECT id, code, CAST(CASE WHEN 1996 < year_from THEN year_from - 1996 WHEN 1996 >= year_to THEN 1996 - year_to + 1 ELSE 0 END AS integer) AS d FROM versions")
def version_distance_query(spark, sf_dir):
    return _versions(spark, sf_dir).select("id", "code", version_distance(F.lit(1996), "year_from", "year_to").alias("d"))


_CASCADE = _V + """,
dir AS (SELECT id, year, own AS code, value, 'direct' AS method FROM here JOIN src USING (year) WHERE src.code = own),
free AS (SELECT src.* FROM src WHERE NOT EXISTS (SELECT 1 FROM here h WHERE h.year = src.year AND h.own = src.code)),
left1 AS (SELECT h.* FROM here h WHERE NOT EXISTS (SELECT 1 FROM dir d WHERE d.id = h.id AND d.year = h.year)),
ver AS (SELECT id, year, code, value, 'version' AS method FROM (
  SELECT l.id, l.year, f.code, f.value, row_number() OVER (PARTITION BY l.id, l.year ORDER BY CASE WHEN l.year < v.year_from THEN v.year_from - l.year WHEN l.year >= v.year_to THEN l.year - v.year_to + 1 ELSE 0 END, v.year_from DESC, v.code) AS n
  FROM left1 l JOIN versions v ON v.id = l.id JOIN free f ON f.code = v.code AND f.year = l.year) WHERE n = 1),
left2 AS (SELECT l.* FROM left1 l WHERE NOT EXISTS (SELECT 1 FROM ver d WHERE d.id = l.id AND d.year = l.year)),
own1 AS (SELECT year, stable FROM here GROUP BY 1, 2 HAVING count(DISTINCT id) = 1),
stb AS (SELECT l.id, l.year, min(f.code) AS code, arg_min(f.value, f.code) AS value, 'stable' AS method FROM left2 l JOIN own1 USING (year, stable) JOIN free f USING (year, stable) GROUP BY 1, 2 HAVING min(f.code) = max(f.code)),
matched AS (SELECT * FROM dir UNION ALL SELECT * FROM ver UNION ALL SELECT * FROM stb)"""


@query("cascade_match", f"{_CASCADE} SELECT id, year, code, value, method FROM matched")
def cascade_match(spark, sf_dir):
    return R.cascade_match(_versions(spark, sf_dir), _rows(spark, sf_dir), YEARS)


@query(
    "unmatched_reasons",
    f"""{_CASCADE}, lost AS (SELECT h.* FROM here h WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.id = h.id AND m.year = h.year)),
    sh AS (SELECT year, stable, count(DISTINCT id) AS owners FROM here GROUP BY 1, 2), ca AS (SELECT year, stable, count(DISTINCT code) AS codes FROM src GROUP BY 1, 2), rg AS (SELECT DISTINCT year, substr(code, 1, 2) AS region FROM src)
    SELECT l.id, l.year, CASE WHEN rg.region IS NULL THEN 'region_no_rows' WHEN codes > 1 THEN 'multi_row' WHEN owners > 1 THEN 'union_banned' ELSE 'no_code' END AS reason
    FROM lost l LEFT JOIN sh USING (year, stable) LEFT JOIN ca USING (year, stable) LEFT JOIN rg ON rg.year = l.year AND rg.region = substr(l.own, 1, 2)""",
)
def unmatched_reasons(spark, sf_dir):
    v, r = _versions(spark, sf_dir), _rows(spark, sf_dir)
    return R.unmatched(v, r, R.cascade_match(v, r, YEARS), YEARS)


@query("stable_pairs", f"WITH {_ROWS} SELECT code, min(stable) AS stable FROM src GROUP BY code HAVING count(DISTINCT stable) = 1")
def stable_pairs(spark, sf_dir):
    return R.stable_pairs(_rows(spark, sf_dir).select("code", "stable"))


_PRIORITY = """x AS (SELECT o_custkey AS k, CAST(instr('OFP', o_orderstatus) - 1 AS integer) AS p, o_orderpriority = '1-URGENT' AS s, o_totalprice AS value, o_orderkey AS ord FROM orders),
b AS (SELECT *, min(p) OVER (PARTITION BY k) AS bp FROM x), c AS (SELECT *, max(CAST(s AS integer)) OVER (PARTITION BY k) AS anys FROM b WHERE p = bp),
d AS (SELECT *, min(value) OVER (PARTITION BY k) <> max(value) OVER (PARTITION BY k) AS dup_conflict, row_number() OVER (PARTITION BY k ORDER BY ord) AS n FROM c WHERE s OR anys = 0)"""


@query("select_priority_dedup", f"WITH {_PRIORITY} SELECT k, ord, value, dup_conflict, p > 0 AS fallback_period FROM d WHERE n = 1")
def select_priority_dedup(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderkey").select(
        F.col("o_custkey").alias("k"), "o_orderstatus", "o_orderpriority", F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("ord")
    )
    chosen = R.select_priority(o, ["k"], F.instr(F.lit("OFP"), F.col("o_orderstatus")) - 1, F.col("o_orderpriority") == "1-URGENT", ["ord"])
    return chosen.select("k", "ord", "value", "dup_conflict", "fallback_period")


_YEARLY = """yr AS (SELECT o_custkey AS id, CAST(year(o_orderdate) AS integer) AS year, round(sum(o_totalprice), 2) AS amount, count(*) AS heads FROM orders GROUP BY 1, 2),
pop AS (SELECT id, year, CASE WHEN (id + year) % 5 = 0 THEN NULL WHEN (id + year) % 7 = 0 THEN 0.0 ELSE amount END AS value FROM yr)"""


def _yearly(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    return o.groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("amount"), F.count(F.lit(1)).alias("heads"))


def _population(spark, sf_dir):
    value = F.when((F.col("id") + F.col("year")) % 5 == 0, F.lit(None).cast("double")).when((F.col("id") + F.col("year")) % 7 == 0, F.lit(0.0)).otherwise(F.col("amount"))
    return _yearly(spark, sf_dir).select("id", "year", value.alias("value"))


@query("carry_forward", f"""WITH {_YEARLY}, v AS (SELECT id, year, CASE WHEN value > 0 THEN value END AS v, coalesce(value <= 0, false) AS zero_replaced FROM pop),
    b AS (SELECT *, CASE WHEN lag(year) OVER (PARTITION BY id ORDER BY year) = year - 1 THEN lag(v) OVER (PARTITION BY id ORDER BY year) END AS b FROM v)
    SELECT id, year, coalesce(v, b) AS value, zero_replaced, v IS NULL AND b IS NOT NULL AS carried FROM b""")
def carry_forward(spark, sf_dir):
    return R.carry_forward(_population(spark, sf_dir)).select("id", "year", "value", "zero_replaced", "carried")


_ODD = "coalesce(abs({f}(year) OVER w - year) = 1 AND amount / {f}(amount) OVER w BETWEEN 0.5 AND 2.0 AND CAST(heads AS double) / {f}(heads) OVER w <= 0.1e0 AND dev > {f}(dev) OVER w, false)"


@query("jump_flag", f"""WITH {_YEARLY}, h AS (SELECT id, year, amount, CASE WHEN (id + year) % 9 = 0 THEN heads ELSE heads * 12 END AS heads FROM yr), r AS (SELECT *, amount / heads AS r FROM h),
    d AS (SELECT *, abs(ln(r / median(r) OVER (PARTITION BY year))) AS dev FROM r) SELECT id, year, {_ODD.format(f="lag")} OR {_ODD.format(f="lead")} AS jump FROM d WINDOW w AS (PARTITION BY id ORDER BY year)""")
def jump_flag(spark, sf_dir):
    heads = F.when((F.col("id") + F.col("year")) % 9 == 0, F.col("heads")).otherwise(F.col("heads") * 12)
    return R.jump_flags(_yearly(spark, sf_dir).withColumn("heads", heads)).select("id", "year", "jump")


@query("neighbour_year_ok", f"""WITH {_YEARLY}, n AS (SELECT id, year, CASE WHEN abs(lag(year) OVER w - year) = 1 THEN lag(amount) OVER w END AS a, CASE WHEN abs(lead(year) OVER w - year) = 1 THEN lead(amount) OVER w END AS b FROM yr WINDOW w AS (PARTITION BY id ORDER BY year))
    SELECT id, year, (a IS NOT NULL OR b IS NOT NULL) AND coalesce(a BETWEEN 100000 AND 400000, true) AND coalesce(b BETWEEN 100000 AND 400000, true) AS ok FROM n""")
def neighbour_year_ok(spark, sf_dir):
    return R.neighbour_year_ok(_yearly(spark, sf_dir), 100000, 400000, value="amount").select("id", "year", "ok")


@query("rollup_weighted_gated", f"""WITH {SQL_CUSTOMERS}, x AS (SELECT g, CASE WHEN id % 3 <> 0 OR g % 4 = 0 THEN bal END AS v, n_orders AS w FROM cust),
    a AS (SELECT g, sum(CASE WHEN v IS NOT NULL AND w > 0 THEN v * w END) AS wv, sum(CASE WHEN v IS NOT NULL AND w > 0 THEN w END) AS w, sum(w) AS whole, count(*) AS n_members FROM x GROUP BY g)
    SELECT g, {_r("CASE WHEN coalesce(w / CAST(whole AS double), 0) >= 0.66e0 THEN wv / w END")} AS value, {_r("coalesce(w / CAST(whole AS double), 0.0)")} AS coverage, n_members FROM a""")
def rollup_weighted_gated(spark, sf_dir):
    v = F.when((F.col("id") % 3 != 0) | (F.col("g") % 4 == 0), F.col("bal"))
    return rounded(R.weighted_rollup(customers(spark, sf_dir).select("g", v.alias("v"), F.col("n_orders").alias("w")), ["g"], "v", "w", 0.66), "value", "coverage")


@query("shares_renormalised", f"""WITH {SQL_PANEL}, s AS (SELECT id, t, cat, v / 1000000.0e0 AS s FROM panel) SELECT id, t, cat, {_r("s / greatest(sum(s) OVER (PARTITION BY id, t), 1.0)")} AS share FROM s""")
def shares_renormalised(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("whole", F.lit(1000000.0))
    return rounded(R.renormalised_shares(p, ["id", "t"], "v", "whole").select("id", "t", "cat", "share"), "share")


@query("code_normalize", """WITH c AS (SELECT c_custkey AS id, regexp_replace(CASE c_custkey % 4 WHEN 0 THEN substr(c_name, 10) || '' WHEN 1 THEN '12-' || substr(c_name, 13, 6) WHEN 2 THEN substr(c_name, 11) || ' 000' ELSE c_name END, '[^0-9]', '', 'g') AS d FROM customer)
    SELECT id, CASE WHEN length(d) = 8 THEN d WHEN length(d) = 11 AND ends_with(d, '000') THEN substr(d, 1, 8) END AS code, substr(CASE WHEN length(d) = 8 THEN d WHEN length(d) = 11 AND ends_with(d, '000') THEN substr(d, 1, 8) END, 1, 2) AS prefix FROM c""")
def code_normalize(spark, sf_dir):
    raw = F.expr("case c_custkey % 4 when 0 then substr(c_name, 10) when 1 then concat('12-', substr(c_name, 13, 6)) when 2 then concat(substr(c_name, 11), ' 000') else c_name end")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), normalize_code(raw).alias("code"))
    return c.select("id", "code", code_prefix("code").alias("prefix"))


@query("flag_union", """WITH f AS (SELECT p_partkey AS id, list_sort(list_distinct(list_filter([CASE WHEN p_size > 25 THEN 'large' END, CASE WHEN p_size % 2 = 0 THEN 'even' END, CASE WHEN p_retailprice > 1000 THEN 'large' END], lambda x: x IS NOT NULL))) AS f FROM part)
    SELECT id, nullif(array_to_string(f, ';'), '') AS flags, list_contains(f, 'large') AS is_large FROM f""")
def flag_union(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, "large").alias("a"), F.when(F.col("p_size") % 2 == 0, "even").alias("b"), F.when(F.col("p_retailprice") > 1000, "large").alias("c")
    )
    joined = p.select("id", join_flags(["a", "b", "c"]).alias("flags"))
    return joined.select("id", "flags", has_flag("flags", ["large"]).alias("is_large"))


@query("map_codes", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' WHEN 'P' THEN 'partial' END AS status FROM orders")
def map_codes(spark, sf_dir):
    return read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias("id"), map_or_fail("o_orderstatus", {"O": "open", "F": "filled", "P": "partial"}).alias("status"))


@query("value_transforms", f"""SELECT c_custkey AS id, {_r("CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END")} AS log_, {_r("ln(1 + abs(c_acctbal))")} AS log1p_, {_r("(1 + c_acctbal / 10000) / 1.1e0 - 1")} AS real_ FROM customer""")
def value_transforms(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    out = c.select(F.col("c_custkey").alias("id"), transform_value("c_acctbal", "log").alias("log_"), log1p_abs("c_acctbal").alias("log1p_"), real_growth(F.col("c_acctbal") / 10000, F.lit(1.1)).alias("real_"), safe_log("c_acctbal").alias("_l"))
    return rounded(out.drop("_l"), "log_", "log1p_", "real_")


@query("coverage_report", f"""WITH {_YEARLY} SELECT year, count(DISTINCT id) AS n_ids, count(*) FILTER (WHERE value IS NULL) AS n_null, count(*) FILTER (WHERE value = 0) AS n_zero FROM pop GROUP BY year""")
def coverage_report(spark, sf_dir):
    return _population(spark, sf_dir).groupBy("year").agg(F.countDistinct("id").alias("n_ids"), F.count_if(F.col("value").isNull()).alias("n_null"), F.count_if(F.col("value") == 0).alias("n_zero"))


@query("role_transitions", """WITH x AS (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS nxt FROM conversations) SELECT role, nxt, count(*) AS n FROM x WHERE nxt IS NOT NULL GROUP BY 1, 2""")
def role_transitions(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    x = read(spark, sf_dir, "conversations", "conv_id", "role", "turn").select("role", F.lead("role").over(w).alias("nxt"))
    return x.filter("nxt is not null").groupBy("role", "nxt").agg(F.count(F.lit(1)).alias("n"))
