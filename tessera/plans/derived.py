"""Month lists, code sections, lookups, densities, dummies and signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import dummies, month_columns, section_letter, shown_pct
from tessera.operators import resolve as R

from .base import query
from .inputs import SQL_CUSTOMERS, customers, read
from .panels import rounded

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("month_list", "SELECT CAST(t AS integer) AS t, strftime(date '1995-01-01' + to_months(CAST(t AS integer)), '%Y-%m') AS ym FROM range(0, 84) AS r(t)")
def month_list(spark, sf_dir):
    return R.month_list(spark, 1995, 2001)


@query("month_columns", "SELECT CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS integer) AS t, CAST(year(o_orderdate) AS integer) AS year, CAST(month(o_orderdate) AS integer) AS month, count(*) AS n FROM orders GROUP BY ALL")
def month_columns_(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderdate").select(F.date_format("o_orderdate", "yyyy-MM").alias("ym"))
    return o.withColumns(month_columns("ym", 1995, 2001)).groupBy("t", "year", "month").agg(F.count(F.lit(1)).alias("n"))


@query("section_letters", r"""WITH l AS (SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'All sections' WHEN 1 THEN 'Section ' || chr(65 + CAST(p_size % 7 AS integer)) || ' ' || p_type WHEN 2 THEN 'Section ' || chr(1040 + 2 * CAST(p_size % 3 AS integer)) || '.' WHEN 3 THEN 'sections' ELSE 'All sections ' END AS label FROM part)
    SELECT id, CASE WHEN label = 'All sections' THEN 'TOTAL' WHEN starts_with(label, 'Section ') THEN CASE unicode(substr(label, 9, 1)) WHEN 1040 THEN 'A' WHEN 1042 THEN 'B' ELSE substr(label, 9, 1) END END AS section FROM l""")
def section_letters(spark, sf_dir):
    label = F.expr(
        "case p_size % 5 when 0 then 'All sections' when 1 then concat('Section ', char(65 + p_size % 7), ' ', p_type) "
        "when 2 then concat('Section ', element_at(array('А', 'В', 'Д'), cast(p_size % 3 + 1 as int)), '.') when 3 then 'sections' else 'All sections ' end"
    )
    p = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_type").select(F.col("p_partkey").alias("id"), label.alias("label"))
    # Cyrillic letters that look like Latin ones.
    alike = {"А": "A", "В": "B", "Е": "E", "Н": "H"}
    return p.select("id", section_letter("label", "All sections", r"^Section (\S)", alike).alias("section"))


@query("district_lookup", "SELECT n_nationkey AS id, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def district_lookup(spark, sf_dir):
    nations = read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("r_regionkey"))
    return R.lookup_codes(nations, "r_regionkey", read(spark, sf_dir, "region", "r_regionkey", "r_name"), "r_name").select("id", "r_name")


@query("relative_density", """WITH n AS (SELECT n_nationkey AS id, n_regionkey AS g, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS pop, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS area FROM nation),
    d AS (SELECT id, g, CASE WHEN pop > 0 AND area > 0 THEN ln(pop / CAST(area AS double)) END AS x FROM n)
    SELECT id, round(x - (SELECT median(e.x) FROM d e WHERE e.g = d.g), 6) + 0.0 AS density FROM d""")
def relative_density(spark, sf_dir):
    def sizes(name, key, nation, out):
        return read(spark, sf_dir, name, key, nation).groupBy(F.col(nation).alias("id")).agg(F.count(F.lit(1)).alias(out))

    n = read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("g"))
    both = n.join(sizes("customer", "c_custkey", "c_nationkey", "pop"), "id", "left").join(sizes("supplier", "s_suppkey", "s_nationkey", "area"), "id", "left")
    return rounded(R.relative_density(both, "pop", "area", "g").select("id", "density"), "density")


@query("missingness_features", f"""WITH {SQL_CUSTOMERS} SELECT id, round(ln(1 + n_orders), 6) + 0.0 AS log_orders, {', '.join(f"CAST(seg = '{s}' AS integer) AS seg{i}" for i, s in enumerate(SEGMENTS) if i)} FROM cust""")
def missingness_features(spark, sf_dir):
    c = customers(spark, sf_dir)
    return rounded(c.select("id", F.log1p("n_orders").alias("log_orders"), *[v.alias(k) for k, v in dummies("seg", SEGMENTS, "seg").items()]), "log_orders")


@query("code_signatures", """WITH s AS (SELECT o_custkey AS id, string_agg(DISTINCT o_orderpriority || '=' || o_orderstatus, ';' ORDER BY o_orderpriority || '=' || o_orderstatus) AS signature FROM orders GROUP BY 1)
    SELECT signature, count(*) AS n FROM s GROUP BY 1""")
def code_signatures(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_orderstatus")
    return R.signatures(o, "o_custkey", ["o_orderpriority", "o_orderstatus"]).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


@query("shown_shares", "SELECT o_orderpriority AS cat, round(100 * count(*) / CAST((SELECT count(*) FROM orders) AS double), 1) + 0.0 AS pct FROM orders GROUP BY 1")
def shown_shares(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderpriority")
    whole = o.agg(F.count(F.lit(1)).alias("_all"))
    each = o.groupBy(F.col("o_orderpriority").alias("cat")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(whole))
    return each.select("cat", (shown_pct(F.col("n") / F.col("_all")) + 0.0).alias("pct"))
