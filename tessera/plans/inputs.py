"""The inputs of the registered queries, as DataFrames and as the SQL of their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import month_ordinal

#: The panel's months are those of ``orders``, 1995-01 to 2001-08; halves of them are compared where two periods are.
BASE_YEAR, MONTHS = 1995, 80
HALF = MONTHS // 2
#: Order priorities, the panel's categories, in order; and their short names.
CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PARTS = ["p1", "p2", "p3", "p4", "p5"]


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, g, t, cat, price`` of every order."""
    orders = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    customers = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    nations = read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_nationkey").alias("id"), F.col("n_regionkey").alias("g"), month_ordinal("o_orderdate", BASE_YEAR).alias("t"),
            F.col("o_orderpriority").alias("cat"), F.col("o_totalprice").alias("price"),
        )
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, g, t, cat, v``: nation x month x priority, value rounded to cents."""
    return orders_by_nation(spark, sf_dir).groupBy("id", "g", "t", "cat").agg(F.round(F.sum("price"), 2).alias("v"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, g, t, y``: log of the monthly total of each nation."""
    rows = orders_by_nation(spark, sf_dir).groupBy("id", "g", "t").agg(F.round(F.sum("price"), 2).alias("v"))
    return rows.select("id", "g", "t", "v", F.ln("v").alias("y"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, g, seg, bal, n_orders, spend`` of every customer; without orders 0."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    o = read(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spend")
    )
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"),
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("spend", F.lit(0.0)).alias("spend"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, v array<float>, label``."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("long").alias("label"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, j, x``: every coordinate of every vector."""
    return vectors(spark, sf_dir).select("id", "label", F.posexplode("v").alias("j", "x")).withColumn("x", F.col("x").cast("double"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``a, b, w``: undirected graph of customer and supplier nations, weight is the number of order lines."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey")
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    s = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    per = li.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    met = per.join(o, per["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, per["l_suppkey"] == s["s_suppkey"])
    both = met.filter("c_nationkey <> s_nationkey").select(
        F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b"), "n"
    )
    return both.groupBy("a", "b").agg(F.sum("n").cast("double").alias("w"))


def strong_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of at least the mean weight; the edge list has a row per pair of nations."""
    f = flows(spark, sf_dir)
    return f.withColumn("_m", F.avg("w").over(Window.partitionBy())).filter("w >= _m").drop("_m")


SQL_ORDERS = """ord AS (
  SELECT c_nationkey AS id, n_regionkey AS g, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS integer) AS t,
         o_orderpriority AS cat, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
SQL_PANEL = SQL_ORDERS + ",\npanel AS (SELECT id, g, t, cat, round(sum(price), 2) AS v FROM ord GROUP BY id, g, t, cat)"
SQL_MONTHLY = SQL_ORDERS + ",\nmonthly AS (SELECT *, ln(v) AS y FROM (SELECT id, g, t, round(sum(price), 2) AS v FROM ord GROUP BY id, g, t))"
SQL_CUSTOMERS = """cust AS (
  SELECT c_custkey AS id, c_nationkey AS g, c_mktsegment AS seg, c_acctbal AS bal, coalesce(n_orders, 0) AS n_orders, coalesce(spend, 0.0) AS spend
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY o_custkey)
    ON c_custkey = o_custkey)"""
SQL_COORDINATES = """pts AS (
  SELECT id, label, CAST(j - 1 AS integer) AS j, CAST(v[j] AS double) AS x
  FROM (SELECT vec_id AS id, CAST(label AS bigint) AS label, embedding AS v, unnest(range(1, len(embedding) + 1)) AS j FROM embeddings))"""
SQL_FLOWS = """flows AS (
  SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, CAST(count(*) AS double) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL),
strong AS (SELECT * FROM flows WHERE w >= (SELECT avg(w) FROM flows)),
both_ways AS (SELECT a, b, w FROM strong UNION ALL SELECT b, a, w FROM strong)"""
SQL_WIDE = SQL_PANEL + """,
wide AS (
  SELECT id, g, t, """ + ", ".join(f"sum(CASE WHEN cat = '{c}' THEN v END) AS {p}" for c, p in zip(CATEGORIES, PARTS, strict=True)) + """
  FROM panel GROUP BY id, g, t),
full_ AS (SELECT * FROM wide WHERE """ + " AND ".join(f"{p} IS NOT NULL" for p in PARTS) + ")"
