"""Streams over events, and sources read through contracts, strict CSV and predicate sets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_shared_folder
from tessera.sources import io
from tessera.sources.contracts import Col, Contract
from tessera.streaming import events as E

from .analyses import n_rows
from .base import query
from .inputs import read
from .panels import rounded

#: A backlog is one batch, so that no row of it comes late.
WHOLE_BACKLOG = 1_000_000
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]


def processed(spark: SparkSession, sf_dir: str, stream, schema: str) -> DataFrame:
    """What a stream over the events has put out once its backlog is done; written to the shared folder."""
    path = f"{ensure_shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    # A pattern, because a stream can't be opened on the name of a single file.
    E.run_once(stream(E.read_events(spark, f"{sf_dir}/event[s].parquet", WHOLE_BACKLOG)), f"{path}/out", f"{path}/log")
    return spark.read.schema(schema).parquet(f"{path}/out")


@query("stream_daily", """SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS value FROM events
    GROUP BY 1, 2 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def stream_daily(spark, sf_dir):
    """Windows of a day that the watermark has closed."""
    out = processed(spark, sf_dir, E.windowed, "start timestamp, event_type string, n long, users long, value double")
    return rounded(out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value"), "value", digits=4)


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
    k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) + 0.0 AS value FROM k GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def stream_sessions(spark, sf_dir):
    """Sessions that the watermark has closed."""
    out = processed(spark, sf_dir, E.sessions, "user_id long, start timestamp, end timestamp, n long, value double")
    return rounded(out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "value"), "value", digits=4)


@query("stream_unique_events", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_unique_events(spark, sf_dir):
    """Events of a feed that brings every event twice."""
    twice = processed(spark, sf_dir, lambda e: E.deduplicated(e.unionByName(e)), E.EVENT_SCHEMA.replace("timestamp_ntz", "timestamp"))
    return twice.groupBy("event_type").agg(n_rows().alias("n"))


CUSTOMER = Contract(
    "customer",
    [Col("c_custkey", "bigint", low=1), Col("c_nationkey", "bigint", low=0, high=20), Col("c_mktsegment", "string", values=SEGMENTS), Col("c_acctbal", "double", low=0.0, high=9000.0)],
    key=["c_custkey"],
    checks={"rich or small": "c_acctbal > 100 or c_nationkey < 5"},
)


@query("contract_report", """SELECT 'c_custkey: null' AS rule, count(*) FILTER (c_custkey IS NULL) AS n FROM customer UNION ALL SELECT 'c_custkey: below 1', count(*) FILTER (c_custkey < 1) FROM customer
    UNION ALL SELECT 'c_nationkey: null', count(*) FILTER (c_nationkey IS NULL) FROM customer UNION ALL SELECT 'c_nationkey: below 0', count(*) FILTER (c_nationkey < 0) FROM customer
    UNION ALL SELECT 'c_nationkey: above 20', count(*) FILTER (c_nationkey > 20) FROM customer UNION ALL SELECT 'c_mktsegment: null', count(*) FILTER (c_mktsegment IS NULL) FROM customer
    UNION ALL SELECT 'c_mktsegment: not allowed', count(*) FILTER (c_mktsegment = 'MACHINERY') FROM customer UNION ALL SELECT 'c_acctbal: null', count(*) FILTER (c_acctbal IS NULL) FROM customer
    UNION ALL SELECT 'c_acctbal: below 0.0', count(*) FILTER (c_acctbal < -1e-9) FROM customer UNION ALL SELECT 'c_acctbal: above 9000.0', count(*) FILTER (c_acctbal > 9000 + 1e-9) FROM customer
    UNION ALL SELECT 'c_acctbal: nan', count(*) FILTER (isnan(c_acctbal)) FROM customer UNION ALL SELECT 'rule rich or small', count(*) FILTER (NOT (c_acctbal > 100 OR c_nationkey < 5)) FROM customer""")
def contract_report(spark, sf_dir):
    return CUSTOMER.report(CUSTOMER.coerce(read(spark, sf_dir, "customer")))


@query("contract_coerced", "SELECT CAST(s_suppkey AS integer) AS s_suppkey, CAST(s_nationkey AS integer) AS s_nationkey, CAST(s_acctbal AS double) AS s_acctbal FROM supplier")
def contract_coerced(spark, sf_dir):
    """A table read as its contract declares it; any violation would be an error."""
    declared = Contract("supplier", [Col("s_suppkey", "int", low=0), Col("s_nationkey", "int", low=0), Col("s_acctbal", "double")], key=["s_suppkey"])
    return io.read_table(spark, f"{sf_dir}/supplier.parquet", declared)


@query("content_controls", """WITH f AS (SELECT count(*) AS n, count(DISTINCT c_nationkey) AS nations, avg(c_acctbal) AS bal FROM customer)
    SELECT 'nations' AS name, 25.0e0 AS expected, CAST(nations AS double) AS actual, 'hard' AS kind, nations = 25 AS ok FROM f UNION ALL
    SELECT 'balance', 4500.0e0, round(bal, 4), 'soft', abs(bal - 4500) <= 45 FROM f UNION ALL SELECT 'rows', 1.0e0, CAST(n AS double), 'info', true FROM f""")
def content_controls(spark, sf_dir):
    expected = {"nations": ("count(distinct c_nationkey)", 25, "hard"), "balance": ("avg(c_acctbal)", 4500, "soft"), "rows": ("count(*)", 1, "info")}
    return io.controls(read(spark, sf_dir, "customer", "c_nationkey", "c_acctbal"), expected).withColumn("actual", F.round("actual", 4))


@query("predicate_sets", "SELECT l_shipyear, count(*) AS n FROM (SELECT year(l_shipdate) AS l_shipyear FROM lineitem WHERE (l_returnflag = 'R' AND l_quantity > 45) OR (l_linenumber IN (1, 7) AND l_discount >= 0.09)) t GROUP BY 1")
def predicate_sets(spark, sf_dir):
    """Rows that one of several sets of predicates keeps; the scan gets them."""
    wanted = io.any_of([[("l_returnflag", "==", "R"), ("l_quantity", ">", 45)], [("l_linenumber", "in", [1, 7]), ("l_discount", ">=", 0.09)]])
    rows = read(spark, sf_dir, "lineitem").filter(wanted)
    return rows.groupBy(F.year("l_shipdate").alias("l_shipyear")).agg(n_rows().alias("n"))


@query("csv_round_trip", "SELECT p_brand, p_size, CASE WHEN p_type LIKE 'STANDARD%' THEN NULL ELSE p_type END AS kind, count(*) AS n FROM part GROUP BY ALL")
def csv_round_trip(spark, sf_dir):
    """Parts written as CSV and read back strictly: strings only, given codes as null."""
    path = f"{ensure_shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    parts = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size", "p_type")
    io.write_csv(parts.withColumn("p_type", F.when(F.col("p_type").startswith("STANDARD"), "ND").otherwise(F.col("p_type"))), path)
    back = io.read_strict_csv(spark, path, ["p_partkey", "p_brand", "p_size", "p_type"], sep=",", null_codes=["ND"])
    return back.groupBy("p_brand", F.col("p_size").cast("int").alias("p_size"), F.col("p_type").alias("kind")).agg(n_rows().alias("n"))
