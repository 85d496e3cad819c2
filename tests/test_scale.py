"""Registered queries on inputs that the generated tables do not hold, against their SQL."""

import re
import shutil
from pathlib import Path

import pytest
from oracle import connect, difference
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.operators import graphs as G
from tessera.operators import resample as B
from tessera.operators import stats
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def changed(spark, tmp_path):
    """``compare(name, table=sql, ...)``: how the query differs from its SQL when tables are replaced."""

    def compare(name: str, **tables: str) -> str:
        for file in Path(SF).iterdir():
            shutil.copyfile(file, tmp_path / file.name)
        old = connect(SF)
        for table, sql in tables.items():
            old.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet'")
        return difference(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLE_SQL[name], connect(str(tmp_path)))

    return compare


def test_place_groups_with_customers_without_orders(changed):
    orders = "SELECT * FROM orders WHERE o_custkey % 3 > 0"
    assert changed("place_groups", orders=orders) == ""
    # A group of one customer, and groups in which every customer has spent the same.
    assert changed("place_groups", orders=f"{orders} OR o_custkey > 3") == ""
    assert changed("place_groups", orders="SELECT * REPLACE (1.5 AS o_totalprice) FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey) = 1") == ""


def test_place_groups_by_ranks(spark, changed, tmp_path):
    # Spending grows with the balance, but not in proportion; every tenth balance is missing.
    customer = "SELECT * REPLACE (CASE WHEN c_custkey % 10 > 0 THEN c_custkey - 50.5 END AS c_acctbal) FROM customer"
    orders = "SELECT * REPLACE (exp(o_custkey / 10.0) AS o_totalprice) FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"
    assert changed("place_groups", customer=customer, orders=orders) == ""
    got = {r.place: r.r for r in registry.QUERIES["place_groups"](spark, str(tmp_path)).collect()}
    assert got["debt"] == got["rest"] == 1.0
    # Balances and totals that many customers share, and a group with two complete pairs.
    customer = "SELECT * REPLACE (CASE WHEN c_custkey % 10 > 0 THEN (c_custkey * 7 % 5 + 1.0) * CASE WHEN c_custkey < 3 THEN -1 ELSE 1 END END AS c_acctbal) FROM customer"
    assert changed("place_groups", customer=customer, orders=orders.replace("exp(o_custkey / 10.0)", "o_custkey * 11 % 4 + 0.5")) == ""


def test_place_groups_are_not_tasks(spark):
    plan = registry.QUERIES["place_groups"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # Only totals of value ranges meet in a window over a whole group.
    assert set(re.findall(r"windowspecdefinition\(place#\d+, (\w+)", plan)) <= {"__m", "__b"}


def test_correlation_of_a_constant_in_parts(spark):
    # Sums of merged parts leave its variance above 0.
    rows = spark.range(1000, numPartitions=7).select(F.lit(30.1).alias("x"), F.col("id").cast("double").alias("y"))
    assert str(rows.agg(stats.pearson("x", "y").alias("r")).first().r) == "nan"


def broadcast(df) -> list[str]:
    """The subtree of every broadcast in the plan before it runs."""
    lines = df._jdf.queryExecution().sparkPlan().toString().split("\n") + df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    found = []
    for i in (i for i, x in enumerate(lines) if "BroadcastExchange" in x):
        end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        found.append("\n".join(lines[i:end]))
    return found


@pytest.mark.parametrize("name", ["permute_within", "null_distribution", "empirical_p"])
def test_no_permuted_rows_are_broadcast(spark, name):
    # Of the rows beside each other only one-row totals, after an aggregation without keys, may be broadcast.
    assert not [x for x in broadcast(registry.QUERIES[name](spark, SF)) if "Window" in x]
    assert not [x for x in broadcast(registry.QUERIES[name](spark, SF)) if "c_acctbal" in x and "Aggregate(keys=[], " not in x]


def test_cards_are_dealt_in_tasks_of_bounded_size(spark, changed, monkeypatch):
    monkeypatch.setattr(B, "TASK_ROWS", 100, raising=False)
    plan = registry.QUERIES["empirical_p"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # 150 customers in 20 replicates; the cards before and after their draws, and the seats.
    assert plan.count(", 30), REPARTITION_BY_NUM") == 3
    customer = "SELECT * REPLACE (CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS c_nationkey) FROM customer"
    assert changed("empirical_p", customer=customer) == ""


#: Copies, a zero vector, a null, not-a-number and an infinity among the vectors.
ODD = """SELECT vec_id, CASE vec_id % 50 WHEN 1 THEN list_transform(embedding, lambda x: 0.0::FLOAT) WHEN 2 THEN NULL
  WHEN 3 THEN list_transform(embedding, lambda x: 'nan'::FLOAT) WHEN 4 THEN list_transform(embedding, lambda x: 'inf'::FLOAT)
  WHEN 5 THEN (SELECT min(embedding) FROM embeddings) ELSE embedding END AS embedding, label FROM embeddings"""


def joins_vectors(df) -> bool:
    return "Join" in df._jdf.queryExecution().optimizedPlan().toString()


def test_cosine_pairs_in_parts(spark, changed, monkeypatch):
    assert not joins_vectors(registry.QUERIES["cosine_pairs"](spark, SF))
    monkeypatch.setattr(G, "PAIR_ROWS", 11)
    monkeypatch.setattr(G, "TILE", 4)
    assert changed("cosine_pairs", embeddings=ODD) == ""
    assert changed("euclid_pairs", embeddings=ODD) == ""


def test_gaussian_kernel_of_any_distances(spark, changed, monkeypatch):
    assert not joins_vectors(registry.QUERIES["gaussian_kernel"](spark, SF))
    same = "SELECT * REPLACE ([1.5, 2.0]::FLOAT[] AS embedding) FROM embeddings"
    assert changed("gaussian_kernel", embeddings=same) == ""
    monkeypatch.setattr(G, "PAIR_ROWS", 11)
    assert changed("gaussian_kernel", embeddings=ODD) == ""
    monkeypatch.setattr(G, "FEW", 0)
    assert changed("gaussian_kernel", embeddings="SELECT * FROM embeddings WHERE vec_id % 3 = 0") == ""
    assert changed("gaussian_kernel", embeddings="SELECT * FROM embeddings WHERE vec_id = 0") == ""


@pytest.mark.parametrize("name", ["knn_lists", "knn_edges", "mutual_knn_edges", "k_occurrence", "edge_jaccard"])
def test_neighbours_within_a_label_in_parts(spark, changed, monkeypatch, name):
    assert "zip_with" not in registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(G, "BLOCK_ROWS", 20)
    monkeypatch.setattr(G, "BLOCK_QUERIES", 7)
    # A vector that is no number must not hide the other neighbours; labels of one to four vectors have short lists.
    assert changed(name, embeddings=f"SELECT * FROM ({ODD}) WHERE embedding IS NOT NULL") == ""
    assert changed(name, embeddings="SELECT * REPLACE (CASE WHEN vec_id < 60 THEN 100 + vec_id // 3 WHEN vec_id = 60 THEN NULL WHEN vec_id = 61 THEN 99 ELSE label END AS label) FROM embeddings") == ""


@pytest.mark.parametrize("name", ["k_occurrence", "mutual_knn_edges"])
def test_lists_of_many_copies(changed, monkeypatch, name):
    apart = G._apart

    def few(q, y):
        # 64 queries at once; with all 1,000 copies they make 64,000 pairs.
        assert len(q) < 5000
        return apart(q, y)

    monkeypatch.setattr(G, "_apart", few)
    cloudpickle.register_pickle_by_value(G)
    try:
        copies = "SELECT 10000 + i AS vec_id, embedding, label FROM embeddings, range(1000) t(i) WHERE vec_id = 0"
        assert changed(name, embeddings=f"SELECT * FROM embeddings UNION ALL {copies}") == ""
    finally:
        cloudpickle.unregister_pickle_by_value(G)


@pytest.mark.parametrize("name", ["k_occurrence", "mutual_knn_edges"])
def test_lists_of_many_near_copies(changed, monkeypatch, name):
    apart = G._apart

    def few(q, y):
        # At most 512 queries at once; 64 of them with all 1,000 near copies make 64,000 pairs.
        assert len(q) < 5000
        return apart(q, y)

    monkeypatch.setattr(G, "_apart", few)
    cloudpickle.register_pickle_by_value(G)
    try:
        near = "SELECT 10000 + i AS vec_id, list_transform(embedding, lambda x, j: (x + 1e-6 * sin(i * j))::FLOAT) AS embedding, label FROM embeddings, range(1000) t(i) WHERE vec_id = 0"
        assert changed(name, embeddings=f"SELECT * FROM embeddings UNION ALL {near}") == ""
    finally:
        cloudpickle.unregister_pickle_by_value(G)
