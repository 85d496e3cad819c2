"""Runs, fills, agreement and feasibility against plain Python."""

import itertools
import math
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import comparisons as C

LABELS = [(c, i, v) for i in range(60) for c, v in (("a", i % 3), ("b", i // 20), ("c", -1 if i < 5 else i % 2), ("d", 0)) if not (c == "b" and i % 7 == 0)]


def test_longest_run_breaks_at_gaps(spark):
    rows = [("x", 1, True), ("x", 2, True), ("x", 4, True), ("x", 5, True), ("x", 6, True), ("x", 7, False), ("x", 8, None), ("y", 1, False), ("y", 3, None)]
    df = spark.createDataFrame(rows, "k string, t int, h boolean")
    assert {r.k: r.run for r in C.longest_run(df, "k", "t", F.col("h")).collect()} == {"x": 3, "y": 0}


def test_fill(spark):
    rows = [("x", 1, None), ("x", 2, 5.0), ("x", 3, None), ("x", 4, 7.0), ("y", 1, None)]
    got = {(r.k, r.y): r.w for r in C.fill_from_years(spark.createDataFrame(rows, "k string, y int, w double"), "k", "y", "w").collect()}
    assert got == {("x", 1): 5.0, ("x", 2): 5.0, ("x", 3): 5.0, ("x", 4): 7.0, ("y", 1): None}


def test_agreement(spark):
    labels = spark.createDataFrame(LABELS, "cand string, id int, label int")
    got = {(r.p, r.q): (r.ari, r.n) for r in C.agreement(labels).collect()}
    by = {c: {i: v for k, i, v in LABELS if k == c} for c in "abcd"}
    for p, q in itertools.combinations("abcd", 2):
        both = sorted(by[p].keys() & by[q].keys())
        pairs = list(itertools.combinations(both, 2))
        x = [by[p][i] == by[p][j] for i, j in pairs]
        y = [by[q][i] == by[q][j] for i, j in pairs]
        e = sum(x) * sum(y) / len(pairs)
        top, low = sum(u and v for u, v in zip(x, y, strict=True)) - e, (sum(x) + sum(y)) / 2 - e
        assert math.isclose(got[p, q][0], top / low if low else 1.0, abs_tol=1e-12), (p, q)
        assert got[p, q][1] == len(both)


def test_feasibility(spark):
    got = {r.cand: r for r in C.feasibility(spark.createDataFrame(LABELS, "cand string, id int, label int"), 0.2).collect()}
    assert (got["c"].k, got["c"].ok, got["d"].k, got["d"].ok, got["d"].entropy) == (2, True, 1, False, 0.0)
    sizes = Counter(v for c, _, v in LABELS if c == "c" and v != -1)
    shares = [n / sum(sizes.values()) for n in sizes.values()]
    assert math.isclose(got["c"].entropy, -sum(s * math.log(s) for s in shares) / math.log(2))
    assert math.isclose(got["c"].noise, 5 / 60) and math.isclose(got["c"].least, min(sizes.values()) / 60)


def test_empty(spark):
    none = spark.createDataFrame([], "cand string, id int, label int")
    assert C.agreement(none).count() == C.feasibility(none, 0.1).count() == 0
