"""Positions, bins, near values and superiority against plain Python, with a value that most rows share."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import summaries as S

ROWS = [(i, float(random.Random(i).choice([7, 7, 7, *range(40)])), i % 3) for i in range(600)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([*ROWS, (900, None, 1)], "id long, x double, k int")


def test_positions_and_tiles(df):
    order = sorted(ROWS, key=lambda r: (r[1], r[0]))
    got = {r.id: r.pos for r in S.positions(df, "x", "id").collect()}
    assert got == {r[0]: i for i, r in enumerate(order)}
    want = {}
    for q in (7, 1000):
        small, more = divmod(len(order), q)
        sizes = [small + (i < more) for i in range(q)]
        want = {r[0]: b for r, b in zip(order, [b + 1 for b, n in enumerate(sizes) for _ in range(n)], strict=True)}
        assert {r.id: r.bin for r in S.tiles(df, "x", "id", q).collect()} == want


def test_superiority(df):
    got = {(r.a, r.b): (r.u, r.n) for r in S.ordered_superiority(df.filter("x is not null"), [0, 1, 2], "k", "x").collect()}
    for a, b in ((0, 1), (0, 2), (1, 2)):
        left, right = [r[1] for r in ROWS if r[2] == a], [r[1] for r in ROWS if r[2] == b]
        assert got[a, b] == (sum((y > x) + 0.5 * (y == x) for x in left for y in right), len(left) * len(right))


def test_near_values(df):
    got = df.filter("x is not null").select("id", S.array_median(S.near_values(df, "k", "x", "id", "x", 4)).alias("m"))
    for r in got.collect():
        own = ROWS[r.id]
        others = sorted((abs(o[1] - own[1]), o[0], o[1]) for o in ROWS if o[2] == own[2] and o[0] != own[0])[:4]
        # Of equally near rows those in the window count; the distances are the same.
        assert abs(r.m - own[1]) <= others[-1][0]
    assert statistics.median([1, 2, 3, 4]) == df.limit(1).select(S.array_median(F.array(*[F.lit(float(v)) for v in (3, 1, 4, 2)]))).first()[0]


def test_lineage_counts_links(spark):
    rows = [(i, i % 4, (i * 3) % 5) for i in range(40)]
    want = {}
    for a, died, _ in rows:
        for b, _, born in rows:
            if died == born and a < b:
                want.setdefault(a, []).append("predecessor")
                want.setdefault(b, []).append("successor")
    got = {r.id: (r.role, r.n) for r in S.lineage(spark.createDataFrame(rows, "id long, died long, born long"), "id", "died", "born").collect()}
    assert got == {k: (min(v), len(v)) for k, v in want.items()}


def test_empty_table(spark):
    none = spark.createDataFrame([], "id long, x double, k int")
    assert S.positions(none, "x", "id").count() == 0
    assert S.tiles(none, "x", "id", 4).count() == 0
    assert S.ordered_superiority(none, [0, 1], "k", "x").count() == 0


def test_ranked(df):
    xs = [r[1] for r in ROWS]
    want = {r[0]: sum(x < r[1] for x in xs) + (xs.count(r[1]) + 1) / 2 for r in ROWS}
    assert {r.id: r["rank"] for r in S.ranked(df, "x").collect()} == want


def test_ranked_within_groups(df):
    got = {r.id: r["rank"] for r in S.ranked_within(df, {"rank": "x"}, ["k"], 4).collect()}
    want = {900: None}
    for g in range(3):
        xs = [r[1] for r in ROWS if r[2] == g]
        want |= {r[0]: sum(x < r[1] for x in xs) + (xs.count(r[1]) + 1) / 2 for r in ROWS if r[2] == g}
    assert got == want
