"""Lookups, margins and pair tests against plain Python."""

import hashlib
import itertools
import math

from tessera.operators import lookups as L


def test_members(spark):
    e, p = spark.createDataFrame([(i,) for i in range(4)], "id int"), spark.createDataFrame([(1, 9), (2, 9)], "id int, whole int")
    got = {m: sorted(tuple(r) for r in L.members(e, p, m).collect()) for m in ("self", "collapse", "exclude")}
    assert got == {"self": [(i, i) for i in range(4)], "collapse": [(0, 0), (1, 9), (2, 9), (3, 3)], "exclude": [(0, 0), (3, 3)]}


def test_missing_members_only_in_groups_with_others(spark):
    e = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "id int, g string")
    here = spark.createDataFrame([(1,), (1,)], "id int")
    assert [tuple(r) for r in L.missing_members(e, here, "g").collect()] == [(2, "x")]


def test_value_quantiles_keep_equal_values_together(spark):
    df = spark.createDataFrame([(i, min(i, 3)) for i in range(20)], "id int, v int")
    bins = {}
    for r in L.value_quantiles(df, "v", 4).collect():
        bins.setdefault(r.v, set()).add(r.bin)
    assert all(len(b) == 1 for b in bins.values())


def test_margins(spark):
    pts = [(0, [0.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [9.0, 0.0], 2), (3, [4.0, 3.0], 3)]
    got = {r.id: (r.near, r.d, r.margin) for r in L.centre_margins(spark.createDataFrame(pts, "id int, v array<double>, label int"), "v", "label").collect()}
    centres = {1: (1.0, 0.0), 2: (9.0, 0.0), 3: (4.0, 3.0)}
    for i, v, _ in pts:
        near = sorted((math.dist(v, c), k) for k, c in centres.items())
        assert got[i][0] == near[0][1] and math.isclose(got[i][2], near[1][0] - near[0][0])


def test_mantel(spark):
    ids = list(range(6))
    x = {(a, b): float((a * 7 + b * 3) % 11) for a, b in itertools.combinations(ids, 2)}
    y = {k: v + k[0] for k, v in x.items()}

    def corr(u, v):
        mu, mv = sum(u) / len(u), sum(v) / len(v)
        return sum((a - mu) * (b - mv) for a, b in zip(u, v, strict=True)) / math.sqrt(sum((a - mu) ** 2 for a in u) * sum((b - mv) ** 2 for b in v))

    def at(to):
        return corr(list(x.values()), [y[tuple(sorted((to[a], to[b])))] for a, b in x])

    first = at({i: i for i in ids})
    null = [at(dict(zip(sorted(ids, key=lambda i: (hashlib.md5(f"{r}:{i}".encode()).hexdigest(), i)), ids, strict=True))) for r in range(1, 10)]
    frames = [spark.createDataFrame([(a, b, d) for (a, b), d in t.items()], "a int, b int, d double") for t in (x, y)]
    got = L.mantel(*frames, spark.createDataFrame([(i,) for i in ids], "id int"), 9).first()
    assert math.isclose(got.r, first, abs_tol=1e-8) and math.isclose(got.p, (1 + sum(c >= first - 1e-9 for c in null)) / 10)


def test_best_lag_prefers_small_then_positive(spark):
    df = spark.createDataFrame([("x", -1, 0.5), ("x", 1, 0.5), ("x", 2, 0.4), ("y", 0, 0.1), ("y", 2, 0.1)], "id string, lag int, r double")
    assert {r.id: r.lag for r in L.best_lag(df, ["id"], "lag", "r", 2).collect()} == {"x": 1, "y": 0}
