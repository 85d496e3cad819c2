"""Events of components, changes up to a renaming, and closed sets."""

from itertools import combinations

from tessera.operators import tracking as T
from tessera.plans import registry
from tessera.plans.inputs import customers

SF = "/root/testdata/sf0.001"


def test_a_chain_of_links_is_one_event(spark):
    links = [(1, 1, 0.5), (2, 1, 0.5), (2, 2, 0.5), (3, 3, 0.9), (4, 4, 0.5), (4, 5, 0.4), (5, 6, 0.5), (6, 6, 0.4), (7, 7, 0.1)]
    matrix = spark.createDataFrame(links, "x long, y long, jaccard double")
    got = {(r.side, r.label): r.event for r in T.cluster_events(matrix, 0.3).collect()}
    want = {**dict.fromkeys([("old", 1), ("old", 2), ("new", 1), ("new", 2)], "reorganise"), ("old", 3): "survive", ("new", 3): "survive"}
    want |= dict.fromkeys([("old", 4), ("new", 4), ("new", 5)], "split") | dict.fromkeys([("old", 5), ("old", 6), ("new", 6)], "merge")
    assert got == want | {("old", 7): "disappear", ("new", 7): "emerge"}


def test_renamed_labels_are_no_change(spark):
    rows = [(0, i, i % 3) for i in range(12)] + [(1, i, (i + 1) % 3) for i in range(12)] + [(2, i, (i + 1) % 3 if i else 2) for i in range(12)]
    df = spark.createDataFrame(rows, "win int, id long, label long")
    assert {r.win: (r.n, round(r.changed, 6)) for r in T.share_changed(df).collect()} == {1: (12, 0.0), 2: (12, round(1 / 12, 6))}


def test_closed_sets(spark):
    baskets = []
    for r in customers(spark, SF).collect():
        traits = [r.seg, "rich" if r.bal > 5000 else None, "busy" if r.n_orders > 10 else None, "idle" if r.n_orders == 0 else None]
        baskets.append(frozenset(t for t in traits if t))
    support = {}
    for b in baskets:
        for k in range(1, len(b) + 1):
            for s in combinations(sorted(b), k):
                support[s] = support.get(s, 0) + 1
    frequent = {s: n for s, n in support.items() if n >= 0.05 * len(baskets)}
    closed = {";".join(s): n for s, n in frequent.items() if not any(set(s) < set(o) and m == n for o, m in frequent.items())}
    assert {r["items"]: r.n for r in registry.QUERIES["closed_itemsets"](spark, SF).collect()} == closed
