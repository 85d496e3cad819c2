"""Any radius, linked exactly, and callers' columns."""

import random

import pytest

from tessera.llm import quality, simhash


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_large_buckets_of_any_radius(spark, radius):
    rng = random.Random(radius)
    values = {rng.getrandbits(64)}
    while len(values) < 50:
        v = rng.choice(sorted(values))
        for b in rng.sample(range(64), rng.choice([radius, radius, radius + 1])):
            v ^= 1 << b
        values.add(v)
    signed = [simhash._signed(v) for v in values]
    brute = {v: v for v in signed}

    def find(v):
        while brute[v] != v:
            v = brute[v]
        return v

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                brute[y] = x
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for size in (3, 512):
        found = {r.node: r.root for r in simhash.components(simhash.links(df, radius, bucket_rows=size)).collect()}
        assert {v: found.get(v, v) for v in signed} == {v: find(v) for v in signed}


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e", 7, 8, 9, 6), (2, "a b c d e", 7, 8, 9, 6), (3, "q", 7, 8, 9, 6)], "doc_id long, text string, _tkey int, _keep int, _kept int, fp int")
    got = simhash.representatives(df)
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == [(1, "a b c d e", 7, 8, 9, 6), (3, "q", 7, 8, 9, 6)]


def test_repeated_ids_give_one_labelled_row(spark):
    docs = spark.createDataFrame([(d, f"text {d % 3} {k} here") for d in range(6) for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q) for d in range(6) for q in (d % 2, 1)], "doc_id long, quality int")
    assert quality.train(docs, labels) is not None
