"""A test set searched in many blocks, long items and string ids give the rows of one search."""

import random

from tessera.llm import decontam


def test_blocks_give_the_same_rows(spark):
    rng = random.Random(31)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 9, 10, 11, 40, 400])))) for i in range(30)]
    items += [(None, "w1 w2 w3"), (99, None)]
    docs = []
    for d in range(60):
        text = rng.choices(words, k=rng.randint(0, 50))
        for _ in range(rng.randint(0, 3)):
            own = items[rng.randrange(30)][1].split()
            at = rng.randint(0, max(0, len(own) - 12))
            place = rng.randint(0, len(text))
            text[place:place] = own[at : at + rng.randint(8, 25)]
        docs.append((d, " ".join(text)))
    docs += [(60, None), (61, docs[3][1]), (3, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    index = decontam.build_index(df, shard_bytes=2000)

    def rows(found):
        return sorted((r.doc_id, r.n_words, r.n_hit, sorted(map(str, r["items"])), sorted(map(str, r.near_items))) for r in found.collect())

    want = rows(decontam.search(index, tests))
    assert len(want) == len(docs) and sum(bool(r[2]) for r in want) > 20
    assert rows(decontam.search(index, tests, block_bytes=400)) == want
    named = tests.selectExpr("cast(item_id as string) item_id", "text")
    assert rows(decontam.search(index, named)) == want
    by_name = decontam.build_index(df.selectExpr("concat('d', doc_id) doc_id", "text"), shard_bytes=2000)
    assert sorted((int(r[0][1:]), *r[1:]) for r in rows(decontam.search(by_name, named, block_bytes=400))) == want


def test_segments_hold_every_window(spark):
    text = " ".join(f"w{i}" for i in range(500))
    df = spark.createDataFrame([("a", text), ("b", "x y"), ("c", "")], "item_id string, text string")
    parts = decontam.segments(df, 10, 64).collect()
    windows = {tuple(p.words.split()[i : i + 10]) for p in parts if p.item_id == "a" for i in range(max(1, len(p.words.split()) - 9))}
    own = text.encode().split()
    assert windows == {tuple(own[i : i + 10]) for i in range(491)} and [bytes(p.words) for p in parts if p.item_id != "a"] == [b"x y"]
