"""Exact occurrences of windows that are wider than the proximity search reaches."""

from tessera.llm import decontam


def test_exact_phrase_beyond_the_slop(spark):
    passage = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(30))
    docs = spark.createDataFrame([(1, f"before that {passage} and after"), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r.items), list(r.near_items)) for r in decontam.search(decontam.build_index(docs), items, window=30, slop=20).collect()}
    assert got == {1: (30, [7], []), 2: (0, [], [])}
