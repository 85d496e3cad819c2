"""Runs of whole sentences of any length, against plain Python that cuts texts on its own."""

import random
import re

from pyspark.sql import functions as F

from tessera.llm import spans
from tessera.llm.common import spread_join


def sentences(text):
    return [s for s in re.findall(r"[^.]+\.", text) if s.strip()]


def brute(rows):
    """What is left of each text: every run of three sentences but its first occurrence goes."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        parts = sentences(text)
        gone = set()
        for i in range(len(parts) - 2):
            run = tuple(" ".join(p.lower().split()) for p in parts[i : i + 3])
            if run in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(run)
        out[doc] = "".join(p for i, p in enumerate(parts) if i not in gone).split()
    return out


def test_every_run_of_three_short_sentences(spark):
    rng = random.Random(21)
    lines = [" ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(rng.randint(1, 4))).capitalize() + "." for _ in range(25)]
    rows = [(i, " ".join(rng.choice(lines) for _ in range(rng.randint(0, 15)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text.split() for r in spans.remove_repeats(df, sentences=True).collect()}
    want = brute(rows)
    assert got == want and sum(map(len, want.values())) < sum(len(t.split()) for _, t in rows)


def test_three_short_sentences_and_two(spark):
    rows = [(1, "Be. On it. By me. One."), (2, "Two. Be. On it. By me."), (3, "Be. On it. Three.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.remove_repeats(df, sentences=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("Two.", 3), 3: (rows[2][1], 0)}


def test_sentence_without_a_stop_is_one_sentence():
    text = " ".join(f"w{i}" for i in range(24))
    parts, firsts = spans.cut_text(text)
    assert len(firsts) == 1 and len(spans.sentence_groups(parts, firsts)) == 1
    assert all(p >= 0 for p in spans.sentence_runs(parts, firsts)[0])


def test_fifty_shared_words_are_found_anywhere():
    rng = random.Random(22)

    def words(n, marks):
        return [f"w{rng.randrange(3000)}" + ("." if rng.random() < marks else "") for _ in range(n)]

    for k in range(1500):
        passage = words(rng.randint(50, 60), rng.choice([0, 0, 0.05, 0.1, 0.3, 0.6]))
        a, b = (" ".join(words(rng.randint(0, 40), 0.1) + passage + words(rng.randint(0, 40), 0.1)) for _ in "ab")
        mine = set(spans.sentence_runs(*spans.cut_text(a))[1])
        parts, firsts = spans.cut_text(b)
        places = sorted(p for p, d in zip(*spans.sentence_runs(parts, firsts), strict=True) if d in mine)
        left = spans.without_repeats(b, places)[0].split()
        assert len(b.split()) - len(left) >= 20, k


def test_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame(
        [(None, None, 1, 2, 3, 4, 5, 6), (1, "", 1, 2, 3, 4, 5, 6), (None, "A b. C d. E f.", 1, 2, 3, 4, 5, 6), (2, "A b. C d. E f.", 1, 2, 3, 4, 5, 6)],
        "doc_id long, text string, starts int, _tkey int, _d int, _k int, _starts int, n_removed int",
    )
    got = spans.remove_repeats(df, sentences=True)
    assert got.columns == ["doc_id", "text", "starts", "_tkey", "_d", "_k", "_starts", "n_pieces", "n_removed"]
    rows = got.collect()
    assert all((r.starts, r._tkey, r._d, r._k, r._starts) == (1, 2, 3, 4, 5) for r in rows)
    assert {(r.doc_id, r.text) for r in rows} == {(None, None), (1, ""), (None, "A b. C d. E f."), (2, "")}


def test_hot_keys_meet_all_their_rows(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id").cache()
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).filter("k % 2 = 0").cache()
    got = spread_join(rows, keys, ["k"], "id", hot_rows=100)
    want = rows.join(keys.drop("n"), "k")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
