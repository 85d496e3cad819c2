import random

from tessera.llm import spans


def brute(rows):
    """Every run of every document against all, by plain text."""
    seen, starts = {}, {}
    docs = sorted({(d, t) for d, t in rows})
    for d, t in docs:
        parts = [" ".join(p.lower().split()) for p in spans.pieces(t or "")]
        parts = [p for p in parts if p]

        def fits(i, j, parts=parts):
            return j - i >= spans.RUN and sum(len(p.split(" ")) for p in parts[i:j]) >= spans.LEAST_WORDS

        for i in range(len(parts)):
            for j in range(i + 1, min(len(parts), i + spans.STRIDE) + 1):
                if fits(i, j) and not (fits(i, j - 1) and fits(i + 1, j)):
                    seen.setdefault(tuple(parts[i:j]), []).append((d, t, i * spans.STRIDE + j - i))
    for places in seen.values():
        for d, t, k in sorted(places)[1:]:
            starts.setdefault((d, t), set()).add(k)
    return {(d, t): spans.without_repeats(t or "", sorted(starts.get((d, t), ())))[0] for d, t in docs}


def test_pieces_concatenate_to_the_text():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice(["a ", "bc", ". ", "!", "?\n", "\n\n", " ", "é", "word " * 20, "。"]) for _ in range(rng.randint(0, 30)))
        assert "".join(spans.pieces(text)) == text


def test_removal_matches_brute_force(spark):
    rng = random.Random(4)
    lines = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(rng.randint(1, 9))) + "." for _ in range(40)]
    rows = [(i, " ".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    passage = " ".join(f"w{i}" for i in range(70))
    rows += [(100, f"One first text here. {passage}. End."), (101, f"Other start of text.\n{passage}. Other end."), (102, ""), (101, f"Other start of text.\n{passage}. Other end.")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kind string")
    got = spans.remove_repeats(df).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    by_id = {}
    for d, t in rows:
        by_id.setdefault(d, []).append(want[(d, t)])
    for r in got:
        assert r.text in by_id[r.doc_id]
    assert "w30" not in next(r.text for r in got if r.doc_id == 101)
    assert "w30" in next(r.text for r in got if r.doc_id == 100)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, None), (1, None), (None, "a b c. " * 6), (2, "")], "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in spans.remove_repeats(df).collect()}
    assert (1, None) in got and (None, None) in got and len(got) == 4
    assert spans.remove_repeats(df.limit(0)).count() == 0
