"""Shared passages of 50 words, found whatever stands around them, against plain 50-grams."""

import random

from tessera.llm import spans

N = 50


def found(a, b):
    """Words (by place) of ``b`` inside a run that ``a`` has too."""
    parts = spans.pieces(b)
    mine = set(spans.runs(spans.pieces(a))[1])
    index = [i for i, p in enumerate(parts) if p.strip()]
    gone = set()
    for place, digest in zip(*spans.runs(parts), strict=True):
        if digest in mine:
            gone |= {index[k] for k in range(place // spans.STRIDE, place // spans.STRIDE + place % spans.STRIDE)}
    return "".join(p for i, p in enumerate(parts) if i in gone).split()


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + N]) for i in range(len(w) - N + 1)}


def words(rng, n, marks=0.0):
    return [f"w{rng.randrange(3000)}" + ("." if rng.random() < marks else "") for _ in range(n)]


def test_every_passage_of_fifty_words_shares_a_run():
    rng = random.Random(8)
    for k in range(1500):
        passage = words(rng, rng.randint(N, 60), rng.choice([0, 0, 0.05, 0.1, 0.3]))
        a, b = (" ".join(words(rng, rng.randint(0, 40)) + passage + words(rng, rng.randint(0, 40))) for _ in "ab")
        assert grams(a) & grams(b)
        assert len(found(a, b)) >= 20, k


def test_texts_without_fifty_common_words_or_a_run_stay():
    rng = random.Random(9)
    for _ in range(200):
        a, b = " ".join(words(rng, 120)), " ".join(words(rng, 120))
        assert not grams(a) & grams(b) and not found(a, b)


def test_text_without_blanks():
    rng = random.Random(10)
    han = [chr(c) for c in range(0x4E00, 0x5E00)]
    repeated = "".join("".join(rng.choices(han, k=19)) + "。" for _ in range(15))
    other = "".join("".join(rng.choices(han, k=19)) + "。" for _ in range(15))
    assert len(repeated) == 300 and "".join(found(other + repeated, repeated)) == repeated
    assert not found(other, repeated)
    plain = "".join(rng.choices(han, k=100))
    assert len("".join(found("".join(rng.choices(han, k=33)) + plain, "".join(rng.choices(han, k=21)) + plain))) >= 40


def test_any_white_space_parts_words():
    rng = random.Random(11)
    for blank in ("\t", " ", "  "):
        text = blank.join(words(rng, 300))
        assert len(spans.pieces(text)) > 30 and "".join(spans.pieces(text)) == text
        assert len(found(text, text)) == 300


def test_repeated_chinese_sentences_are_removed(spark):
    rng = random.Random(12)
    text = "".join("".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(19)) + "。" for _ in range(15))
    df = spark.createDataFrame([(1, text), (2, text + "完。")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in spans.remove_repeats(df).collect()} == {1: text, 2: "完。"}
