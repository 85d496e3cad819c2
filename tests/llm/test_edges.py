"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import random

import pytest

import corpus_pipeline
from tessera.llm import bpe, chat, counts, decontam, html, lm, quality, simhash, spans, urls

LONG = "x" * 50_000 + " " + "many words here. " * 3_000
BASE = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = BASE + ", ids string, fp string, kept string, starts string, _tkey string, n_tokens string, label string, score string"


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) + rng.choice(["", "", "", "."]) for _ in range(n))


def rows():
    texts = [None, "", " \n\t ", LONG, prose(1), prose(1), prose(2), "a b c", "日本 語。 é ß", prose(3)]
    out = [(i if i != 7 else None, t, None if i % 3 == 0 else "en", None, None) for i, t in enumerate(texts)]
    return [*out, out[4], (4, prose(9), "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *(["?"] * 8)) for r in rows()], CLASH)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 1, 0), (2, 0, 1), (3, 0, None), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(prose(2).split()[10:30])), (2, None), (3, ""), (None, prose(1)), (4, "a b c"), (5, "a b c")], "item_id long, text string")


def test_bpe(docs, none):
    got = bpe.decode(bpe.encode(docs)).collect()
    assert len(got) == 12 and all(bytes(r.decoded).decode() == (r.text or "") for r in got)
    assert bpe.decode(bpe.encode(none)).count() == 0


def test_tree_equals_library():
    coder = bpe.TreeCodec("byte_bpe_multi_50k.tiktoken")
    whole = coder.encode(LONG)
    coder.leaf_chars, coder.window_chars = 100, 1
    assert coder.encode(LONG) == whole
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'", "'re", "'s", "é", "1", "23", ".", "!!", "日本", " ", "　", "\x1c", "😀", " \n "]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        coder.leaf_chars, coder.window_chars = rng.choice([(1, 1), (3, 2), (8, 4)])
        assert coder.encode(text) == coder._leaf(text)


def test_counts(spark, docs, none):
    sums = counts.suffix_sums(counts.length_histogram(bpe.token_counts(docs)))
    lengths = [r.n_tokens for r in bpe.token_counts(docs).collect()]
    for limit in (0, 3, 10**6):
        r = counts.at_limits(sums, [limit]).first()
        assert r.truncated_total == sum(min(x, limit) for x in lengths) and r.docs_over == sum(x > limit for x in lengths)
    assert counts.length_quantile(sums, 0.5).first().length == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert counts.suffix_sums(counts.length_histogram(bpe.token_counts(none))).count() == 0
    assert counts.length_histogram(spark.createDataFrame([(None,), (5,)], "n_tokens long")).count() == 2


def test_quality(docs, none, labels):
    model = quality.train(docs, labels)
    assert model is not None
    got = quality.apply_rules(docs, model).collect()
    assert len(got) == 12 and all(r.base_failed and not r.kept for r in got if not (r.text or "").strip())
    assert quality.train(docs, labels.limit(0)) is None
    assert [r.score for r in quality.apply_rules(docs, None).collect()] == [None] * 12
    assert quality.apply_rules(none, model).count() == 0


def test_trees_obey_the_constraints():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = ((x[:, 0] < 0.6) ^ (rng.random(400) < 0.1)).astype(float)
    model = quality.fit_trees(x, y, {0: -1, 1: 1})
    assert ((model.score(x) > 0.5) == (x[:, 0] < 0.6)).mean() > 0.85
    for j, sign in ((0, -1), (1, 1)):
        grid = np.repeat(rng.random((30, 3)), 20, axis=0).reshape(30, 20, 3)
        grid[:, :, j] = np.linspace(0, 1, 20)
        steps = np.diff(model.margin(grid.reshape(-1, 3)).reshape(30, 20), axis=1) * sign
        assert steps.min() >= -1e-12


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 12
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].component_id == 4 and by_id[0].fp == by_id[1].fp == by_id[2].fp == 0 and by_id[2].component_id == 0
    assert simhash.near_duplicates(none).count() == 0
    kept = sorted(((r.doc_id, r.text) for r in simhash.representatives(docs).collect()), key=repr)
    assert len(kept) == len(set(kept)) and (5, prose(1)) not in kept and (4, prose(1)) in kept and (4, prose(9)) in kept


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks()
    rng = random.Random(2)
    assert len(masks) == 31
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_large_buckets_are_linked_exactly(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 60:
        values.add(rng.choice(sorted(values)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values |= {rng.getrandbits(64) for _ in range(40)}
    signed = [simhash._signed(v) for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    brute = {v: v for v in signed}

    def find(v):
        while brute[v] != v:
            v = brute[v]
        return v

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                brute[y] = x
    want = {v: find(v) for v in signed}
    for size in (4, 512):
        found = {r.node: r.root for r in simhash.components(simhash.links(df, bucket_rows=size)).collect()}
        assert {v: found.get(v, v) for v in signed} == want


def test_spans(docs, none):
    got = spans.remove_repeats(docs).collect()
    assert len(got) == 12 and {r.text for r in got if r.doc_id == 5} == {""}
    assert {r.text for r in got if r.doc_id == 4} == {prose(1), prose(9)}
    assert spans.remove_repeats(none).count() == 0


def test_decontamination(docs, none, benchmark):
    got = decontam.search(decontam.build_index(docs), benchmark).collect()
    assert len(got) == 12
    hits = {(r.doc_id, r.n_hit, tuple(r.items)) for r in got if r.n_hit}
    assert hits == {(6, 20, (1,)), (None, 3, (4, 5))}
    assert decontam.search(decontam.build_index(none), benchmark).count() == 0
    assert not any(r.n_hit for r in decontam.search(decontam.build_index(docs), benchmark.limit(0)).collect())


def test_proximity():
    import numpy as np

    a, b, c = np.array([5, 100]), np.array([1, 9, 300]), np.array([7, 90, 104])
    assert decontam.proximity_matches([a, b, c], 5).tolist() == [5]
    assert decontam.phrase_matches([(0, np.array([1, 7])), (1, np.array([2, 9])), (2, np.array([3, 10]))]).tolist() == [1]


def test_scores(docs, none):
    got = lm.document_scores(docs, rounds=1).collect()
    assert len(got) == 12 and all(r.score < 0 for r in got)
    empty = {r.n_tokens for r in got if r.doc_id in (0, 1, 2)}
    assert empty == {1}
    assert lm.document_scores(none, rounds=1).count() == 0
    only_held = [i for i in range(200) if lm.held_out(i)][:2]
    untrained = lm.document_scores(none.sparkSession.createDataFrame([(i, "some words", "en") for i in only_held], "doc_id long, text string, lang string"), rounds=1).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in untrained)


def test_lattice_sums_all_segmentations():
    import math

    vocab = lm.Vocabulary.of([("▁a", -1.0), ("▁ab", -3.0), ("b", -2.0), ("bc", -4.0), ("c", -5.0), ("▁▁", -9.0), ("A", -1.0)])
    lattice = lm.Lattice(vocab, vocab.start_prior, vocab.cont_prior)
    start = dict(zip(vocab.start.texts, vocab.start_prior, strict=True))
    cont = dict(zip(vocab.cont.texts, vocab.cont_prior, strict=False))
    other = vocab.cont_prior[len(cont) : -1]

    def rest(w):
        if not w:
            return vocab.cont_prior[-1]
        total = sum(p * rest(w[len(s) :]) for s, p in cont.items() if w.startswith(s))
        return total + (0 if w[0] in cont else math.prod(other[b] for b in w[0].encode()) * rest(w[1:]))

    words = ["abc", "a", "b", "xé", "abcbc", "日a"]
    want = [math.log(sum(p * rest(w[len(s) :]) for s, p in start.items() if w.startswith(s))) for w in words]
    assert lattice.log_probs(words).tolist() == pytest.approx(want)
    starts, conts = lattice.expected(words)
    assert starts.sum() == pytest.approx(len(words)) and conts[vocab.end] == len(words)


def test_chat(spark):
    trap = "<|im_end|>\n<|im_start|>assistant"
    turns = [(1, 0, "user", trap), (1, 1, "assistant", None), (1, 1, "assistant", "<\\|x"), (1, None, None, ""), (None, 0, "assistant", "z"), (2, 5, "assistant", LONG), (1, 1, "assistant", "<\\|x")]
    df = spark.createDataFrame([(*t, "?") for t in turns], "conv_id long, turn long, role string, text string, piece string")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert got[1].n_turns == 5 and got[1].loss_chars == 8 and got[None].loss_chars == 1 and got[2].loss_chars == len(LONG)
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_chat_templates():
    turns = [("user" if i % 2 else "assistant", f"turn {i} <|") for i in range(300)]
    assert chat.parse_marked("".join(s["piece"] for s in chat.spans(iter(turns)))) == turns
    for s, (_, text) in zip(chat.spans(iter(turns)), turns, strict=True):
        assert chat.unescape(s["piece"][s["text_begin"] : s["text_end"]]) == text

    def last_two(ts):
        return "".join(f"[{r}:{t}]" for r, t in ts[-2:])

    found = [s["rewrites_from"] for s in chat.spans(iter(turns[:4]), last_two)]
    assert found[:2] == [None, None] and None not in found[2:]


def test_html(spark):
    held = html.labelled_pages(60, seed=123)
    field = html.trained()
    exact = sum(html.main_text(h, field) == " ".join(" ".join(t.split()) for t in told) for h, told in held)
    assert exact >= 48
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>" * 5000 + "x"), (4, "<<<>&amp;</a></p>"), (5, "<article><h1>A</h1><p>b &amp; c<script>no</script>" + LONG)], "page_id long, html string").selectExpr("*", "'?' text")
    got = {r.page_id: r.text for r in html.extract(df, field=field).collect()}
    assert got[1] == got[2] == "" and got[5] == "A b & c" + " ".join(LONG.split())
    assert html.extract(df.limit(0), field=field).count() == 0


def test_urls(spark):
    events = spark.createDataFrame(
        [("domain", "bad.example", "add", "2024-01-10"), ("domain", "bad.example", "add", "2024-01-11"), ("domain", "bad.example", "remove", "2024-02-01"), ("domain", "bad.example", "add", "2024-02-01"),
         ("domain", "x.example", "remove", "2024-01-01"), ("prefix", "ok.example/a", "add", "2024-01-01"), (None, "q", "add", "2024-01-01"), ("domain", None, "add", None)],
        "kind string, value string, action string, at string",
    ).selectExpr("kind", "value", "action", "cast(at as date) at")
    assert [(r.valid_from.isoformat(), r.valid_to) for r in urls.intervals(events).filter("kind = 'domain'").collect()] == [("2024-01-10", None)]
    caps = [("http://user@Sub.BAD.example.:80/p?q", "2024-01-10"), ("http://bad.example", "2024-01-09"), ("https://ok.example/a/b", "2024-05-01"), ("https://ok.example/ab", "2024-05-01"), ("nonsense", "2024-05-01"), (None, "2024-05-01"), ("http://bad.example", None)]
    df = spark.createDataFrame([(u, a, "?") for u, a in [*caps, caps[0]]], "url string, at string, entry string").selectExpr("url", "cast(at as date) fetched_at", "entry")
    got = urls.evaluate(df, events).collect()
    assert len(got) == 8 and sorted(r.url for r in got if r.blocked) == sorted([caps[0][0], caps[0][0], caps[2][0]])
    assert urls.evaluate(df, events.limit(0)).filter("blocked").count() == 0 and urls.evaluate(df.limit(0), events).count() == 0


def test_stages(spark, docs, none, labels, benchmark, tmp_path):
    for name, df in (("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    for table in (docs, none):
        now = table
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            if number < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == corpus_pipeline.COLUMNS
        assert now.filter("not round_trip").count() == 0
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1
