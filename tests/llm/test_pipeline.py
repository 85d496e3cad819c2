"""The pipeline's rows against plain Python, stage by stage, on a whole small table."""

import base64
import re

import numpy as np
import public_tokenizers
import tiktoken
from test_spans import brute

import corpus_pipeline
from tessera.llm import quality, simhash
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def kept_by_rules(spark, docs):
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))

    def score(x):
        total = model.base
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if x[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        return 1 / (1 + np.exp(-total))

    out = []
    for d, t in docs:
        (n, _, _, _, repeated), x = quality.statistics(t)
        if n >= 50 and 100 * repeated <= 50 * n and score(x) >= model.cut:
            out.append((d, t))
    return out


def one_of_each_group(docs):
    prints = [simhash.fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                group[b] = a
    return [docs[i] for i in range(len(docs)) if find(i) == i]


def clean_of_benchmark(spark, docs):
    def words(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    grams = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r.text)
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(g) for g in grams}
    return [(d, t) for d, t in docs if not any(tuple(w[i : i + k]) in grams for w in [words(t)] for k in sizes for i in range(len(w) - k + 1))]


def test_pipeline(spark):
    docs = sorted((r.doc_id, r.text or "") for r in table(spark, SF, "documents").collect())
    docs = one_of_each_group(kept_by_rules(spark, docs))
    after = brute(docs)
    docs = [(d, after[(d, t)]) for d, t in docs if after[(d, t)] or not t]
    docs = clean_of_benchmark(spark, docs)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {d: library.encode_ordinary(t) for d, t in docs}
    got = corpus_pipeline.run(spark, SF).collect()
    assert all(r.round_trip for r in got)
    assert {r.doc_id: list(r.ids) for r in got} == want
