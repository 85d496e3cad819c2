"""op1's scores against a plain version of the whole model, and on held-out texts."""

import math
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lm, queries
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    rows = [(r.doc_id, (r.text or "").encode().lower().split(), r.lang) for r in table(spark, SF, "documents").collect()]
    return rows, {r.doc_id: r for r in queries.op1_lattice_scores(spark, SF).collect()}


def test_every_score(spark, found):
    rows, got = found
    train = [(words, lang) for d, words, lang in rows if not lm.held_out(d)]
    sizes = Counter(lang for _, _, lang in rows if lang is not None)
    names = [g for g, _ in sorted(sizes.items(), key=lambda x: (-x[1], x[0]))[: lm.GROUPS - 1]]
    counts = [Counter() for _ in range(len(names) + 1)]
    for words, lang in train:
        counts[names.index(lang) if lang in names else -1].update([*words, b"\n"])
    whole = sum(counts, Counter())
    once, twice = (sum(c == k for c in whole.values()) for k in (1, 2))
    discount = once / (once + 2 * twice)
    vocab = lm.vocabulary()
    distinct = sorted({w for _, words, _ in rows for w in words})
    seen = [w.decode() for w in distinct if whole[w]]
    start, cont = vocab.start_prior, vocab.cont_prior
    for _ in range(lm.ROUNDS):
        s, c = lm.Lattice(vocab, start, cont).expected(seen)
        start, cont = ((u + lm.PRIOR_COUNT * p) / (u.sum() + lm.PRIOR_COUNT) for u, p in ((s, vocab.start_prior), (c, vocab.cont_prior)))
    spelled = [w.decode() for w in distinct]
    new = dict(zip(distinct, lm.Lattice(vocab, start, cont).log_probs(spelled), strict=True))
    plain = dict(zip(distinct, lm.Lattice(vocab, vocab.start_prior, vocab.cont_prior).log_probs(spelled), strict=True))
    texts = [sum((lang in names and names.index(lang) == g) or (lang not in names and g == len(names)) for _, lang in train) for g in range(len(counts))]
    for d, words, _ in rows:
        each = []
        for g, c in enumerate(counts):
            if not texts[g]:
                continue
            n, types, total = sum(c.values()), len(c), math.log(texts[g] / len(train))
            for w in [*words, b"\n"]:
                fresh = math.log(lm.END_OF_TEXT) if w == b"\n" else new[w] + math.log(1 - lm.END_OF_TEXT)
                known = max(c[w] - discount, 0) / n + discount * types / n * lm.FROM_ELSEWHERE * whole[w] / sum(whole.values())
                total += math.log(known + discount * types / n * (1 - lm.FROM_ELSEWHERE) * math.exp(fresh))
            each.append(total)
        assert got[d].score == pytest.approx(np.logaddexp.reduce(each) / math.log(10), rel=1e-5)
        lattice = sum(plain[w] + math.log(1 - lm.END_OF_TEXT) for w in words) + math.log(lm.END_OF_TEXT)
        assert got[d].lattice_score == pytest.approx(lattice / math.log(10), rel=1e-5)


def test_held_out_texts(found):
    _, got = found
    held = [r for r in got.values() if r.held_out]
    assert len(held) > 10 and sum(r.score for r in held) > sum(r.lattice_score for r in held)
