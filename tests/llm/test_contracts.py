"""Each registered query against a plain version of its contract, on whole small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import queries
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "") for r in table(spark, SF, "documents").collect()]


def hexed(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_op1(spark, docs):
    words = {d: [*re.findall("[^\x20\x09-\x0d]+", low(t)), "\n"] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in words}
    c = Counter(w for d in words if not held[d] for w in words[d])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in queries.op1_lattice_scores(spark, SF).collect()}
    assert set(got) == set(words)
    better = 0.0
    for d, r in got.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[d])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(words[d]), sum(c[w] > 0 for w in words[d]), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
        better += r.score - base if not held[d] else 0
    assert better > 0


def test_op5(spark, docs):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    grams = {}
    for r in table(spark, SF, "benchmark").collect():
        w = pattern.findall(low(r.text or ""))
        for i in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(r.item_id)
    got = {r.doc_id: r for r in queries.op5_decontaminate(spark, SF).collect()}
    lengths = {len(g) for g in grams}
    for d, t in docs:
        w = pattern.findall(low(t))
        hit, items = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in grams:
                    hit.update(range(i, i + k))
                    items |= grams[g]
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert r.items_sha256 == hexed(",".join(sorted(map(str, items))))
        assert r.n_near_items >= r.n_items


def test_op7(spark, docs):
    import base64

    import public_tokenizers as public
    import tiktoken

    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.op7_byte_bpe(spark, SF).collect()}
    for d, t in docs:
        ids = library.encode_ordinary(t)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), hexed(",".join(map(str, ids))), hexed(t))
    lengths = sorted(r.n_tokens for r in got.values())
    for r in queries.op10_token_counts(spark, SF).collect():
        assert r.docs == lengths.count(r.length)
        assert r.docs_ge == sum(x >= r.length for x in lengths)
        assert r.tokens_ge == sum(x for x in lengths if x >= r.length)
        assert r.truncated_total == sum(min(x, r.length) for x in lengths)
        assert r.quantile == pytest.approx(sum(x <= r.length for x in lengths) / len(lengths))


def test_op8(spark, docs):
    got = {r.doc_id: r for r in queries.op8_quality_rules(spark, SF).collect()}
    for d, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_op9(spark, docs):
    import xxhash

    prints = {}
    for d, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", low(t))
        grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, SF).collect()}
    assert got == {d: (f"{prints[d]:016x}", find(d)) for d in ids}


def test_op3(spark):
    convs = {-1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    for r in sorted(table(spark, SF, "conversations").collect(), key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in queries.op3_chat_format(spark, SF).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hexed("".join(f"{a}\n{t}\n" for a, t in turns)))
        assert (r.loss_chars, r.loss_sha256, r.rewrites) == (len(loss), hexed(loss), False)


def test_op6(spark):
    from html import unescape

    got = {r.page_id: r for r in queries.op6_main_text(spark, SF).collect()}
    for r in table(spark, SF, "pages").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        text = re.sub(r"<[^>]*>", "", re.sub(r"<br>|</?p>|</?h1>", " ", body))
        assert got[r.page_id].text == re.sub(r"\s+", " ", unescape(text)).strip()
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_op4_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.execute(queries.ORACLE_SQL["op4_url_filters"]).fetchall()
    got = queries.op4_url_filters(spark, SF).select("page_id", "url", "fetched_at", "blocked", "n_entries", "entry").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert 0 < sum(r.blocked for r in got) < len(got)
