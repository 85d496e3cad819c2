"""Language-model scoring by subword lattice likelihood.

A document is a sequence of words and one end token.  A word seen in training
keeps most of its relative frequency; the rest of the mass is shared by all
possible words through a subword lattice: the pieces of an existing vocabulary
span every segmentation of the word, and a forward recursion in log space sums
their weights into the word's marginal probability.  Frequencies are kept apart
for a few groups of documents (the largest languages; all others together), and
a document's probability is the sum over groups of the group's share times the
document's probability in it: the group of a scored document is not looked at.  The pieces are never
trained anew; the weights the vocabulary file gives them are the prior, and
expectation-maximisation over all distinct training words sharpens them.

Layout: texts are read once, by chunks.  A chunk lists its distinct words by
bucket of their hash, and its documents as numbers into that list.  A bucket
gathers one entry per chunk and word, however often the word occurs, sums the
training counts, scores each distinct word once, and answers every chunk.
Nothing that grows with the corpus is broadcast or collected: the driver sees
four totals and one weight per vocabulary piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import planes, shuffle_width, stored, text_bytes, unplanes

VOCABULARY = "piece_bpe_32k.model"
#: Documents with crc32(id) % FOLDS == HELD_OUT are not learned from.
FOLDS, HELD_OUT = 7, 2
#: Bytes of text and documents of a chunk; bytes of input for each bucket.
CHUNK_BYTES, CHUNK_DOCS, BUCKET_BYTES = 6 << 20, 8192, 12 << 20
#: Rounds of expectation-maximisation over the training words.
ROUNDS = 2
#: Prior share of ends of a word among continuations, and of the end token among tokens.
END_OF_WORD, END_OF_TEXT = 0.3, 0.02
#: Most groups with frequencies of their own, and how much of a group's spare mass goes to
#: words known from elsewhere.
GROUPS, FROM_ELSEWHERE = 8, 0.1
#: Pseudo-counts that the vocabulary's own weights stand for.
PRIOR_COUNT = 2000.0

_MULTIPLIER = np.uint64(1000003)
_CELLS = 150_000


def _hash_codes(codes: np.ndarray) -> int:
    h = 0
    for c in codes:
        h = (h * 1000003 + int(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass
class PieceTable:
    """Pieces of one kind by the hash of their text."""

    texts: list[str]
    hashes: np.ndarray = field(init=False)
    order: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self):
        raw = np.array([_hash_codes([ord(c) for c in t]) for t in self.texts], np.uint64)
        if len(set(raw.tolist())) != len(raw):
            raise ValueError("two pieces share a hash")
        self.order = np.argsort(raw)
        self.hashes = raw[self.order]
        self.longest = max(map(len, self.texts), default=0)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers; -1 where there is no such piece."""
        if not len(self.hashes):
            return np.full(hashes.shape, -1)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


@dataclass
class Vocabulary:
    """Start pieces (of a word's head, the empty one included) and continuations.

    Continuations are numbered: pieces, then 256 bytes for characters that no
    piece covers, then the end of the word.
    """

    start: PieceTable
    cont: PieceTable
    start_prior: np.ndarray
    cont_prior: np.ndarray

    @property
    def end(self) -> int:
        return len(self.cont.texts) + 256

    @classmethod
    def of(cls, scored: list[tuple[str, float]]) -> Vocabulary:
        """From pieces marked with U+2581 at a word's head, and their scores.

        Pieces with A-Z or an inner mark never match a lower-cased word.  A
        score is a rank below zero; its weight falls as one over the rank.
        """
        start, cont = {"": 1.0}, {}
        for text, score in scored:
            body = text[1:] if text.startswith("▁") else text
            if "▁" in body or not body or any("A" <= c <= "Z" for c in body):
                continue
            (start if text.startswith("▁") else cont)[body] = 1.0 / (2.0 + abs(score))
        least = min(cont.values(), default=1e-6)
        weights = np.array([*cont.values(), *[least] * 256])
        weights *= (1 - END_OF_WORD) / weights.sum()
        heads = np.array(list(start.values()))
        return cls(PieceTable(list(start)), PieceTable(list(cont)), heads / heads.sum(), np.append(weights, END_OF_WORD))


@lru_cache(maxsize=2)
def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    """The pieces of a public sentencepiece file."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=name if "/" in name else public_tokenizers.path(name))
    return Vocabulary.of(
        [
            (model.id_to_piece(i), model.get_score(i))
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
    )


class Lattice:
    """Marginal log probabilities (natural log) of words under piece weights."""

    def __init__(self, vocab: Vocabulary, start: np.ndarray, cont: np.ndarray):
        self.vocab = vocab
        with np.errstate(divide="ignore"):
            self.start = np.append(np.log(start), -np.inf)
            self.cont = np.append(np.log(cont), -np.inf)
        self.bytes_at = len(vocab.cont.texts)

    def log_probs(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for rows, arcs in self._batches(words):
            out[rows] = self._forward(arcs)[:, -1] + self.cont[self.vocab.end]
        return out

    def expected(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of each start piece and continuation over ``words``."""
        starts, conts = np.zeros(len(self.start) - 1), np.zeros(len(self.cont) - 1)
        for _, arcs in self._batches(words):
            self._posteriors(arcs, starts, conts)
        return starts, conts

    def _batches(self, words: list[str]):
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, rows in by_length.items():
            step = max(1, _CELLS // max(1, length))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                data = "".join([words[i] for i in some]).encode("utf-32-le")
                yield some, self._arcs(np.frombuffer(data, np.uint32).reshape(len(some), length))

    def _arcs(self, codes: np.ndarray) -> dict:
        """Weights and numbers of all arcs by their length."""
        size, length = codes.shape
        heads = {0: self.vocab.start.find(np.zeros(1, np.uint64))}
        numbers, weights = {}, {}
        h = np.zeros((size, length), np.uint64)
        add = codes.astype(np.uint64) + np.uint64(1)
        most = max(self.vocab.start.longest, self.vocab.cont.longest, 1)
        for k in range(1, min(most, length) + 1):
            h = h[:, : length - k + 1] * _MULTIPLIER + add[:, k - 1 :]
            if k <= self.vocab.start.longest:
                heads[k] = self.vocab.start.find(h[:, 0])
            if k <= max(1, self.vocab.cont.longest):
                found = self.vocab.cont.find(h)
                if k == 1 or (found >= 0).any():
                    numbers[k], weights[k] = found, self.cont[found]
        if length:
            bare = numbers[1] < 0
            if bare.any():
                unique, back = np.unique(codes[bare], return_inverse=True)
                weights[1] = weights[1].copy()
                weights[1][bare] = np.array([self.cont[self._byte_numbers(c)].sum() for c in unique])[back]
        return {"codes": codes, "heads": heads, "numbers": numbers, "weights": weights}

    def _byte_numbers(self, code: int) -> np.ndarray:
        return self.bytes_at + np.frombuffer(chr(code).encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)

    def _forward(self, arcs: dict) -> np.ndarray:
        size, length = arcs["codes"].shape
        alpha = np.full((size, length + 1), -np.inf)
        alpha[:, 0] = self.start[arcs["heads"][0]]
        for j in range(1, length + 1):
            total = self.start[arcs["heads"][j]] if j in arcs["heads"] else np.full(size, -np.inf)
            for k, w in arcs["weights"].items():
                if k <= j:
                    total = np.logaddexp(total, alpha[:, j - k] + w[:, j - k])
            alpha[:, j] = total
        return alpha

    def _posteriors(self, arcs: dict, starts: np.ndarray, conts: np.ndarray) -> None:
        size, length = arcs["codes"].shape
        alpha, beta = self._forward(arcs), np.full((size, length + 1), -np.inf)
        beta[:, length] = self.cont[self.vocab.end]
        for i in range(length - 1, -1, -1):
            total = np.full(size, -np.inf)
            for k, w in arcs["weights"].items():
                if i + k <= length:
                    total = np.logaddexp(total, w[:, i] + beta[:, i + k])
            beta[:, i] = total
        whole = alpha[:, length] + beta[:, length]
        conts[self.vocab.end] += size
        for k, found in arcs["heads"].items():
            share = np.exp(self.start[found] + beta[:, k] - whole)
            number = np.broadcast_to(found, share.shape)
            starts += np.bincount(number[number >= 0], share[number >= 0], len(starts))
        for k, w in arcs["weights"].items():
            share = np.exp(alpha[:, : length - k + 1] + w + beta[:, k:] - whole[:, None])
            found = arcs["numbers"][k]
            conts += np.bincount(found[found >= 0], share[found >= 0], len(conts))
            if k == 1 and (found < 0).any():
                unique, back = np.unique(arcs["codes"][found < 0], return_inverse=True)
                for code, mass in zip(unique, np.bincount(back, share[found < 0]), strict=True):
                    np.add.at(conts, self._byte_numbers(code), mass)


def held_out(doc_id) -> bool:
    """Null ids count as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


CHUNK_SCHEMA = "chunk long, bucket int, doc_ids array<long>, held array<boolean>, n_words array<int>, texts array<long>, codes binary, words binary, places binary, counts binary"
_NAMES = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]


def _chunk_rows(number: int, rows: list[tuple], buckets: int, groups: int) -> pa.RecordBatch:
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(w) for _, w, _ in rows], np.int64)
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for _, ws, _ in rows for w in ws), np.int64)
    held = [held_out(d) for d, _, _ in rows]
    group = np.repeat(np.array([-1 if h else g for h, (_, _, g) in zip(held, rows, strict=True)]), sizes)
    # Frequent words get small numbers, whose high bytes compress away.
    rank = np.empty(len(numbers), np.int64)
    rank[np.argsort(-np.bincount(codes, minlength=len(numbers)), kind="stable")] = np.arange(len(numbers))
    codes = rank[codes]
    cells = (group * len(numbers) + codes)[group >= 0]
    counts = np.bincount(cells, minlength=groups * len(numbers)).reshape(groups, len(numbers))
    words = np.empty(len(numbers), object)
    words[rank] = list(numbers)
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    order = np.argsort(bucket, kind="stable")
    used, bounds = np.unique(bucket[order], return_index=True)
    bounds = np.append(bounds, len(order))
    texts = np.bincount([g for h, (_, _, g) in zip(held, rows, strict=True) if not h], minlength=groups).tolist()
    out = [(number, -1, [d for d, _, _ in rows], held, sizes.tolist(), texts, planes(codes), None, None, None)]
    for b, at, end in zip(used.tolist(), bounds[:-1], bounds[1:], strict=True):
        some = order[at:end]
        out.append((number, b, None, None, None, None, None, b"\n".join(words[some]), planes(some), planes(counts[:, some].ravel())))
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_NAMES)


def group_names(docs: DataFrame, group: str, most: int = GROUPS) -> list[str]:
    """The groups with the most documents; at most ``most - 1``, the rest share the last place."""
    found = docs.filter(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).count()
    return [r.g for r in found.orderBy(F.desc("count"), "g").limit(most - 1).collect()]


def chunks(docs: DataFrame, text: str = "text", group: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Chunks of all documents: a row (bucket -1) of documents, and one per bucket of words."""
    chosen = [F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")]
    chosen.append((F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g"))
    rows = docs.select(*chosen)
    whole = text_bytes(rows)
    buckets = max(32, -(-whole // BUCKET_BYTES))
    largest = max(CHUNK_BYTES, min(64 << 20, whole >> 12))
    place = {g: i for i, g in enumerate(names or [])}
    other = len(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, value, g in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    held.append((doc, (value or "").encode().lower().split(), place.get(g, other)))
                    size += len(value or "")
                    if size >= largest or len(held) >= CHUNK_DOCS:
                        yield _chunk_rows(number, held, buckets, other + 1)
                        number, held, size = number + 1, [], 0
        if held:
            yield _chunk_rows(number, held, buckets, other + 1)

    return stored(rows.mapInArrow(run, CHUNK_SCHEMA))


def _sum_bucket(table: pa.Table) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """Distinct words of a bucket, their training counts by group, and each row's word numbers."""
    numbers: dict[bytes, int] = {}
    at, counts = [], []
    for words, count in zip(table.column("words").to_pylist(), table.column("counts").to_pylist(), strict=True):
        at.append(np.array([numbers.setdefault(w, len(numbers)) for w in words.split(b"\n")], np.int64))
        counts.append(unplanes(count).reshape(-1, len(at[-1])))
    total = np.zeros((len(counts[0]), len(numbers)), np.int64)
    for where, count in zip(at, counts, strict=True):
        total[:, where] += count
    return list(numbers), total, at


def training_words(parts: DataFrame) -> DataFrame:
    """``word binary, c array<long>`` (by group) of every word that occurs in training texts."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        words, total, _ = _sum_bucket(table)
        seen = np.flatnonzero(total.sum(axis=0))
        by_word = pa.array(np.ascontiguousarray(total[:, seen].T).ravel())
        offsets = pa.array(np.arange(len(seen) + 1, dtype=np.int32) * len(total), pa.int32())
        return pa.table({"word": pa.array([words[i] for i in seen], pa.binary()), "c": pa.ListArray.from_arrays(offsets, by_word)})

    rows = parts.filter("bucket >= 0").select("bucket", "words", "counts")
    # Dealt evenly: the rounds of expectation-maximisation read this table, and buckets may come in a few tasks.
    found = rows.groupBy("bucket").applyInArrow(run, "word binary, c array<long>")
    return stored(found.repartition(max(32, shuffle_width(parts.sparkSession)), "word"))


def fit_pieces(words: DataFrame, name: str = VOCABULARY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of start pieces and continuations, learned from every distinct training word."""
    vocab = vocabulary(name)
    start, cont = vocab.start_prior, vocab.cont_prior
    for _ in range(rounds):
        model = words.sparkSession.sparkContext.broadcast((start, cont))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = vocabulary(name)
            lattice = Lattice(known, *model.value)
            starts, conts = 0.0, 0.0
            for batch in batches:
                s, c = lattice.expected([w.decode() for w in batch.column(0).to_pylist()])
                starts, conts = starts + s, conts + c
            both = np.concatenate((starts, conts)) if np.ndim(starts) else np.empty(0)
            used = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(both[used])], names=["piece", "uses"])

        # As many rows as the vocabulary has pieces, whatever the corpus is.
        sums = words.select("word").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.zeros(len(start) + len(cont))
        for r in sums:
            uses[r.piece] = r.uses
        start, cont = (
            (u + PRIOR_COUNT * p) / (u.sum() + PRIOR_COUNT) for u, p in ((uses[: len(start)], vocab.start_prior), (uses[len(start) :], vocab.cont_prior))
        )
    return start, cont


@dataclass(frozen=True)
class Totals:
    """Training totals by group: tokens, distinct tokens and texts; and over all groups."""

    tokens_by: np.ndarray
    types_by: np.ndarray
    texts_by: np.ndarray
    types: int
    once: int
    twice: int

    @property
    def tokens(self) -> int:
        return int(self.tokens_by.sum())

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once and self.twice else 0.5

    def log_known(self, counts: np.ndarray, log_new: np.ndarray) -> np.ndarray:
        """Natural log probabilities by group, of tokens with training ``counts`` by group."""
        if not self.tokens:
            return np.tile(log_new, (len(self.tokens_by), 1))
        size, spare = np.maximum(self.tokens_by, 1)[:, None], self.discount * self.types_by[:, None]
        share = np.maximum(counts - self.discount, 0) / size
        elsewhere = FROM_ELSEWHERE * counts.sum(axis=0) / self.tokens
        with np.errstate(divide="ignore"):
            known = np.log(share + spare / size * elsewhere)
            return np.logaddexp(known, np.log(spare / size * (1 - FROM_ELSEWHERE)) + log_new)

    def log_groups(self) -> np.ndarray:
        """Log shares of the groups; only groups with training texts take part."""
        if not self.tokens:
            return np.log(np.full(len(self.tokens_by), 1 / len(self.tokens_by)))
        with np.errstate(divide="ignore"):
            return np.log(self.texts_by / self.texts_by.sum())


def totals(parts: DataFrame, words: DataFrame, groups: int) -> Totals:
    whole = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
    w = words.select("c", whole.alias("n")).agg(
        F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2),
        *(F.sum(F.col("c")[g]) for g in range(groups)), *(F.count_if(F.col("c")[g] > 0) for g in range(groups)),
    ).first()
    t = parts.filter("bucket = -1").agg(*(F.sum(F.col("texts")[g]) for g in range(groups))).first()
    texts = np.array([x or 0 for x in t])
    tokens, types = (np.array([x or 0 for x in w[3 + k * groups : 3 + (k + 1) * groups]]) for k in (0, 1))
    ends = int(texts.sum())
    return Totals(tokens + texts, types + (texts > 0), texts, w[0] + (ends > 0), w[1] + (ends == 1), w[2] + (ends == 2))


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"


def document_scores(
    docs: DataFrame, text: str = "text", group: str | None = "lang", name: str = VOCABULARY, rounds: int = ROUNDS
) -> DataFrame:
    """One row per row of ``docs``: token counts, the base score and the model's log10 probability.

    ``lattice_score`` is the log10 marginal over all segmentations under the
    vocabulary's own weights alone, nothing learned.

    Null texts are empty (one end token); a null group is one of the rest.
    Repeated rows are scored, and learned from, as often as they occur.  Words
    are kept as bytes, so no hash can confuse two.
    """
    names = group_names(docs, group) if group else []
    groups = len(names) + 1
    parts = chunks(docs, text, group, names)
    words = training_words(parts)
    weights = docs.sparkSession.sparkContext.broadcast(fit_pieces(words, name, rounds))
    known = totals(parts, words, groups)

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        types, total, at = _sum_bucket(table)
        vocab, spelled = vocabulary(name), [w.decode() for w in types]
        log_new = Lattice(vocab, *weights.value).log_probs(spelled).astype("<f4")
        plain = Lattice(vocab, vocab.start_prior, vocab.cont_prior).log_probs(spelled).astype("<f4")
        return pa.table(
            {
                "chunk": table.column("chunk"), "places": table.column("places"),
                "counts": pa.array([planes(total[:, i].ravel(), 8) for i in at], pa.binary()),
                "scores": pa.array([log_new[i].tobytes() for i in at], pa.binary()),
                "plain": pa.array([plain[i].tobytes() for i in at], pa.binary()),
            }
        )

    answers = parts.filter("bucket >= 0").select("chunk", "bucket", "words", "places", "counts").groupBy("bucket").applyInArrow(
        answer, "chunk long, places binary, counts binary, scores binary, plain binary"
    )
    documents = parts.filter("bucket = -1").select("chunk", "doc_ids", "held", "n_words", "codes")

    def finish(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        places = [unplanes(p) for p in right.column("places").to_pylist()]
        size = sum(map(len, places))
        by_group, log_new, plain = np.zeros((groups, size), np.int64), np.zeros(size), np.zeros(size)
        for at, c, s, p in zip(places, *(right.column(x).to_pylist() for x in ("counts", "scores", "plain")), strict=True):
            by_group[:, at], log_new[at], plain[at] = unplanes(c, 8).reshape(groups, -1), np.frombuffer(s, "<f4"), np.frombuffer(p, "<f4")
        rows = left.to_pylist()[0]
        n_words = np.array(rows["n_words"], np.int64)
        codes, counts = unplanes(rows["codes"]), by_group.sum(axis=0)
        text_of = np.repeat(np.arange(len(n_words)), n_words)
        whole, texts = known.tokens + known.types + 1, int(known.texts_by.sum())
        ends = known.log_known(known.texts_by[:, None], np.array([np.log(END_OF_TEXT)]))[:, 0]
        log_words = known.log_known(by_group, log_new + np.log(1 - END_OF_TEXT))

        def per_text(values: np.ndarray, last: float) -> np.ndarray:
            return np.bincount(text_of, values[codes], len(n_words)) + last

        with np.errstate(invalid="ignore"):
            each = [
                per_text(log_words[g], ends[g] + share) for g, share in enumerate(known.log_groups()) if np.isfinite(share)
            ]
        return pa.table(
            {
                "doc_id": pa.array(rows["doc_ids"], pa.int64()), "held_out": pa.array(rows["held"]),
                "n_tokens": n_words + 1,
                "n_known": per_text((counts > 0).astype(float), float(texts > 0)).astype(np.int64),
                "train_tokens": np.full(len(n_words), known.tokens),
                "base_score": per_text(np.log10((counts + 1) / whole), np.log10((texts + 1) / whole)),
                "score": np.logaddexp.reduce(each) / np.log(10),
                "lattice_score": per_text(plain + np.log(1 - END_OF_TEXT), np.log(END_OF_TEXT)) / np.log(10),
            }
        )

    return documents.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, SCORE_SCHEMA)
