"""Substring dedup over sliding sentence spans.

A text is cut into sentences (at ``.``, ``!``, ``?``, their full-width forms and
line ends).  A sentence is cut further after the word of least hash in every
window of ``PIECE_WORDS // 2`` consecutive words inside it (winnowing), so that
no piece is longer than a window and a cut depends on no word further off than
one: the same passage is cut alike wherever it stands, but for a window's length
at its ends.  In scripts without blanks every character is cut like a word, and
two count as one.  Around every piece the shortest run of ``RUN`` or more
consecutive pieces with ``LEAST_WORDS`` or more words is hashed, once for each
piece that begins one and once for each that ends one (128 bits of the
case-folded words); the hashes are joined over the whole corpus, and the pieces
covered by any but the first occurrence of a repeated run are removed.  "First"
is the least document key, then the least position.

With windows of W = 8, the cuts at least W - 1 words inside a shared passage of
L words are the same in both texts.  The first and the last of them are L - 4W + 3
words apart or more, which is 21 at L = 50: a passage of 50 words always holds a
common run.

With ``sentences`` every run of ``RUN`` consecutive whole sentences is hashed,
however short (a longer run that repeats is the union of its runs of ``RUN``);
the runs of pieces then serve passages that begin or end inside a sentence: one
for each piece that begins one, unless it cuts no sentence.

Runs are first counted with map-side combining, so that a passage in a third
of all documents is one small row per task; only runs that do repeat meet
their occurrences again, in a join that deals the occurrences of frequent ones
over many tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import discard, fresh, row_key, spread_join, stored, without

RUN = 3
PIECE_WORDS = 16
#: Shorter runs are common by chance, or are single lines that many documents share.
LEAST_WORDS = 20
#: A run's place is ``first piece * STRIDE + pieces``, and a run of sentences' is ``first sentence - SENTENCES``.
STRIDE = 64
SENTENCES = 1 << 40
#: Parts in which the hashes are counted, and Spark's setting that frees shuffle files when a write ends.
SLICES = 4
_GIVE_BACK = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A sentence with the blanks after it; line ends close one too.
_SENTENCE = re.compile(r"[^\n.!?。！？]*(?:[.!?。！？]+[\"'”’)\]]*|\n|$)\s*")
#: Characters of scripts written without blanks: Thai to Khmer, Kana, Han and their full-width marks.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
_HAS_DENSE = re.compile(f"[{_DENSE}]")
_WORD = re.compile(r"\S+\s*")
_UNIT = re.compile(rf"(?:[^\S{_DENSE}]*[{_DENSE}]|[^\s{_DENSE}]+)\s*")


def cuts(hashes: list[int], window: int) -> list[int]:
    """Places of the least value of every window, the last of equal ones."""
    least: list[int] = []
    at = -1
    for end in range(window, len(hashes) + 1):
        if at < end - window:
            low = min(hashes[end - window : end])
            at = end - 1
            while hashes[at] != low:
                at -= 1
        elif hashes[end - 1] <= hashes[at]:
            at = end - 1
        if not least or least[-1] != at:
            least.append(at)
    return least


def cut_text(text: str, most_words: int = PIECE_WORDS) -> tuple[list[str], list[int]]:
    """Consecutive pieces whose concatenation is ``text``, and where in them each sentence begins."""
    out, firsts, window, crc = [], [], max(1, most_words // 2), zlib.crc32
    word = _UNIT if not text.isascii() and _HAS_DENSE.search(text) else _WORD
    for part in _SENTENCE.findall(text):
        if not part:
            continue
        firsts.append(len(out))
        if len(part) <= window:
            out.append(part)
            continue
        words = word.findall(part)
        if len(words) <= window:
            out.append(part)
            continue
        held = 0
        words[0] = part[: len(part) - sum(map(len, words[1:]))]
        for at in cuts([crc(w.strip().lower().encode("utf-8", "surrogatepass")) for w in words[:-1]], window):
            out.append("".join(words[held : at + 1]))
            held = at + 1
        out.append("".join(words[held:]))
    return out, firsts


def pieces(text: str, most_words: int = PIECE_WORDS) -> list[str]:
    return cut_text(text, most_words)[0]


def size_of(folded: str) -> int:
    """Words of a piece, in halves; two characters of a script without blanks make one."""
    if folded.isascii() or not (dense := len(_HAS_DENSE.findall(folded))):
        return 2 * (folded.count(" ") + 1)
    return dense + 2 * len(_HAS_DENSE.sub(" ", folded).split())


def runs(parts: list[str], size: int = RUN, least_words: int = LEAST_WORDS) -> tuple[list[int], list[bytes]]:
    """Place and 128-bit digest of every run."""
    import xxhash

    if max(size, least_words) >= STRIDE:
        raise ValueError(f"size and least_words must be below {STRIDE}")
    # Pieces without a word neither begin a run nor count in one.
    plain = [f for p in parts if (f := " ".join(p.lower().split()))]
    folded, lengths = [f.encode("utf-8", "surrogatepass") for f in plain], [size_of(f) for f in plain]
    least_words *= 2
    places: set[int] = set()
    n, end, total = len(folded), 0, 0
    for begin in range(n):  # the shortest run that begins here
        while end < n and (end - begin < size or total < least_words):
            total, end = total + lengths[end], end + 1
        if end - begin < size or total < least_words:
            break
        places.add(begin * STRIDE + end - begin)
        total -= lengths[begin]
    begin, total = n, 0
    for end in range(n, 0, -1):  # the shortest run that ends here
        while begin > 0 and (end - begin < size or total < least_words):
            begin -= 1
            total += lengths[begin]
        if end - begin < size or total < least_words:
            break
        places.add(begin * STRIDE + end - begin)
        total -= lengths[end - 1]
    where = sorted(places)
    digest = xxhash.xxh3_128_digest
    return where, [digest(b"\n".join(folded[p // STRIDE : p // STRIDE + p % STRIDE])) for p in where]


def sentence_groups(parts: list[str], firsts: list[int]) -> list[tuple[int, int]]:
    """First piece and end of every sentence that has a word."""
    return [(a, b) for a, b in pairwise([*firsts, len(parts)]) if any(p.strip() for p in parts[a:b])]


def sentence_runs(parts: list[str], firsts: list[int], size: int = RUN, least_words: int = LEAST_WORDS) -> tuple[list[int], list[bytes]]:
    """Place and 128-bit digest of every run of ``size`` sentences, and of the runs of pieces that cut one."""
    import xxhash

    if max(size, least_words) >= STRIDE:
        raise ValueError(f"size and least_words must be below {STRIDE}")
    digest, groups = xxhash.xxh3_128_digest, sentence_groups(parts, firsts)
    # Pieces with a word; ``cut`` counts those before each that are not a whole sentence.
    folded, lengths, cut, whole = [], [], [0], []
    for a, b in groups:
        for p in parts[a:b]:
            if f := " ".join(p.lower().split()):
                folded.append(f.encode("utf-8", "surrogatepass"))
                lengths.append(size_of(f))
                cut.append(cut[-1] + (b - a > 1))
        whole.append(len(folded))
    whole = [b" ".join(folded[a:b]) for a, b in pairwise([0, *whole])]
    where = [k - SENTENCES for k in range(len(whole) - size + 1)]
    digests = [digest(b"\0" + b"\n".join(whole[k : k + size])) for k in range(len(where))]
    n, end, total = len(folded), 0, 0
    for begin in range(n):
        while end < n and (end - begin < size or total < 2 * least_words):
            total, end = total + lengths[end], end + 1
        if end - begin < size or total < 2 * least_words:
            break
        if cut[end] > cut[begin]:
            where.append(begin * STRIDE + end - begin)
            digests.append(digest(b"\n".join(folded[begin:end])))
        total -= lengths[begin]
    return where, digests


def span_rows(df: DataFrame, text: str = "text", size: int = RUN, least_words: int = LEAST_WORDS, sentences: bool = False) -> DataFrame:
    """``doc_id, _tkey, pos long, h1 long, h2 long``: one row per run."""

    def found_in(value: str) -> tuple[list[int], list[bytes]]:
        return sentence_runs(*cut_text(value), size, least_words) if sentences else runs(pieces(value), size, least_words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                ids, keys, texts = part.columns
                takes, where, digests = [], [], []
                for row, value in enumerate(texts.to_pylist()):
                    at, found = found_in(value or "")
                    takes.extend([row] * len(at))
                    where.extend(at)
                    digests.extend(found)
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                take = pa.array(takes, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take), keys.take(take), pa.array(where, pa.int64()),
                        pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])),
                    ],
                    names=["doc_id", "_tkey", "pos", "h1", "h2"],
                )

    rows = df.select(*row_key(text=text), text)
    return rows.mapInArrow(work, T.StructType([*rows.schema.fields[:2], *T._parse_datatype_string("pos long, h1 long, h2 long").fields]))


def repeated_positions(
    df: DataFrame, text: str = "text", size: int = RUN, least_words: int = LEAST_WORDS, sentences: bool = False
) -> DataFrame:
    """``doc_id, _tkey, starts array<long>``: places of the non-first repeated runs."""
    found = span_rows(df, text, size, least_words, sentences)
    rows = stored(found.withColumn("slice", F.pmod("h1", F.lit(SLICES)).cast("int")), "slice", SLICES)
    # Half a digest is enough to drop nearly all runs; what it keeps by chance goes below.
    # One slice of the hashes after the other, each giving back its shuffle files, bounds the disk.
    conf, kept = df.sparkSession.conf, []
    was = conf.get(_GIVE_BACK)
    conf.set(_GIVE_BACK, "true")
    try:
        for number in range(SLICES):
            part = rows.filter(F.col("slice") == number).drop("slice")
            maybe = stored(part.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
            kept.append(stored(spread_join(part, maybe, ["h1"], "doc_id")))
    finally:
        conf.set(_GIVE_BACK, was)
    discard(rows)
    some = reduce(DataFrame.unionByName, kept)
    place = F.struct("doc_id", "_tkey", "pos")
    known = stored(
        some.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
        .filter(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first", "n")
    )
    again = spread_join(some, known, ["h1", "h2"], "doc_id").filter(~place.eqNullSafe(F.col("first")))
    return again.groupBy("doc_id", "_tkey").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def without_repeats(text: str, places: list[int] | None, size: int = RUN) -> tuple[str, int, int]:
    """The text that is left, its number of pieces, and how many were removed.

    Pieces without a word stay only if the text loses nothing.
    """
    parts, firsts = cut_text(text)
    if not places:
        return text, len(parts), 0
    index = [i for i, p in enumerate(parts) if p.strip()]
    gone = {index[k] for p in places if p >= 0 for k in range(p // STRIDE, p // STRIDE + p % STRIDE)}
    if places[0] < 0:
        groups = sentence_groups(parts, firsts)
        for p in places:
            for a, b in groups[p + SENTENCES : p + SENTENCES + size] if p < 0 else ():
                gone.update(range(a, b))
    return "".join(p for i, p in enumerate(parts) if i not in gone and p.strip()).strip(), len(parts), len(gone)


def remove_repeats(
    df: DataFrame, text: str = "text", size: int = RUN, least_words: int = LEAST_WORDS, sentences: bool = False
) -> DataFrame:
    """Every row of ``df`` with ``text`` replaced, and ``n_pieces, n_removed`` appended.

    ``sentences`` adds every run of ``size`` whole sentences, however short.
    Null text stays null.  Repeated rows (same id, same text) are one document
    and keep what it keeps.  Texts of fewer than ``size`` pieces have no run and
    stay as they are.  Removal may leave an empty text; the row remains.  Columns
    named ``n_pieces`` or ``n_removed`` are replaced; all others stay.
    """
    added = [T.StructField("n_pieces", T.LongType()), T.StructField("n_removed", T.LongType())]
    df = without(df, ["n_pieces", "n_removed"])
    key, doc, other, places = fresh(df, "_tkey", "_d", "_k", "_starts")
    found = repeated_positions(df, text, size, least_words, sentences)
    starts = found.select(F.col("doc_id").alias(doc), F.col("_tkey").alias(other), F.col("starts").alias(places))
    joined = df.withColumn(key, F.xxhash64(text)).join(
        starts, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(other)), "left"
    ).select(*df.columns, places)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                at = part.schema.get_field_index(text)
                found = [
                    (None, 0, 0) if value is None else without_repeats(value, places, size)
                    for value, places in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)
                ]
                columns = list(part.columns[:-1])
                columns[at] = pa.array([t for t, _, _ in found], columns[at].type)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([n for _, n, _ in found], pa.int64()), pa.array([r for _, _, r in found], pa.int64())],
                    names=[*part.schema.names[:-1], "n_pieces", "n_removed"],
                )

    return joined.mapInArrow(work, T.StructType([*df.schema.fields, *added]))
