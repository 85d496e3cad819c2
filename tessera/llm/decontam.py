"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document: one row holds the postings of a few
megabytes of whole texts, every term with its sorted positions.  It is written
once to the shared folder and can be searched any number of times.  A search
takes the test set's windows, drops in one vectorised step those with a term
that the shard lacks, and intersects the offset-adjusted position lists of the
others from the rarest term on.  Shards answer alone, so postings are never
shuffled and a term of any frequency stays inside its shard.

Positions of neighbouring documents are ``GAP`` apart, so no match crosses
from one document into the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import planes, stored, unplanes

WINDOW = 10
#: Distance within which proximity matches are sought by default.
SLOP = 20
#: Positions left free between documents; windows and slop must be smaller.
GAP = 64
#: Bytes of text and documents of one shard.
SHARD_BYTES = 4 << 20
SHARD_DOCS = 8192
#: Windows that a shard maps to its own terms at a time.
BLOCK_WINDOWS = 200_000
#: The test set is searched in blocks of about this much text, one after the other: a block's windows are broadcast.
BLOCK_BYTES = 4 << 20

#: Lower-cases A-Z and blanks every other ASCII byte that isn't a letter or digit.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

_ARROW = {"bigint": pa.int64(), "string": pa.string()}


def _id(df: DataFrame, name: str) -> tuple[Column, str]:
    """The id column and its type: integers as ``bigint``, all others as ``string``."""
    kind = "bigint" if isinstance(df.schema[name].dataType, T.IntegralType) else "string"
    return F.col(name).cast(kind).alias(name), kind


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return (text or "").encode().translate(_FOLD).split()


def _starts(n_words: np.ndarray) -> np.ndarray:
    """First position of each document of a shard."""
    return np.concatenate(([0], np.cumsum(n_words + GAP)[:-1])) if len(n_words) else np.empty(0, np.int64)


def _shard(number: int, rows: list[tuple], kind: str) -> pa.RecordBatch:
    n_words = np.array([len(w) for _, _, w in rows], np.int64)
    vocabulary: dict[bytes, int] = {}
    codes = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for _, _, ws in rows for w in ws), np.int64)
    positions = np.arange(len(codes)) + np.repeat(_starts(n_words) - np.concatenate(([0], np.cumsum(n_words)[:-1])), n_words)
    order = np.argsort(codes, kind="stable")
    by_term = positions[order]
    counts = np.bincount(codes, minlength=len(vocabulary))
    delta = np.diff(by_term, prepend=0)
    firsts = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.empty(0, np.int64)
    delta[firsts] = by_term[firsts]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number]),
            pa.array([[i for i, _, _ in rows]], pa.list_(_ARROW[kind])),
            pa.array([[k for _, k, _ in rows]], pa.list_(pa.int64())),
            pa.array([n_words.tolist()], pa.list_(pa.int32())),
            pa.array([list(vocabulary)], pa.list_(pa.binary())),
            pa.array([planes(counts)], pa.binary()),
            pa.array([planes(delta)], pa.binary()),
        ],
        names=["shard", "doc_ids", "tkeys", "n_words", "terms", "counts", "positions"],
    )


def build_index(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the positional index of all of ``docs`` and return it.

    Null text has no words; repeated rows are indexed as often as they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, key, value in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    held.append((doc, key, words_of(value)))
                    size += len(value or "")
                    if size >= shard_bytes or len(held) >= SHARD_DOCS:
                        yield _shard(number, held, kind)
                        number, held, size = number + 1, [], 0
        if held:
            yield _shard(number, held, kind)

    doc, kind = _id(docs, "doc_id")
    rows = docs.select(doc, F.xxhash64(F.col(text)).alias("_tkey"), text)
    schema = f"shard long, doc_ids array<{kind}>, tkeys array<long>, n_words array<int>, terms array<binary>, counts binary, positions binary"
    return stored(rows.mapInArrow(run, schema))


@dataclass(frozen=True)
class Windows:
    """Distinct test windows as term numbers; short ones are padded with -1."""

    terms: list[bytes]
    matrix: np.ndarray
    #: Items of each window.
    items: list[list[int]]

    def blocks(self, size: int = BLOCK_WINDOWS) -> Iterator[Windows]:
        for at in range(0, len(self.items), size):
            matrix = self.matrix[at : at + size]
            used = np.unique(matrix[matrix >= 0])
            yield Windows([self.terms[i] for i in used], np.where(matrix >= 0, np.searchsorted(used, matrix), -1), self.items[at : at + size])


def segments(items: DataFrame, size: int = WINDOW, most_bytes: int = BLOCK_BYTES // 4) -> DataFrame:
    """``item_id, part long, words binary``: the items' words, long items in parts that share ``size - 1`` words.

    Every window lies in a part, and only items of fewer words have a shorter part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, at, part = words_of(value), 0, 0
                ends = np.cumsum([len(w) + 1 for w in words])
                while at < len(words) and (not part or at + size <= len(words)):
                    until = max(at + size, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item], batch.schema.field(0).type), pa.array([part]), pa.array([b" ".join(words[at:until])])],
                        names=["item_id", "part", "words"],
                    )
                    at, part = until - size + 1, part + 1

    item, kind = _id(items, "item_id")
    wanted = items.select(item, "text").filter("item_id is not null")
    return wanted.mapInArrow(run, f"item_id {kind}, part long, words binary")


def windows_of(items: list[tuple[object, str | bytes | None]], size: int = WINDOW) -> Windows:
    """All windows of ``size`` words; an item with fewer words, but some, is one window."""
    terms: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[int]] = {}
    for item, value in items:
        words = value.split() if isinstance(value, bytes) else words_of(value)
        codes = [terms.setdefault(w, len(terms)) for w in words]
        for at in range(max(1, len(codes) - size + 1) if codes else 0):
            found.setdefault(tuple(codes[at : at + size]), set()).add(item)
    matrix = np.full((len(found), size), -1, np.int64)
    for row, window in enumerate(found):
        matrix[row, : len(window)] = window
    return Windows(list(terms), matrix, [sorted(x, key=lambda i: (i is None, i)) for x in found.values()])


def phrase_matches(lists: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Start positions of a phrase from ``(offset, positions)`` of its words, rarest list first."""
    lists = sorted(lists, key=lambda x: len(x[1]))
    starts = lists[0][1] - lists[0][0]
    for offset, positions in lists[1:]:
        if not len(starts):
            break
        at = np.searchsorted(positions, starts + offset)
        at[at == len(positions)] = 0
        starts = starts[positions[at] == starts + offset]
    return starts


def proximity_matches(lists: list[np.ndarray], slop: int) -> np.ndarray:
    """Positions of the rarest term that have every other term within ``slop`` words."""
    lists = sorted(lists, key=len)
    near = lists[0]
    for positions in lists[1:]:
        if not len(near):
            break
        at = np.searchsorted(positions, near - slop)
        ok = at < len(positions)
        ok[ok] = positions[at[ok]] <= near[ok] + slop
        near = near[ok]
    return near


def _search_shard(row: dict, blocks: list[Windows], slop: int):
    """Where documents start; where hit words begin and end; per document, items by phrase and by proximity."""
    n_words = np.array(row["n_words"], np.int64)
    starts = _starts(n_words)
    counts = unplanes(row["counts"])
    bounds = np.concatenate(([0], np.cumsum(counts)))
    delta = unplanes(row["positions"])
    number = {t: i for i, t in enumerate(row["terms"])}
    lists: dict[int, np.ndarray] = {}

    def postings(term: int) -> np.ndarray:
        if term not in lists:
            lists[term] = np.cumsum(delta[bounds[term] : bounds[term + 1]])
        return lists[term]

    covered = np.zeros(int(starts[-1] + n_words[-1]) + 1 if len(n_words) else 1, np.int32)
    exact: list[set] = [set() for _ in n_words]
    near: list[set] = [set() for _ in n_words]
    for windows in blocks:
        local = np.array([number.get(t, -1) for t in windows.terms] + [-2], np.int64)
        mapped = np.where(windows.matrix >= 0, local[windows.matrix], -2)
        for w in np.flatnonzero((mapped != -1).all(axis=1)).tolist():
            terms = [t for t in mapped[w].tolist() if t >= 0]
            close = proximity_matches([postings(t) for t in set(terms)], slop)
            # A phrase of up to slop + 1 words lies within slop of any of them.
            if not len(close) and len(terms) <= slop + 1:
                continue
            for d in np.unique(np.searchsorted(starts, close, "right") - 1).tolist():
                near[d].update(windows.items[w])
            at = phrase_matches([(k, postings(t)) for k, t in enumerate(terms)])
            if len(at):
                np.add.at(covered, at, 1)
                np.add.at(covered, at + len(terms), -1)
                for d in np.unique(np.searchsorted(starts, at, "right") - 1).tolist():
                    exact[d].update(windows.items[w])
    inside = np.concatenate(([0], (np.cumsum(covered) > 0).astype(np.int8), [0]))
    begins, ends = np.flatnonzero(np.diff(inside) > 0), np.flatnonzero(np.diff(inside) < 0)
    return starts, begins, ends, exact, near


def _merged(spans: Column) -> Column:
    """Length of the union of ``array<struct<a, b>>``."""
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        F.array_sort(spans), none,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["b"]).alias("end"),
            (acc["total"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(acc["end"], s["a"]))).alias("total"),
        ),
        lambda acc: acc["total"],
    )


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per indexed document, also without a match: ``doc_id, _tkey, n_words, n_hit, items, near_items``.

    ``n_hit`` counts the document's words inside any exact occurrence of a
    window, ``items`` the items with such an occurrence and ``near_items``
    those with a window whose words all lie within ``slop`` of the one that is
    rarest in the shard.
    The test set's windows are broadcast in blocks of ``block_bytes`` of text,
    each found in the whole index; a test set of one block needs no shuffle,
    and only matches are merged over several.
    Items without an ``item_id`` cannot be named and are ignored: what they
    hold is not found in any document.
    """
    if max(window, slop) >= GAP:
        raise ValueError(f"window and slop must be below {GAP}")
    kind = _id(items, "item_id")[1]
    parts = stored(segments(items, window, block_bytes // 4))
    size = parts.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    spark, found = index.sparkSession, []
    for number in range(blocks):
        some = parts.filter(F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)) == number)
        made = windows_of([(r.item_id, r.words) for r in some.select("item_id", "words").toLocalIterator()], window)
        here = _search_block(index, spark.sparkContext.broadcast(list(made.blocks())), kind, slop)
        found.append(stored(here.filter("size(near_items) + size(items) > 0")) if blocks > 1 else here)
    doc_kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    if blocks == 1:
        hits = found[0].withColumn("n_hit", _merged(F.col("spans")))
    else:
        hits = reduce(DataFrame.unionByName, found).groupBy("shard", "place").agg(
            *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")),
            _merged(F.flatten(F.collect_list("spans"))).alias("n_hit"),
        )
        every = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "tkeys", "n_words")).alias("place", "_doc")).select(
            "shard", "place", F.col("_doc.doc_ids").alias("doc_id"), F.col("_doc.tkeys").alias("_tkey"), F.col("_doc.n_words").cast("long").alias("n_words")
        )
        none = F.array().cast(f"array<{kind}>")
        hits = every.join(hits, ["shard", "place"], "left").withColumns(
            {"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", none), "near_items": F.coalesce("near_items", none)}
        )
    return hits.select(F.col("doc_id").cast(doc_kind).alias("doc_id"), "_tkey", "n_words", "n_hit", "items", "near_items")


def _search_block(index: DataFrame, blocks: Broadcast, kind: str, slop: int) -> DataFrame:
    """Each document's hit spans and items, by its shard and place there."""
    doc = index.schema["doc_ids"].dataType.elementType.simpleString()
    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: c[0].as_py() for n, c in zip(batch.schema.names, batch.slice(at, 1).columns, strict=True)}
                starts, begins, ends, exact, near = _search_shard(row, blocks.value, slop)
                of = np.searchsorted(starts, begins, "right") - 1
                spans: list[list[dict]] = [[] for _ in exact]
                for d, a, b in zip(of.tolist(), (begins - starts[of]).tolist(), (ends - starts[of]).tolist(), strict=True):
                    spans[d].append({"a": a, "b": b})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(exact), pa.int64()), pa.array(range(len(exact)), pa.int32()),
                        pa.array(row["doc_ids"], _ARROW[doc]), pa.array(row["tkeys"], pa.int64()), pa.array(row["n_words"], pa.int64()),
                        pa.array(spans, pa.list_(span)),
                        pa.array([sorted(x) for x in exact], pa.list_(_ARROW[kind])),
                        pa.array([sorted(x) for x in near], pa.list_(_ARROW[kind])),
                    ],
                    names=["shard", "place", "doc_id", "_tkey", "n_words", "spans", "items", "near_items"],
                )

    return index.mapInArrow(
        run,
        f"shard long, place int, doc_id {doc}, _tkey long, n_words long, spans array<struct<a:long,b:long>>, items array<{kind}>, near_items array<{kind}>",
    )


def contaminated_keys(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, _tkey`` of the documents with an exact occurrence of a window."""
    return search(build_index(docs), items).filter("n_hit > 0").select("doc_id", "_tkey").distinct()
