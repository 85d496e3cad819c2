"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64-bit majority votes over the hashes of word shingles.  For
a radius ``r`` every bit position draws a random vector of ``r + 1`` bits; each
non-zero vector ``v`` gives one mask, of the positions whose vector is not
orthogonal to ``v``.  At most ``r`` differing positions span at most ``r``
dimensions, so some ``v`` is orthogonal to all of them and its mask leaves them
out: **every** pair within the radius shares its masked bits in some table.

A bucket is never expanded into pairs.  Small buckets return a spanning forest
of their links.  Large ones (many near copies with distinct fingerprints) are
linked exactly through *midpoints*: two fingerprints within ``r`` bits share a
point within ``r / 2`` of both (for an odd radius, of one, and half a bit more of the
other), and two that share such a point are within ``r``; each fingerprint is
joined to the least of the nearer ones around each midpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import cut, fresh, row_key, spread_join, without

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Buckets of more distinct fingerprints go through midpoints.
BUCKET_ROWS = 512

_BIT_VALUES = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """Majority fingerprint over the XXH64 of all shingles, repeats included."""
    import xxhash

    # On bytes, lower() and split() know exactly A-Z and the six ASCII blanks.
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    if n == 1:
        return digest(joined, seed)
    space = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], space + 1))[:n].tolist()
    ends = np.concatenate((space, [len(joined)]))[size - 1 :].tolist()
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        some = slice(at, min(n, at + (1 << 16)))
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[some], ends[some], strict=True)], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BIT_VALUES[2 * votes > n].sum(dtype=np.uint64))


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """Append ``fp long`` (the unsigned fingerprint's bits); null text counts as empty, fingerprint 0."""
    df = without(df, ["fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values = np.array(
                    [fingerprint(t or "") for t in part.column(part.schema.get_field_index(text)).to_pylist()], np.uint64
                )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(values.view(np.int64))], names=[*part.schema.names, "fp"]
                )

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("fp", T.LongType())]))


def covering_masks(radius: int = RADIUS, bits: int = BITS, seed: int = SEED) -> list[int]:
    """The ``2 ** (radius + 1) - 1`` masks; bit vectors are dealt evenly, then shuffled."""
    codes = np.arange(bits) % ((1 << (radius + 1)) - 1) + 1
    np.random.default_rng(seed).shuffle(codes)
    return [
        sum(1 << i for i in range(bits) if bin(int(codes[i]) & v).count("1") % 2)
        for v in range(1, 1 << (radius + 1))
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _popcount(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct ``values``, one row of distances at a time."""
    left, found = np.arange(len(values)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _popcount(values[left] ^ values[at]) <= radius
            for other in left[near].tolist():
                found.append((at, other))
                queue.append(other)
            left = left[~near]
    return found


def links(distinct: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``a long, b long``: links whose closure is that of all pairs within ``radius``.

    ``distinct`` has one row per fingerprint, ``fp long``.  Emits at most one
    link per table and member of a small bucket, and a bounded number of
    midpoints per member of a large one; never a bucket's pairs.
    """
    masks = [_signed(m) for m in covering_masks(radius)]
    keyed = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("tbl", "key")
    )
    keyed = keyed.withColumn("bucket", F.xxhash64("tbl", "key"))
    # Occupied buckets: a count that is combined on the map side; most hold one row and are dropped here.
    # Counting and cutting share the bucket's exchange with the grouping below.
    sizes = keyed.groupBy("tbl", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")
    ).filter("n > 1")
    sizes = cut(sizes)
    pairs = sizes.filter("n = 2").filter(
        F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= radius
    ).select(F.col("low").alias("a"), F.col("high").alias("b"))
    small = keyed.join(sizes.filter(f"n > 2 and n <= {bucket_rows}").select("tbl", "key"), ["tbl", "key"])
    large = keyed.join(sizes.filter(f"n > {bucket_rows}").select("tbl", "key"), ["tbl", "key"]).select("fp").distinct()

    def forest(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        found = spanning_links(values, radius)
        signed = values.view(np.int64)
        return pa.table(
            {"a": signed[[i for i, _ in found]].astype(np.int64), "b": signed[[j for _, j in found]].astype(np.int64)}
        )

    near = small.groupBy("tbl", "key").applyInArrow(forest, "a long, b long")
    return pairs.unionByName(near).unionByName(midpoint_links(large, radius)).distinct()


def midpoint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Exact links through shared points: within ``radius // 2`` of one end and the rest of the other."""
    near, far = radius // 2, radius - radius // 2
    chosen = [(k, sum(1 << b for b in bits)) for k in range(far + 1) for bits in combinations(range(BITS), k)]
    flips, inner = np.array([f for _, f in chosen], np.uint64), np.array([k <= near for k, _ in chosen])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(values), 256):
                some = values[at : at + 256]
                points = (some[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(some, len(flips)).view(np.int64)), pa.array(points.view(np.int64)),
                        pa.array(np.tile(inner, len(some))),
                    ],
                    names=["fp", "point", "inner"],
                )

    spread = distinct.select("fp").repartition(F.col("fp")).mapInArrow(around, "fp long, point long, inner boolean")
    least = spread.groupBy("point").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("a"), F.count(F.lit(1)).alias("n")).filter(
        "n > 1 and a is not null"
    ).select("point", "a")
    return (
        spread.join(least, "point").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    )


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges`` has ``a long, b long``; returns ``node long, root long`` with the
    least node of each component, for nodes with an edge.  Every round is a
    groupBy of the edge list, written to the checkpoint folder; stars keep the
    list no longer than it was.  Nothing is collected but two sums a round.
    """
    state = cut(edges.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())

    def sums(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = sums(state)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")))
        large = spread_join(both.filter("v > u"), low.filter("n > 0"), ["u"], "v").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        large = cut(large)
        low = cut(large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")))
        small = spread_join(large, low, ["v"], "u").select(
            F.col("m").alias("u"), F.explode(F.array("v", "u")).alias("v")
        ).filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        state = cut(small)
        now = sums(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    children = state.groupBy("v").agg(F.min("u").alias("root"))
    roots = state.select("u").distinct()
    return children.select(F.col("v").alias("node"), "root").unionByName(
        roots.join(children, roots["u"] == children["v"], "left_anti").select(F.col("u").alias("node"), F.col("u").alias("root"))
    )


def near_duplicates(df: DataFrame, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """``doc_id, _tkey, fp, root, component_id`` for every row of ``df``.

    Exact copies share a fingerprint, so links are sought among distinct
    fingerprints only, and copies cost one row each.  ``root`` names the group
    by its least fingerprint; ``component_id`` is the least non-null ``doc_id``
    reachable, null only where all are null.
    """
    rows = cut(fingerprints(df.select("doc_id", text), text).select(*row_key(text=text), "fp"))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    roots = components(links(classes.select("fp"), radius))
    named = cut(
        classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low", F.col("n").alias("rows"))
    )
    lows = cut(named.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n")))
    ids = spread_join(named, lows, ["root"], "fp").select("fp", "root", "component_id", F.col("rows").alias("n"))
    return spread_join(rows, cut(ids), ["fp"], "_tkey").select("doc_id", "_tkey", "fp", "root", "component_id")


def representatives(df: DataFrame, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """One row of ``df`` for each group: the least id, then the least text hash.

    Rows without an id stay only where no row of their group has one.  All
    columns of ``df`` stay.
    """
    key, doc, other = fresh(df, "_tkey", "_keep", "_kept")
    place = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_tkey")
    keep = near_duplicates(df, radius, text).groupBy("root").agg(F.min(place).alias("at")).select(
        F.col("at.doc_id").alias(doc), F.col("at._tkey").alias(other)
    )
    tagged = df.withColumn(key, F.xxhash64(text))
    some = tagged.join(keep, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(other)), "left_semi")
    return some.dropDuplicates(["doc_id", key]).drop(key)
