"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is encoded by halves.  A half no longer than a leaf is encoded
directly; two neighbours are joined by re-encoding a window around their
boundary that grows until both of its ends are at *fixed cuts*.

Why the tokens outside the window are final: in the pre-tokenizer's pattern
blanks occur only at the head of a match or in matches of blanks alone.  So a
match always begins at a blank that follows a letter, digit or common mark,
whatever the rest of the text is, and from a match's beginning on the scan
has no memory.  Matches that end at or before such a cut saw the blank and
cannot change; matches that begin at one are scanned the same in any context;
and each match is merged separately.  The window's own tokens are taken from
a fresh encoding of the window's text.

Decoding is the matching homomorphism: bytes of the halves, concatenated up
the tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import without

#: Characters of a leaf, and of the first boundary window to each side.
LEAF_CHARS = 8192
WINDOW_CHARS = 32
#: Token ids of a leaf when decoding.
LEAF_IDS = 8192


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of base64 tokens; a bare name is a public vocabulary."""
    try:
        stream = open(path if "/" in path else vocabulary_path(path), "rb")
    except FileNotFoundError:
        stream = open(SparkFiles.get(path), "rb")
    with stream:
        return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in stream if line.strip())}


def _is_cut(text: str, at: int) -> bool:
    before = text[at - 1]
    return text[at] in " \n" and (before.isalpha() or before in "0123456789.,;:!?")


class TreeCodec:
    """Encoder and decoder for one vocabulary; one per Python worker."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, window_chars: int = WINDOW_CHARS):
        import public_tokenizers
        import tiktoken

        ranks = read_ranks(path)
        self._leaf = tiktoken.Encoding(
            "tree", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self._bytes = {rank: token for token, rank in ranks.items()}
        self.leaf_chars = max(1, leaf_chars)
        self.window_chars = max(1, window_chars)

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self._leaf(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """The monoid's product: ids of ``left + right`` from the ids of both."""
        begin, end = self._window(left, right)
        keep = len(left_ids) - len(self._leaf(left[begin:])) if begin else 0
        skip = len(self._leaf(right[:end])) if end < len(right) else len(right_ids)
        return left_ids[:keep] + self._leaf(left[begin:] + right[:end]) + right_ids[skip:]

    def _window(self, left: str, right: str) -> tuple[int, int]:
        reach, seen = self.window_chars, 0
        begin = None
        while begin is None:
            low = max(1, len(left) - reach)
            begin = next((p for p in range(len(left) - 1 - seen, low - 1, -1) if _is_cut(left, p)), None)
            if begin is None and low == 1:
                begin = 0
            seen, reach = len(left) - low, reach * 2
        reach, seen, end = self.window_chars, 1, None
        while end is None:
            high = min(len(right), reach)
            end = next((q for q in range(seen, high) if _is_cut(right, q)), None)
            if end is None and high == len(right):
                end = len(right)
            seen, reach = max(1, high), reach * 2
        return begin, end

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def decode(self, ids) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self._bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(maxsize=4)
def codec(path: str) -> TreeCodec:
    return TreeCodec(path)


def _by_batch(df: DataFrame, added: list[T.StructField], work) -> DataFrame:
    """Append columns that ``work`` makes of a slice of rows; columns of the same names are replaced."""
    df = without(df, [f.name for f in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = work(part)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *columns], names=[*part.schema.names, *(f.name for f in added)]
                )

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small slices, so that a worker holds few texts at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(df: DataFrame, text: str = "text", path: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Append ``ids array<int>``, the BPE ids of the whole ``text`` (null: empty text).

    Every other column passes through; one named ``ids`` is replaced.
    No shuffle; a worker holds one slice of rows.
    """

    def work(part: pa.RecordBatch):
        coder = codec(path)
        sizes, flat = [0], []
        for value in part.column(part.schema.get_field_index(text)).to_pylist():
            ids = coder.encode(value or "")
            flat.append(np.array(ids, dtype=np.int32))
            sizes.append(sizes[-1] + len(ids))
        values = np.concatenate(flat) if flat else np.empty(0, np.int32)
        return [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values))]

    return _by_batch(df, [T.StructField("ids", T.ArrayType(T.IntegerType(), True))], work)


def decode(df: DataFrame, ids: str = "ids", path: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Append ``decoded binary``, the bytes of ``ids`` (null ids: no bytes).

    An id outside the vocabulary raises; texts need not be valid UTF-8.
    """

    def work(part: pa.RecordBatch):
        coder = codec(path)
        lists = part.column(part.schema.get_field_index(ids))
        offsets, values = lists.offsets.to_pylist(), lists.values
        out = [coder.decode(values.slice(a, b - a).to_pylist()) for a, b in zip(offsets, offsets[1:], strict=False)]
        return [pa.array(out, pa.binary())]

    return _by_batch(df, [T.StructField("decoded", T.BinaryType())], work)


def token_counts(df: DataFrame, text: str = "text", path: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Append ``n_tokens long`` only, without keeping the ids."""

    def work(part: pa.RecordBatch):
        coder = codec(path)
        return [pa.array([coder.count(v or "") for v in part.column(part.schema.get_field_index(text)).to_pylist()], pa.int64())]

    return _by_batch(df, [T.StructField("n_tokens", T.LongType())], work)
