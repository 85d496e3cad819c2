"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"

#: Words are runs of anything but the six ASCII blanks.
WORD_PATTERN = "[^\x20\x09-\x0d]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; the path is only ever opened by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a temporary one only where driver and executors are one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Catalyst's size estimate of ``df``, or its bytes of text where that is unknown; chooses partition counts only."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return size


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Identity of a document row: its id and its text.

    Repeated rows with the same id and text count as one document; rows that
    share an id but not a text stay apart.
    """
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_tkey")]


def shuffle_width(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stored(df: DataFrame, parts: str | None = None, most_parts: int = 0) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    Like ``cut``, but columnar: for large results that are read more than once.
    ``parts`` names a column of at most ``most_parts`` values, one folder each,
    so that readers of one value leave the others alone.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if parts:
        # One open file for each value spares a sort.
        was = spark.conf.get(_OPEN_FILES)
        spark.conf.set(_OPEN_FILES, str(most_parts))
        try:
            writer.partitionBy(parts).parquet(path)
        finally:
            spark.conf.set(_OPEN_FILES, was)
    else:
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table that ``stored`` made, once nothing can ask for it again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less the columns whose names an operator is about to add (in any case): its own take their place."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has a column so called (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], by: str, hot_rows: int = 4096, most_hot: int = 2000) -> DataFrame:
    """``rows`` joined with ``keys`` on non-null ``on``, hot keys dealt over many tasks.

    ``keys`` has one row per key, with ``n``, the rows it meets, and is
    materialised.  Keys of over ``hot_rows`` rows and over one in ``most_hot`` of
    all are hot; there are at most ``most_hot`` of them, whatever the input, so
    they are broadcast.  Rows of a hot key are dealt by the hash of ``by`` over
    64 salts, and its entry goes to each; others meet in a plain join.
    """
    total = keys.agg(F.sum("n")).first()[0] or 0
    salts, limit = 64, max(hot_rows, total // most_hot)
    hot = keys.filter(F.col("n") > limit).select(*on, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(0)
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(keys.withColumn("_salt", F.explode(every)).drop("n"), [*on, "_salt"]).drop("_salt")


def planes(values: np.ndarray, width: int = 4) -> bytes:
    """Little-endian unsigned values of ``width`` bytes by byte planes, which compress well."""
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unplanes(data: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)
