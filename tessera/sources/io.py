"""Typed readers and writers, strict CSV, and content checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import Contract


def read_table(spark: SparkSession, path: str, contract: Contract, check: bool = True) -> DataFrame:
    """Declared columns only, cast and checked."""
    df = contract.coerce(spark.read.parquet(path).select(*[c.name for c in contract.columns]))
    return contract.validate(df) if check else df


def any_of(groups: Sequence[Sequence[tuple[str, str, object]]]) -> Column:
    """Condition from groups of ``(column, operator, value)``: all of one group hold; it reaches the scan of columnar files."""
    tests = {
        "==": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
        ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "in": lambda c, v: c.isin(list(v)),
    }
    out = F.lit(False)
    for group in groups:
        whole = F.lit(True)
        for name, how, value in group:
            whole = whole & tests[how](F.col(name), value)
        out = out | whole
    return out


def write_table(df: DataFrame, path: str, contract: Contract, partition_by: Sequence[str] = ()) -> None:
    """Check first, then write; Spark's committer publishes a job's files at once."""
    writer = contract.validate(contract.coerce(df)).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_strict_csv(
    spark: SparkSession, path: str, columns: Sequence[str], sep: str = ";", null_codes: Sequence[str] = (), where: str | None = None
) -> DataFrame:
    """All columns as strings; empty fields and the given codes are null; no inference.

    Compressed files can't be split, so their rows are spread after reading.
    """
    df = spark.read.options(header=True, sep=sep, inferSchema=False, enforceSchema=False, mode="FAILFAST").csv(path).select(*columns)
    if where:
        df = df.where(where)
    codes = [*null_codes, ""]
    df = df.select(*[F.when(~F.col(c).isin(codes), F.col(c)).alias(c) for c in columns])
    return df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, lineSep="\n").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def read_any(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options: str) -> DataFrame:
    """Any built-in source: parquet, orc, csv, json, text, binaryFile."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of every file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def content_digest(df: DataFrame) -> DataFrame:
    """Order-insensitive digest of a table: rows and the sum and xor of their hashes."""
    rows = df.select(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns]).alias("h"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x"))


def controls(df: DataFrame, expected: dict[str, tuple[str, float, str]]) -> DataFrame:
    """``name, expected, actual, kind, ok`` for named metrics (SQL aggregate, value, hard/soft/info).

    Hard metrics must agree, soft ones within one per cent.
    """
    names = list(expected)
    actual = df.agg(*[F.expr(expected[n][0]).cast("double").alias(n) for n in names])
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(float(expected[n][1])).alias("expected"), F.col(n).alias("actual"), F.lit(expected[n][2]).alias("kind")) for n in names
    ])).alias("m")
    m = actual.select(rows).select("m.*")
    slack = F.when(F.col("kind") == "soft", 0.01).otherwise(0.0) * F.abs("expected")
    return m.withColumn("ok", (F.col("kind") == "info") | F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= slack, F.lit(False)))
