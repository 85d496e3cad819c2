"""Exact token-length histogram with suffix sums.

Documents are aggregated by encoded length (one row per distinct length, a
map-side combined sum), and suffix sums over the histogram answer every
context limit exactly: for a limit ``L``, ``tokens_at_most`` of the documents
that fit plus ``L`` for each that does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Lengths of one block share a task when suffix sums are made.
BLOCK = 1024


def length_histogram(df: DataFrame, length: str = "n_tokens") -> DataFrame:
    """``length long, docs long``; null lengths count as zero."""
    return df.groupBy(F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each distinct length: documents and tokens at or above it, and more.

    Columns: ``length, docs, docs_ge, tokens_ge, docs_total, tokens_total,
    truncated_total`` (tokens left if every document is cut to ``length``) and
    ``quantile`` (share of documents of at most ``length`` tokens).  An empty
    histogram gives no rows.

    Sums run within blocks of lengths, and over the blocks' totals, so that no
    task holds more than one block or the list of blocks.  The histogram, a row
    per distinct length, is checkpointed, so that texts are encoded once.
    """
    rows = cut(histogram).withColumn("_block", (F.col("length") / BLOCK).cast("long"))
    blocks = rows.groupBy("_block").agg(
        F.sum("docs").alias("_docs"), F.sum(F.col("docs") * F.col("length")).alias("_tokens")
    )
    after = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_docs").over(after), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_tokens").over(after), F.lit(0)).alias("_tokens_after"),
        F.sum("_docs").over(every).alias("docs_total"),
        F.sum("_tokens").over(every).alias("tokens_total"),
    )
    within = Window.partitionBy("_block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    docs_ge = F.col("_docs_after") + F.sum("docs").over(within)
    tokens_ge = F.col("_tokens_after") + F.sum(F.col("docs") * F.col("length")).over(within)
    summed = rows.join(blocks, "_block").select(
        "length", "docs", docs_ge.alias("docs_ge"), tokens_ge.alias("tokens_ge"), "docs_total", "tokens_total"
    )
    return summed.select(
        "*",
        (F.col("tokens_total") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_total"),
        ((F.col("docs_total") - F.col("docs_ge") + F.col("docs")) / F.col("docs_total")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Exact totals at arbitrary context limits from the suffix sums.

    One row per limit and non-empty histogram: ``limit, docs_over`` (longer
    than the limit), ``truncated_total``, ``docs_total, tokens_total``.
    """
    listed = F.array(*[F.lit(int(x)) for x in limits]).cast("array<long>")
    above = F.when(F.col("length") > F.col("limit"), F.struct("length", "docs_ge", "tokens_ge"))
    # The limits are a stated list; each length meets each of them once, map-side combined.
    met = sums.withColumn("limit", F.explode(F.array_distinct(listed))).groupBy("limit").agg(
        F.min(above).alias("next"), F.max("docs_total").alias("docs_total"), F.max("tokens_total").alias("tokens_total")
    )
    over, tokens_over = F.coalesce("next.docs_ge", F.lit(0)), F.coalesce("next.tokens_ge", F.lit(0))
    return met.select(
        "limit",
        over.alias("docs_over"),
        (F.col("tokens_total") - tokens_over + F.col("limit") * over).alias("truncated_total"),
        "docs_total",
        "tokens_total",
    )


def length_quantile(sums: DataFrame, share: float) -> DataFrame:
    """The least length that at least ``share`` of the documents do not exceed."""
    return sums.filter(F.col("quantile") >= share).agg(F.min("length").alias("length"))
