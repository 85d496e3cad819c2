"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, counts, decontam, html, lm, quality, simhash, spans, urls
from .common import table


def op1_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.document_scores(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.remove_repeats(docs, sentences=True).withColumn("n_chars", F.length("text").cast("long"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = f"{chat.END}{chat.BEGIN}assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_turns(rows))


def _digit(text: Column, place: int) -> Column:
    """Value of one hex digit of the text's MD5."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(text), place, 1)) - 1


def list_events(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts, made by a fixed rule."""
    host = F.col("host")
    hosts = pages.select(urls.host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    first, second, third = (_digit(host, k) for k in (1, 2, 3))

    def event(kind: str, value: Column, action: str, days: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), value.alias("value"), F.lit(action).alias("action"),
            F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int")).alias("at"),
        )

    start = second * 16 + third
    by_domain = [event("domain", host, "add", start), event("domain", host, "remove", start + 120), event("domain", host, "add", start + 300)]
    by_prefix = [event("prefix", F.concat(host, F.lit("/en")), "add", second * 16)]
    by_parent = [event("domain", F.expr("substring(host, instr(host, '.') + 1)"), "add", second * 30)]
    none = F.array().cast("array<struct<kind:string,value:string,action:string,at:date>>")
    chosen = (
        F.when(first < 4, F.array(*by_domain))
        .when(first < 8, F.array(*by_prefix))
        .when((first == 8) & (F.size(F.split("host", r"\.")) >= 4), F.array(*by_parent))
        .otherwise(none)
    )
    return hosts.select(F.inline(chosen))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr("date_add(date'2024-01-01', cast(page_id * 37 % 730 as int))"))
    return urls.evaluate(captures, list_events(pages))


_OP4_SQL = r"""
WITH pages1 AS (
  SELECT page_id, url, CAST(date '2024-01-01' + CAST(page_id * 37 % 730 AS integer) AS date) AS fetched_at,
         nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\.$', ''), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hosts AS (
  SELECT DISTINCT host,
         instr('0123456789abcdef', substr(md5(host), 1, 1)) - 1 AS d1,
         instr('0123456789abcdef', substr(md5(host), 2, 1)) - 1 AS d2,
         instr('0123456789abcdef', substr(md5(host), 3, 1)) - 1 AS d3
  FROM pages1 WHERE host IS NOT NULL),
events0 AS (
  SELECT 'domain' AS kind, host AS value, true AS on_, date '2024-01-01' + CAST(d2 * 16 + d3 AS integer) AS at_ FROM hosts WHERE d1 < 4
  UNION ALL SELECT 'domain', host, false, date '2024-01-01' + CAST(d2 * 16 + d3 + 120 AS integer) FROM hosts WHERE d1 < 4
  UNION ALL SELECT 'domain', host, true, date '2024-01-01' + CAST(d2 * 16 + d3 + 300 AS integer) FROM hosts WHERE d1 < 4
  UNION ALL SELECT 'prefix', host || '/en', true, date '2024-01-01' + CAST(d2 * 16 AS integer) FROM hosts WHERE d1 BETWEEN 4 AND 7
  UNION ALL SELECT 'domain', substr(host, instr(host, '.') + 1), true, date '2024-01-01' + CAST(d2 * 30 AS integer)
    FROM hosts WHERE d1 = 8 AND len(string_split(host, '.')) >= 4),
log1 AS (SELECT kind, value, at_, max(on_) AS on_ FROM events0 GROUP BY ALL),
log2 AS (SELECT *, lag(on_, 1, false) OVER (PARTITION BY kind, value ORDER BY at_) AS was FROM log1),
spans AS (
  SELECT * FROM (
    SELECT kind, value, on_, at_ AS valid_from, lead(at_) OVER (PARTITION BY kind, value ORDER BY at_) AS valid_to
    FROM log2 WHERE on_ <> was) WHERE on_),
met AS (
  SELECT p.page_id, s.kind || ':' || s.value AS entry
  FROM pages1 p JOIN spans s ON s.kind = 'domain' AND (p.host = s.value OR ends_with(p.host, '.' || s.value))
    AND p.fetched_at >= s.valid_from AND (s.valid_to IS NULL OR p.fetched_at < s.valid_to)
  UNION ALL
  SELECT p.page_id, s.kind || ':' || s.value
  FROM pages1 p JOIN spans s ON s.kind = 'prefix' AND starts_with(s.value, p.host || '/')
    AND starts_with(p.host || p.path || '/', s.value || '/')
    AND p.fetched_at >= s.valid_from AND (s.valid_to IS NULL OR p.fetched_at < s.valid_to)),
found AS (SELECT page_id, count(*) AS n_entries, min(entry) AS entry FROM met GROUP BY page_id)
SELECT p.page_id, p.url, p.fetched_at, f.page_id IS NOT NULL AS blocked, coalesce(f.n_entries, 0) AS n_entries, f.entry
FROM pages1 p LEFT JOIN found f USING (page_id)
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontam.build_index(table(spark, sf_dir, "documents"))
    found = decontam.search(index, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs).drop("text"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.apply_rules(docs, model).drop("text")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    return counts.suffix_sums(counts.length_histogram(bpe.token_counts(docs).select("n_tokens")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_scores": op1_lattice_scores,
    "op2_sentence_spans": op2_sentence_spans,
    "op3_chat_format": op3_chat_format,
    "op4_url_filters": op4_url_filters,
    "op5_decontaminate": op5_decontaminate,
    "op6_main_text": op6_main_text,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op9_simhash": op9_simhash,
    "op10_token_counts": op10_token_counts,
}

#: The other queries have no SQL form that runs on whole tables; they are tested by brute force.
ORACLE_SQL: dict[str, str] = {"op4_url_filters": _OP4_SQL}
