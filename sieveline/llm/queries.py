"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, byte_bpe, html_extract, langid, line_dedup, mixing, quality, secret_ledger, topk, url_filter
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are boilerplate of its source."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", F.col("__n_dropped").alias("n_dropped"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of each vector whose id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document, and of what they decode to."""
    return byte_bpe.digests(table(spark, sf_dir, "documents"), *byte_bpe.default_files())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdicts of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.verdicts(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("__size").alias("size"), F.col("__words").cast("long").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).cast("long").alias("taken"), F.col("__rate").alias("rate")
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document."""
    return bagminhash.classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs, langid.fit(docs))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by a ledger that is empty before."""
    paths, entries = secret_ledger.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return secret_ledger.findings(paths, entries)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_topk_search, op3_url_filters, op4_byte_bpe, op5_quality_rules, op6_source_mixing, op7_html_extraction, op8_minhash_near_dedup, op9_language_id, op10_secret_scans)}

TOPK_SQL = """
WITH v AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.k <> c.k WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

SQL = {"op1_line_dedup": line_dedup.SQL, "op2_topk_search": TOPK_SQL}
