"""Corpus pipeline: quality rules, line dedup, near dedup, mixing, byte-level BPE. Counted as part of sieveline.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents and
leave out any other column, whatever its name. n_chars follows the text.

Defined results: a document without text or with too few words goes in the first stage; a row without an id that passes it is kept
by all others; rows that repeat an id are judged one by one, and near dedup keeps one of them; texts of any length go through whole;
an empty table gives an empty one in each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bagminhash, byte_bpe, line_dedup, mixing, quality
from sieveline.llm.common import table, use_checkpoints

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the isolation forest finds anomalous go."""
    return quality.keep(docs.select(*COLUMNS), quality.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go."""
    return line_dedup.line_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return bagminhash.near_dedup(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row."""
    return byte_bpe.encode(docs, *byte_bpe.default_files())


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("near dedup", dedup_near), ("source mixing", mix_sources), ("byte BPE", encode_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared checkpoint folder and read again by the next one, after which it goes."""
    use_checkpoints(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs


#: The forest, the signatures and the merges have no SQL; tests hold run() against plain Python.
ORACLE_SQL = None
