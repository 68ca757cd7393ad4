"""Inventory, tallies, references, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .ordered import reference, running


def inventory(files: DataFrame) -> DataFrame:
    return files.groupBy(V.format_name(F.col("path")).alias("format")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def families(files: DataFrame) -> DataFrame:
    return files.groupBy(V.family(F.col("path")).alias("family")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def tallies(evidence: DataFrame) -> DataFrame:
    """How many paths have records of each category, and dated ones, in one pass."""
    own = evidence.withColumn("category", V.category(F.col("source"))).groupBy("path").agg(*[F.bool_or(F.col("category") == c).alias(c) for c in ("origin", "metadata", "activity")], F.bool_or(F.col("at").isNotNull()).alias("dated"))
    total = own.agg(*[F.count_if(c).alias(c) for c in ("origin", "metadata", "activity", "dated")])
    return total.selectExpr("stack(4, 'origin', origin, 'metadata', metadata, 'activity', activity, 'dated', dated) as (tally, files)")


def copies(files: DataFrame) -> DataFrame:
    """Contents that several files have."""
    return files.where("size > 0").groupBy("sha256").agg(F.count("*").alias("files"), F.min("path").alias("first"), F.max("size").alias("size")).where("files > 1")


def references(files: DataFrame) -> DataFrame:
    """path and its reference #001, ... in the order of falling size, then path."""
    return running(files.select("path", "size"), [F.desc("size"), F.col("path").asc()]).select("path", reference(F.col("place")).alias("ref"))


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of 1 to 500 rows."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit is 1 to 500, offset is not negative")
    return rows.orderBy(*order).offset(offset).limit(limit)


def budget(passages: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Passages up to a number of characters for each path; the one that reaches it is cut."""
    w = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = passages.withColumn("used", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("long"))
    return own.where(F.col("used") < most).select("path", "seq", F.substring("text", F.lit(1), (F.lit(most) - F.col("used")).cast("int")).alias("text"))
