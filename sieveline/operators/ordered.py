"""Running numbers and running sums over a whole table, without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def running(rows: DataFrame, order: list[Column], value: Column | None = None, parts: int | None = None) -> DataFrame:
    """rows with place (from 1 on, in the order) and, of a value, before: its sum over all rows in front.

    Rows are dealt out by ranges of the order; each range is numbered on its own and shifted by what the ranges before it
    hold, which is one short row for each range. Rows that are equal in the order may come in any order. Spark draws the
    bounds of ranges from a sample, another one each time it runs; so the dealt rows are written once, for all that read them.
    """
    session = rows.sparkSession
    n = parts or int(session.conf.get("spark.sql.shuffle.partitions"))
    own = rows.withColumn("__v", F.coalesce(value, F.lit(0)) if value is not None else F.lit(0))
    dealt = cut(own.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumns({"__at": F.count(F.lit(1)).over(w), "__sum": F.coalesce(F.sum("__v").over(w), F.lit(0))})
    sizes = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.sum("__v").alias("__s"))
    ranges = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    shift = sizes.select(F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(ranges), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(ranges), F.lit(0)).alias("__s0"))
    met = numbered.join(F.broadcast(shift), F.col("__part") == F.col("__of"))  # at most n rows
    out = {"place": (F.col("__at") + F.col("__n0") + 1).cast("long")} | ({"before": F.col("__sum") + F.col("__s0")} if value is not None else {})
    return met.withColumns(out).drop("__v", "__part", "__at", "__sum", "__of", "__n0", "__s0")


def reference(place: Column, mark: str = "#", width: int = 3) -> Column:
    """#001, F01, P12: running numbers with at least so many digits."""
    k = place.cast("string")
    return F.concat(F.lit(mark), F.when(F.length(k) < width, F.lpad(k, width, "0")).otherwise(k))


def within_budget(rows: DataFrame, order: list[Column], size: Column, most: int) -> DataFrame:
    """The rows in front of which less than the allowance was used, in the order."""
    return running(rows, order, size).where(F.col("before") < most).drop("place", "before")
