"""Mixing sources to target weights by entropy balancing.

Documents start with the rate 1 and are tilted exponentially in their size, so that each source's expected words
meet its target: the rate of a document of size x is min(3, exp(lambda * x)). That is the solution of the convex
problem that stays closest to rate 1 in relative entropy, under the token constraint of its source and rates of 3 at most; the bound adds to the
exponent a dual variable of the document, which is negative just where the bound holds and takes its rate to 3. So
the dual has one free lambda a source; its Newton steps, kept in brackets, are aggregations in Spark over the sizes of each
source and their numbers. Rates are then rounded into copies: systematic rounding along the sizes in each bucket
of a source leaves a difference of about one document a bucket.

Defined results: sizes count words; a null text has size 0; sources are ordered by code point, a null source is a
source of its own and the last one; targets share the words of all documents by weight, never above 3 times a
source's words; a source without words has target 0; ties in size are broken by a hash of id and text, and rows that are
equal in both may be taken in any order, with the same sum; the same rows give the same copies on every run and partitioning; an empty table gives an empty one; input columns with the names of result columns
are replaced, all others are passed on, whatever their names.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, named, numbered

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
#: Documents of one source that are rounded together, about.
BUCKET = 4096
#: Newton ends when each source's words are this close to its target, as a share of it, or after so many steps.
CLOSE, STEPS = 1e-7, 80


def size(text: str | Column = "text") -> Column:
    col = F.col(text) if isinstance(text, str) else text
    # a separator before a word marks its beginning, so only the beginnings are kept
    return F.coalesce(F.regexp_count(col, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """__source, __docs, __words, __target from the rows __source, __size, __n. One row for each source."""
    own = sizes.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__n")).alias("__words"), F.sum("__n").alias("__docs"))
    place = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1  # a row for each source, not for each document
    own = cut(own.withColumn("__weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int"))))
    words = F.col("__words").cast("double")
    total = own.agg(F.sum(words)).first()[0] or 0.0
    level = 0.0
    while True:  # level rises until no further source reaches its limit
        full = F.col("__weight") * F.lit(level) >= most * words
        fixed, open_ = own.agg(F.sum(F.when(full, most * words).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("__weight")))).first()
        if not open_ or (new := (total - fixed) / open_) <= level * (1 + 1e-12):
            break
        level = new
    return own.withColumn("__target", F.least(F.col("__weight") * F.lit(level), most * words))


def _rate(lam: Column, x: Column, most: float) -> Column:
    return F.least(F.lit(most), F.exp(F.least(lam * x, F.lit(700.0))))


def solve(sizes: DataFrame, aims: DataFrame, most: float = MOST) -> DataFrame:
    """aims with __scale and __lambda: the tilt of each source. sizes has the rows __source, __size, __n."""
    z = F.col("__size") / F.col("__scale")
    state = aims.select(
        F.col("__source").alias("__of"), "__words", "__docs", "__target", F.greatest(F.col("__words") / F.greatest("__docs", F.lit(1)), F.lit(1e-9)).alias("__scale"),
        F.lit(0.0).alias("__lambda"), F.lit(-1e9).alias("__low"), F.lit(1e9).alias("__high"),
    )
    same = F.col("__source").eqNullSafe(F.col("__of"))
    for _ in range(STEPS):
        r = _rate(F.col("__lambda"), z, most)
        step = sizes.join(state.select("__of", "__scale", "__lambda"), same).groupBy("__of").agg(
            F.sum(r * F.col("__size") * F.col("__n")).alias("__got"), F.sum(F.when(r < most, r * z * F.col("__size") * F.col("__n")).otherwise(0.0)).alias("__slope")
        ).withColumnRenamed("__of", "__at")
        gap = F.col("__got") - F.col("__target")
        low = F.when(gap < 0, F.greatest("__low", "__lambda")).otherwise(F.col("__low"))
        high = F.when(gap > 0, F.least("__high", "__lambda")).otherwise(F.col("__high"))
        newton = F.col("__lambda") - gap / F.col("__slope")
        # a step out of the bracket, or a long one, is replaced: double lambda while there is no bracket, else halve it
        far = F.when(gap < 0, F.when(F.col("__high") < 1e9, (low + high) / 2).otherwise(F.abs("__lambda") * 2 + 1)).otherwise(F.when(F.col("__low") > -1e9, (low + high) / 2).otherwise(-(F.abs("__lambda") * 2 + 1)))
        done = F.abs(gap) <= F.lit(CLOSE) * F.col("__target") + 1e-6
        limit = (F.col("__target") >= most * F.col("__words") * (1 - 1e-9)) | (F.col("__target") <= 0)  # lambda is infinite there
        next_ = F.when(done | limit, F.col("__lambda")).when((F.col("__slope") > 1e-12) & (newton > low) & (newton < high) & (F.abs(newton - F.col("__lambda")) < F.abs("__lambda") * 4 + 2), newton).otherwise(far)
        state = cut(state.join(step, F.col("__of").eqNullSafe(F.col("__at"))).withColumns({"__next": next_, "__l": low, "__h": high, "__open": ~(done | limit)}).select(
            "__of", "__words", "__docs", "__target", "__scale", F.col("__next").alias("__lambda"), F.col("__l").alias("__low"), F.col("__h").alias("__high"), "__open"))
        if not state.where("__open").limit(1).count():
            break
        state = state.drop("__open")
    else:
        warnings.warn(f"words of a source are not within {CLOSE} of its target after {STEPS} steps; the last ones are taken", stacklevel=2)
    top, none = F.col("__target") >= most * F.col("__words") * (1 - 1e-9), F.col("__target") <= 0
    return state.withColumn("__lambda", F.when(F.col("__words") == 0, 0.0).when(none, float("-inf")).when(top, float("inf")).otherwise(F.col("__lambda")))


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """All columns of docs, and __size, __words and __target of its source, __rate and __copies."""
    own = docs.select(*numbered(docs), F.col(source).cast("string").alias("__source"), size(text).alias("__size"), F.xxhash64(F.lit(77), F.col(key), F.col(text)).alias("__hash"), F.xxhash64(F.lit(78), F.col(key), F.col(text)).alias("__place"))
    # what Newton reads: how many documents of each size a source has
    sizes = cut(own.groupBy("__source", "__size").agg(F.count(F.lit(1)).alias("__n")))
    solved = solve(sizes, targets(sizes, weights, most), most).select("__of", "__words", "__docs", "__target", "__scale", "__lambda")
    infinite = F.abs("__lambda") == float("inf")
    rate = F.when(infinite, F.when(F.col("__lambda") > 0, most).otherwise(0.0)).otherwise(_rate(F.col("__lambda"), F.col("__size") / F.col("__scale"), most))
    met = own.join(solved, F.col("__source").eqNullSafe(F.col("__of"))).withColumn("__rate", rate)
    met = met.withColumn("__bucket", F.pmod("__place", F.ceil(F.col("__docs") / BUCKET)))
    w = Window.partitionBy("__source", "__bucket").orderBy("__size", "__hash", "__place")
    sofar = F.sum(F.col("__rate") - F.floor("__rate")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("__whole", F.floor(sofar + 0.5))
    extra = F.col("__whole") - F.coalesce(F.lag("__whole").over(w), F.lit(0))
    copies = F.least(F.floor("__rate") + F.greatest(extra, F.lit(0)), F.lit(math.floor(most))).cast("int")
    added = ("__size", "__words", "__target", "__rate", "__copies")
    return met.withColumn("__copies", copies).select(*named(docs, added), *added)


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The documents of a mix, each as often as it is taken."""
    return mixed.where("__copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")
