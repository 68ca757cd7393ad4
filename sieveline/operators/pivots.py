"""Mentions, identifiers and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import addresses, detect


def spread(rows: DataFrame) -> DataFrame:
    """Deal the texts out to all cores before the patterns run, where the files behind them are too few splits for that."""
    session = rows.sparkSession
    if rows.isStreaming:
        return rows
    cores, split = session.sparkContext.defaultParallelism, int(session._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows if size >= cores * split else rows.repartition(cores)


def mentions(passages: DataFrame, types: set[str] | None = None) -> DataFrame:
    """path, seq, pos, type, raw, normalized and private: all detectors in one pass over the texts.

    With a column `where` in passages, it is the name of the field that a text comes from. What big checksums prove is
    found in the same pass; only its candidates go through Python.
    """
    text, where = F.col("text"), F.col("where") if "where" in passages.columns else None
    found = detect.mentions(text, types, where)
    own = spread(passages)
    if types is None or types & PROVED:
        some = own.select("path", "seq", found.alias("m"), addresses.candidates(text).alias("c"))
        proved = F.when(F.size("c") > 0, addresses.prove(F.when(F.size("c") > 0, F.col("c"))))
        if types is not None:
            proved = F.filter(proved, lambda m: m["type"].isin(*sorted(types & PROVED)))
        own = some.select("path", "seq", F.posexplode(F.concat("m", F.coalesce(proved, F.expr("cast(array() as " + addresses.FOUND + ")")))).alias("pos", "m"))
    else:
        own = own.select("path", "seq", F.posexplode(found).alias("pos", "m"))
    return own.select("path", "seq", "pos", "m.type", "m.raw", "m.normalized", "m.private")


#: Types that addresses.py proves.
PROVED = frozenset({"btc", "ltc", "doge", "bch", "xmr", "eth", "onion", "ipv6"})


def identifiers(found: DataFrame) -> DataFrame:
    """One row for each value: the spelling seen first, how often, and in how many files."""
    order = F.struct("path", "seq", "pos")
    return found.groupBy("type", "normalized").agg(F.min_by("raw", order).alias("value"), F.count("*").alias("count"), F.count_distinct("path").alias("files"))


def shared(ids: DataFrame) -> DataFrame:
    """Values of several files."""
    return ids.where("files > 1")


def by_type(ids: DataFrame) -> DataFrame:
    return ids.groupBy("type").agg(F.count("*").alias("values"), F.sum("count").alias("mentions"))


def dense(found: DataFrame, least: int = 50) -> DataFrame:
    """Files with many mentions."""
    return found.groupBy("path").agg(F.count("*").alias("mentions"), F.count_distinct("type").alias("types")).where(F.col("mentions") >= least)


def holders(found: DataFrame) -> DataFrame:
    """Edges from files to the values they hold."""
    return found.groupBy("path", "type", "normalized").agg(F.count("*").alias("count"))


def email_digests(ids: DataFrame) -> DataFrame:
    """email, type and normalized: the digests of each address."""
    mails = ids.where("type = 'email'").select(F.col("normalized").alias("email"))
    made = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("normalized"))
    return mails.select("email", F.explode(F.array(made("md5", F.md5("email")), made("sha1", F.sha1("email")), made("sha256", F.sha2("email", 256)))).alias("d")).select("email", "d.*")


def digests_of_emails(ids: DataFrame) -> DataFrame:
    """Emails whose MD5, SHA-1, SHA-256 or SHA-512 is a digest that was found."""
    more = ids.where("type = 'email'").select(F.col("normalized").alias("email"), F.lit("sha512").alias("type"), F.sha2("normalized", 512).alias("normalized"))
    return email_digests(ids).unionByName(more).join(ids.select("type", "normalized"), ["type", "normalized"]).select("email", "type", "normalized")
