"""Joins of files and traces, agreement of records, time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import vocabulary as V


def origin_states(addressed: DataFrame) -> DataFrame:
    """State of each path from its origin records (path, url): single source, agreement, partial agreement or conflict.

    Each address is normalised once; its least and greatest key and host decide, so one partial aggregation does.
    A url without a known host takes no part in the agreement of hosts.
    """
    own = addressed.where("url is not null and url <> ''").select("path", F.col("url").alias("raw"), N.url(F.col("url")).alias("normal"))
    key = F.coalesce(F.regexp_replace("normal", "/+$", ""), F.lower(F.regexp_replace("raw", "/+$", "")))
    own = own.select("path", key.alias("key"), N.domain(F.regexp_extract("normal", r"^[^:]+://(\[[^\]]*\]|[^/?#:]*)", 1)).alias("host"))
    n = own.groupBy("path").agg(F.count("*").alias("records"), F.min("key").alias("k0"), F.max("key").alias("k1"), F.min("host").alias("h0"), F.max("host").alias("h1"))
    state = F.when(F.col("records") == 1, "single source").when(F.col("k0") == F.col("k1"), "agreement").when(F.col("h0") == F.col("h1"), "partial agreement").otherwise("conflict")
    return n.select("path", "records", state.alias("state"))


def by_path_else_name(files: DataFrame, traces: DataFrame) -> DataFrame:
    """Traces (target, bytes) of files (path, name, size): by path, and by name for files without a trace of their path."""
    exact = files.join(traces, F.col("path") == F.col("target")).select("path", "target", F.lit("recorded-path").alias("basis"))
    rest = files.join(traces, F.col("path") == F.col("target"), "left_anti")
    named = rest.join(traces, F.col("name") == N.basename(F.col("target"))).select("path", "target", F.when(F.col("bytes") == F.col("size"), "name+size").otherwise("filename").alias("basis"))
    return exact.unionByName(named)


def leading(evidence: DataFrame) -> DataFrame:
    """The record of each path and category that comes first: by priority, then the later one, then the smaller number."""
    tool = F.col("tool") if "tool" in evidence.columns else None
    own = evidence.withColumns({"category": V.category(F.col("source"), tool), "priority": V.priority(F.col("source"))})
    return own.groupBy("path", "category").agg(F.max_by(F.struct("seq", "source"), F.struct("priority", F.coalesce("at", F.lit("0001-01-01").cast("timestamp")), -F.col("seq"))).alias("r")).select("path", "category", "r.seq", "r.source")


def inherited(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """Members (path, carrier) with the leading origin of their carrier, else their bare membership."""
    top = leaders.where("category = 'origin'").select(F.col("path").alias("carrier"), F.col("source").alias("via"))
    return members.join(top, "carrier", "left").select("path", "carrier", F.coalesce("via", F.lit("archive-member")).alias("origin"))


def time_conflicts(evidence: DataFrame, minutes: int = 5) -> DataFrame:
    """Paths whose metadata is later than their first arrival by more than some minutes."""
    own = evidence.withColumn("category", V.category(F.col("source")))
    ends = own.groupBy("path").agg(F.min(F.when(F.col("category") == "origin", F.col("at"))).alias("arrived"), F.max(F.when(F.col("category") == "metadata", F.col("at"))).alias("authored"))
    return ends.where(F.col("authored") > F.col("arrived") + F.make_dt_interval(mins=F.lit(minutes)))


def first_inversion(steps: DataFrame, value: str = "value") -> DataFrame:
    """The first step of each path, in the order of seq, that goes backwards."""
    w = Window.partitionBy("path").orderBy("seq")
    back = steps.withColumn("before", F.lag(value).over(w)).where(F.col(value) < F.col("before"))
    return back.groupBy("path").agg(F.min("seq").alias("seq"))


def timeline(evidence: DataFrame) -> DataFrame:
    """Dated records with their place in time; undated ones last."""
    w = Window.partitionBy("path").orderBy(F.col("at").asc_nulls_last(), "seq")
    return evidence.select("path", "seq", "source", N.stamp(F.col("at")).alias("at"), F.row_number().over(w).alias("place"))


def same_second(evidence: DataFrame) -> DataFrame:
    """Seconds that several paths share."""
    return evidence.where("at is not null").groupBy(N.stamp(F.col("at")).alias("at")).agg(F.count_distinct("path").alias("paths"), F.count("*").alias("records")).where("paths > 1")


def horizon(evidence: DataFrame) -> DataFrame:
    """Records and oldest record of each source, also of sources without any."""
    spark = evidence.sparkSession
    every = spark.createDataFrame([(s,) for s in V.SOURCES], "source string")
    n = evidence.where(F.col("source").isin(*V.SOURCES)).groupBy("source").agg(F.count("*").alias("records"), N.stamp(F.min("at")).alias("oldest"))  # a row for each known source at most
    return every.join(F.broadcast(n), "source", "left").select("source", F.coalesce("records", F.lit(0)).alias("records"), "oldest", F.when(F.coalesce("records", F.lit(0)) > 0, "searched").otherwise("unavailable").alias("state"))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Fields (field, value) of two files: shared, differing, or of one only; a field's first value counts."""
    both = left.select("field", F.col("value").alias("left")).join(right.select("field", F.col("value").alias("right")), "field", "full")
    return both.select("field", "left", "right", F.when(F.col("left") == F.col("right"), "shared").when(F.col("left").isNull(), "right only").when(F.col("right").isNull(), "left only").otherwise("differing").alias("verdict"))


def by_name_and_size(files: DataFrame, members: DataFrame) -> DataFrame:
    """Members (container, name, size) of archives or torrents that are files (path, name, size) here."""
    return files.select("path", "name", "size").join(members.select("container", "name", "size"), ["name", "size"]).where("path <> container").select("path", "container").distinct()


def by_id_else_name(files: DataFrame, events: DataFrame) -> DataFrame:
    """Events (event, id, name) of files (path, id, name): by id, and by name for files whose id no event has."""
    exact = files.join(events.where("id is not null").select("event", "id"), "id").select("path", "event", F.lit("id").alias("basis"))
    rest = files.join(exact.select("path").distinct(), "path", "left_anti")
    return exact.unionByName(rest.join(events.select("event", "name"), "name").select("path", "event", F.lit("name").alias("basis")))


def by_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """path and the first root (root, seq) that contains it, by whole parts of the path.

    Each path meets the roots by its own beginnings, so this is an equi-join of as many rows as paths have parts.
    """
    parts = F.split("path", "/")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    own = files.where(F.col("path").contains("/")).select("path", F.explode(begins).alias("root"))
    met = own.join(roots.select(F.regexp_replace("root", "/+$", "").alias("root"), "seq"), "root")
    return met.groupBy("path").agg(F.min_by("root", "seq").alias("root"))


def by_sibling(files: DataFrame, ending: str) -> DataFrame:
    """path and sidecar: files next to which one stands that has their name without its suffix and the ending."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    sidecars = files.where(F.col("path").endswith(ending)).select(F.col("path").alias("sidecar"), F.expr(f"left(path, length(path) - {len(ending)})").alias("stem"))
    return files.where(~F.col("path").endswith(ending)).select("path", stem.alias("stem")).join(sidecars, "stem").select("path", "sidecar")


def shortcuts(files: DataFrame, links: DataFrame) -> DataFrame:
    """Links (name, opened_from, bytes) to files (path, name, size): the path itself, name and size, or the name alone."""
    basis = F.when(F.col("opened_from") == F.col("path"), "recorded-path").when(F.col("bytes") == F.col("size"), "name+size").otherwise("filename")
    return files.select("path", "name", "size").join(links.select("name", "opened_from", "bytes"), "name").select("path", "opened_from", basis.alias("basis"))


def origin_urls(evidence: DataFrame, ids: DataFrame) -> DataFrame:
    """source, target, kind and count: origin records whose url or referrer is a known identifier."""
    own = evidence.where(V.category(F.col("source"), F.col("tool")) == "origin")
    said = own.select("path", F.explode(F.array(F.struct(F.lit("origin URL").alias("kind"), F.col("url").alias("raw")), F.struct(F.lit("referrer").alias("kind"), F.col("referrer").alias("raw")))).alias("u")).select("path", "u.kind", N.url(F.col("u.raw")).alias("normalized"))
    known = said.where("normalized is not null").join(ids.where("type = 'url'").select("normalized"), "normalized", "left_semi")
    return known.groupBy(F.concat(F.lit("file:"), F.col("path")).alias("source"), F.concat(F.lit("url:"), F.col("normalized")).alias("target"), "kind").agg(F.count("*").alias("count"))
