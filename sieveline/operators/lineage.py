"""Links by shared ids, with a cut-off for crowds; clusters by shared attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N

#: Larger groups are counted instead of paired.
CROWD = 8


def siblings(ids: DataFrame, kind: str = "same document", crowd: int = CROWD) -> DataFrame:
    """path, kind, others and count from (path, id): in groups of more than crowd others only the count is given.

    The size of a group is counted first, so a hot id never meets itself in a join.
    """
    own = ids.where("id is not null").select("path", "id").distinct()
    size = own.groupBy("id").agg(F.count("*").alias("n"))
    sized = own.join(size, "id").where("n > 1")
    small = sized.where(F.col("n") - 1 <= crowd)
    pairs = small.select("path", "id").join(small.select(F.col("path").alias("other"), "id"), "id").where("path <> other")
    linked = pairs.groupBy("path").agg(F.sort_array(F.collect_set("other")).alias("others"))
    many = sized.where(F.col("n") - 1 > crowd).select("path", F.expr("cast(array() as array<string>)").alias("others"), (F.col("n") - 1).alias("count"))
    return linked.select("path", "others", F.size("others").cast("long").alias("count")).unionByName(many).select("path", F.lit(kind).alias("kind"), "others", "count")


def parents(ids: DataFrame, claims: DataFrame, crowd: int = CROWD) -> DataFrame:
    """child and parent: claims (path, parent_id) met with ids (path, id), where an id has at most crowd holders."""
    own = ids.where("id is not null").select(F.col("path").alias("parent"), "id").distinct()
    rare = own.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") <= crowd).select("id")
    return claims.select(F.col("path").alias("child"), F.col("parent_id").alias("id")).join(own.join(rare, "id", "left_semi"), "id").where("child <> parent").select("child", "parent").distinct()


def clusters(attributes: DataFrame, least: int = 2) -> DataFrame:
    """axis, name and number of paths from (axis, name, path, seq): names that differ in case are one; the first spelling shows."""
    own = attributes.where("name is not null").withColumn("key", N.name(F.col("name")))
    return own.groupBy("axis", "key").agg(F.min_by("name", F.struct("seq", "path")).alias("name"), F.count_distinct("path").alias("paths")).where(F.col("paths") >= least)


# Kinds of lineage from the surest on, and for matches of stated ids what is looked up in which index.
KINDS = ("derived from", "source of", "same document", "descends from", "original of", "common ancestor")
DOCUMENT, INSTANCE, ORIGINAL = "xmpMM:DocumentID", "xmpMM:InstanceID", "xmpMM:OriginalDocumentID"
FROM_DOCUMENT, FROM_INSTANCE = "xmpMM:DerivedFrom/stRef:documentID", "xmpMM:DerivedFrom/stRef:instanceID"
MATCHES = (("same document", DOCUMENT, DOCUMENT), ("descends from", ORIGINAL, DOCUMENT), ("original of", DOCUMENT, ORIGINAL), ("common ancestor", ORIGINAL, ORIGINAL))


def meaningful(value: Column) -> Column:
    """An id of at least 8 letters and digits behind its scheme that aren't all zero, else null."""
    body = F.regexp_replace(F.regexp_extract(value, r"([^:]*)$", 1), r"[^\p{L}\p{N}]", "")
    return F.when((F.length(body) >= 8) & ~body.rlike("^0*$"), value)


def links(evidence: DataFrame, crowd: int = CROWD) -> DataFrame:
    """path, kind, others and count of the files that a file is tied to by its first XMP record.

    A pair is linked by its surest kind only. An id that more than crowd others have is counted and never meets
    itself: its files get the count without names.
    """
    stated = evidence.where("block = 'xmp'").groupBy("path").agg(F.min_by("fields", "seq").alias("f"))
    ids = stated.select("path", *[meaningful(F.col("f")[k]).alias(n) for n, k in (("d", DOCUMENT), ("i", INSTANCE), ("o", ORIGINAL), ("fd", FROM_DOCUMENT), ("fi", FROM_INSTANCE))])
    index = lambda c: ids.where(F.col(c).isNotNull()).select(F.col("path").alias("other"), F.col(c).alias("id"))
    size = lambda c: index(c).groupBy("id").agg(F.count("*").alias("n"))
    claim = lambda mine, theirs: parents(index(theirs).select(F.col("other").alias("path"), "id"), ids.where(F.col(mine).isNotNull()).select("path", F.col(mine).alias("parent_id")), crowd)
    up = claim("fd", "d").unionByName(claim("fi", "i")).distinct()
    pairs = up.select(F.col("child").alias("path"), F.col("parent").alias("other"), F.lit(0).alias("rank")).unionByName(up.select(F.col("parent").alias("path"), F.col("child").alias("other"), F.lit(1).alias("rank")))
    crowds = None
    column = {DOCUMENT: "d", ORIGINAL: "o"}
    for rank, (_, mine, theirs) in enumerate(MATCHES, 2):
        own = ids.where(F.col(column[mine]).isNotNull()).select("path", F.col(column[mine]).alias("id")).join(size(column[theirs]), "id")
        many = own.where(F.col("n") - 1 > crowd).select("path", F.lit(rank).alias("rank"), (F.col("n") - 1).alias("count"))
        crowds = many if crowds is None else crowds.unionByName(many)
        few = own.where(F.col("n") - 1 <= crowd).select("path", "id").join(index(column[theirs]), "id").where("path <> other").select("path", "other", F.lit(rank).alias("rank"))
        pairs = pairs.unionByName(few)
    # both halves of a derivation stay: each end names the other in its own words
    best = pairs.groupBy("path", "other").agg(F.min("rank").alias("rank"), F.collect_set(F.when(F.col("rank") < 2, F.col("rank"))).alias("both"))
    told = best.select("path", "other", F.explode(F.when(F.size("both") > 0, F.col("both")).otherwise(F.array("rank"))).alias("rank"))
    named = told.groupBy("path", "rank").agg(F.sort_array(F.collect_set("other")).alias("others"))
    every = named.select("path", "rank", "others", F.size("others").cast("long").alias("count")).unionByName(crowds.select("path", "rank", F.expr("cast(array() as array<string>)").alias("others"), F.col("count").cast("long").alias("count")))
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("rank"))
    return every.select("path", kind.alias("kind"), "others", "count")
