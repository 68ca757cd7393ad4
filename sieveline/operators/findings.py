"""What the records of a file say about each other: findings, states and conflicts.

Evidence has the columns path, seq, source, block, tool, at (text), url, match, bytes, fields (a map) and size (of the
file). A finding has path, rank (its place among the findings of a file), kind, field, left, right and maintained.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import moments as M
from ..functions import vocabulary as V
from .correlate import origin_states

# Kinds of findings in order, those that are conflicts; fields of a block that say when it was made and changed.
KINDS = ("corroboration", "source_conflict", "path_disagreement", "timeline_conflict", "weak_match", "size_mismatch", "size_corroboration", "attribution_conflict", "impossible_order")
CONFLICTS = ("source_conflict", "path_disagreement", "timeline_conflict", "size_mismatch", "attribution_conflict", "impossible_order")
MADE_AND_CHANGED = {"pdf-info": ("CreationDate", "ModDate"), "ooxml-properties": ("created", "modified"), "xmp": ("xmp:CreateDate", "xmp:ModifyDate")}
# Fields of two blocks that say one thing, and the block that editors keep current.
MIRRORS = (
    ("iptc", "xmp", "xmp", (
        ("By-line", "dc:creator"), ("By-lineTitle", "photoshop:AuthorsPosition"), ("Credit", "photoshop:Credit"), ("Source", "photoshop:Source"), ("CopyrightNotice", "dc:rights"), ("Headline", "photoshop:Headline"),
        ("Caption-Abstract", "dc:description"), ("ObjectName", "dc:title"), ("Keywords", "dc:subject"), ("City", "photoshop:City"), ("Province-State", "photoshop:State"), ("Country-PrimaryLocationName", "photoshop:Country"),
        ("SpecialInstructions", "photoshop:Instructions"), ("OriginalTransmissionReference", "photoshop:TransmissionReference"), ("Writer-Editor", "photoshop:CaptionWriter"), ("Urgency", "photoshop:Urgency"), ("Category", "photoshop:Category"),
    ), (("DateCreated", "photoshop:DateCreated"),)),
    ("exif", "xmp", "xmp", (
        ("Make", "tiff:Make"), ("Model", "tiff:Model"), ("Software", "tiff:Software"), ("Artist", "tiff:Artist"), ("Artist", "dc:creator"), ("Copyright", "tiff:Copyright"), ("ImageDescription", "dc:description"),
        ("LensModel", "aux:Lens"), ("BodySerialNumber", "aux:SerialNumber"),
    ), (("DateTimeOriginal", "exif:DateTimeOriginal"), ("DateTimeDigitized", "exif:DateTimeDigitized"))),
    ("pdf-info", "xmp", None, (("Title", "dc:title"), ("Author", "dc:creator"), ("Subject", "dc:description"), ("Keywords", "pdf:Keywords"), ("Creator", "xmp:CreatorTool")), (("CreationDate", "xmp:CreateDate"), ("ModDate", "xmp:ModifyDate"))),
    ("png-text", "xmp", None, (("Title", "dc:title"), ("Author", "dc:creator"), ("Description", "dc:description"), ("Copyright", "dc:rights"), ("Software", "xmp:CreatorTool")), (("Creation Time", "xmp:CreateDate"),)),
)

def _row(kind, field=None, left=None, right=None, maintained=None, rank: Column | int = 0) -> list[Column]:
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x.cast("string")
    return ["path", (F.lit(rank) if isinstance(rank, int) else rank).cast("long").alias("rank"), text(kind).alias("kind"), text(field).alias("field"), text(left).alias("left"), text(right).alias("right"), text(maintained).alias("maintained")]


def _categorised(evidence: DataFrame) -> DataFrame:
    return evidence.withColumn("category", V.category(F.col("source"), F.col("tool")))


def address_findings(evidence: DataFrame) -> DataFrame:
    """One corroboration for a file whose addresses agree, else a finding for each of its addressed origins."""
    own = _categorised(evidence).where("category = 'origin' and url is not null and url <> ''")
    state = origin_states(own).where("state <> 'single source'").select("path", "state")
    met = own.join(state, "path")
    agree = met.where("state = 'agreement'").groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq", "source"))).alias("r"))
    one = agree.select(*_row("corroboration", "origin URL", F.get("r", F.lit(0))["source"], F.get("r", F.lit(1))["source"]))
    kind = F.when(F.col("state") == "partial agreement", "path_disagreement").otherwise("source_conflict")
    return one.unionByName(met.where("state <> 'agreement'").select(*_row(kind, "origin URL", F.col("source"), F.col("url"), rank=F.col("seq"))))


def time_findings(evidence: DataFrame) -> DataFrame:
    """Files that say they were made after they arrived."""
    first, last = F.min(F.when(F.col("category") == "origin", F.nullif("at", F.lit("")))), F.max(F.when(F.col("category") == "metadata", F.nullif("at", F.lit(""))))
    ends = _categorised(evidence).groupBy("path").agg(first.alias("arrived"), last.alias("authored"))
    return ends.where(M.created_after(F.col("authored"), F.col("arrived"))).select(*_row("timeline_conflict", None, F.col("authored"), F.col("arrived")))


def order_findings(evidence: DataFrame) -> DataFrame:
    """Blocks that were changed before they were made, by their own account."""
    pick = lambda i: functools.reduce(lambda c, kv: c.when(F.col("block") == kv[0], F.col("fields")[kv[1][i]]), MADE_AND_CHANGED.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    name = functools.reduce(lambda c, kv: c.when(F.col("block") == kv[0], " / ".join(kv[1])), MADE_AND_CHANGED.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    own = evidence.withColumns({"made": pick(0), "changed": pick(1)})
    return own.where(M.after(F.col("made"), F.col("changed"))).select(*_row("impossible_order", name, F.col("made"), F.col("changed"), rank=F.col("seq")))


def history_findings(evidence: DataFrame) -> DataFrame:
    """The first step of each editing history that is dated before the one it follows."""
    w = Window.partitionBy("path").orderBy("seq")
    steps = evidence.where("source = 'xmp-history' and at is not null and at <> ''").withColumn("before", F.lag("at").over(w)).where(M.after(F.col("before"), F.col("at")))
    first = steps.groupBy("path").agg(F.min_by(F.struct("before", "at"), "seq").alias("s"))
    return first.select(*_row("impossible_order", None, F.col("s.before"), F.col("s.at")))


def match_findings(evidence: DataFrame) -> DataFrame:
    """How firmly origins that were matched by name are tied to their file."""
    basis = F.coalesce(F.nullif("match", F.lit("")), V.default_match(F.col("source")))
    own = _categorised(evidence).where("category = 'origin'").withColumn("basis", basis).where("basis in ('filename', 'name+size')")
    differs = F.coalesce((F.col("bytes") > 0) & (F.col("bytes") != F.col("size")), F.lit(False))
    kind = F.when(differs, "size_mismatch").when(F.col("basis") == "name+size", "size_corroboration").otherwise("weak_match")
    field = F.when(kind == "weak_match", "match").otherwise("size")
    return own.select(*_row(kind, field, F.when(differs, F.col("bytes").cast("string")), F.when(differs, F.col("size").cast("string")), rank=F.col("seq")))


def attribution_findings(evidence: DataFrame) -> DataFrame:
    """Fields in which two blocks of one file, which are meant to say the same, differ.

    The first record of a block counts; names of fields are compared without case. Both sides are short rows of one file, so
    the two joins are by path and block only.
    """
    blocks = sorted({b for m in MIRRORS for b in m[:2]})
    first = evidence.where(F.col("block").isin(*blocks)).groupBy("path", "block").agg(F.min_by("fields", "seq").alias("fields"))
    # of names that differ in case only, the one that comes last is the one that is kept
    lowered = F.map_from_entries(F.transform(F.map_entries("fields"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    named = first.withColumn("fields", F.when(F.size("fields") > 0, lowered))
    out = []
    for k, (left, right, kept, texts, times) in enumerate(MIRRORS):
        a, b = named.where(F.col("block") == left).select("path", F.col("fields").alias("a")), named.where(F.col("block") == right).select("path", F.col("fields").alias("b"))
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.col("a")[n.lower()].alias("said"), F.col("b")[o.lower()].alias("also"), F.lit(i >= len(texts)).alias("time")) for i, (n, o) in enumerate((*texts, *times))])
        met = a.join(b, "path").select("path", F.explode(pairs).alias("p")).where("p.said <> '' and p.also <> ''").select("path", "p.*")
        plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
        agree = F.when(F.col("time"), M.same_moment(F.col("said"), F.col("also"))).otherwise(plain(F.col("said")) == plain(F.col("also")))
        out.append(met.where(~agree).select(*_row("attribution_conflict", F.col("name"), F.col("said"), F.col("also"), kept, rank=F.col("i") + 100 * k)))
    return functools.reduce(DataFrame.unionByName, out)


def findings(evidence: DataFrame) -> DataFrame:
    """All findings of all files; place numbers those of one file in the order of the rules."""
    rules = (address_findings, time_findings, order_findings, history_findings, match_findings, attribution_findings)
    every = functools.reduce(DataFrame.unionByName, [rule(evidence).withColumn("rule", F.lit(i)) for i, rule in enumerate(rules)])
    w = Window.partitionBy("path").orderBy("rule", "rank", "field", "left", "right")
    return every.withColumn("place", F.row_number().over(w)).select("path", "place", "kind", "field", "left", "right", "maintained")


def verdicts(evidence: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """path, state of its addresses, headline, contested and notable of every path with evidence."""
    found = findings(evidence) if found is None else found
    kinds = found.groupBy("path").agg(F.collect_set("kind").alias("kinds"))
    addressed = _categorised(evidence).where("category = 'origin' and url is not null and url <> ''")
    states = evidence.select("path").distinct().join(origin_states(addressed).select("path", "state"), "path", "left").join(kinds, "path", "left")
    has = lambda k: F.coalesce(F.array_contains("kinds", k), F.lit(False))
    state = F.coalesce("state", F.lit("no origin record"))
    spoken = state.isin("agreement", "partial agreement", "conflict")
    headline = F.when(spoken, state).when(has("attribution_conflict"), "contested").when(has("impossible_order"), "self-contradictory").otherwise(state)
    contested = state.isin("partial agreement", "conflict") | F.coalesce(F.arrays_overlap("kinds", F.array(*[F.lit(c) for c in CONFLICTS])), F.lit(False))
    return states.select("path", state.alias("state"), headline.alias("headline"), contested.alias("contested"), (spoken | F.coalesce(F.size("kinds") > 0, F.lit(False))).alias("notable"))


def conflicts(evidence: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The conflicting findings of contested files, with how far apart two moments are."""
    found = findings(evidence) if found is None else found
    a, b = M.instant(F.col("left")), M.instant(F.col("right"))
    return found.where(F.col("kind").isin(*CONFLICTS)).withColumn("apart", F.when(a.isNotNull() & b.isNotNull(), M.apart(a, b)))
