"""What a whole case says: tallies, alerts, thresholds, pivots across corpora, comparison of two files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import moments as M
from ..functions import normalize as N
from ..functions import vocabulary as V
from .ordered import reference

# Fields of a block that name a person; stamps that mean nothing; declared sources that a model made; fields that tell devices and people.
AUTHORS = {"pdf-info": ("Author",), "ooxml-properties": ("creator", "lastModifiedBy"), "exif": ("Artist", "CameraOwnerName"), "xmp": ("dc:creator",), "iptc": ("By-line",), "png-text": ("Author",), "id3": ("TPE1",), "odf-meta": ("creator", "initial-creator"), "ole-summary": ("Author", "LastAuthor")}
PLACEHOLDER_MOMENTS = ("1970-01-01T00:00:00Z", "1980-01-01T00:00:00Z", "1904-01-01T00:00:00Z", "1601-01-01T00:00:00Z", "2000-01-01T00:00:00Z")
GENERATED = {"trainedAlgorithmicMedia": "AI-generated media", "compositeWithTrainedAlgorithmicMedia": "composite with AI-generated media"}
IDENTIFYING = ("Make", "Model", "BodySerialNumber", "LensSerialNumber", "LensModel", "CameraOwnerName", "Software", "Artist", "Copyright", "Producer", "Creator", "Application", "Company", "creator", "lastModifiedBy", "Template", "generator")
#: Least number of files that a shared author, camera or lens is reported for.
THRESHOLDS = {"author": 3, "device": 2, "lens": 2}
TALLIES = ("metadata", "origin", "activity", "author", "tool", "device", "credentials", "coordinates", "place", "edited", "dated", "related", "contested")


def author(block: Column, fields: Column) -> Column:
    """ARRAY of the people that a block names."""
    names = F.array()
    for b, keys in AUTHORS.items():
        names = F.when(block == b, F.array_compact(F.array(*[fields[k] for k in keys]))).otherwise(names)
    return F.filter(names.cast("array<string>"), lambda x: F.trim(x) != "")


def tallies(evidence: DataFrame, related: DataFrame | None = None, contested: DataFrame | None = None) -> DataFrame:
    """tally and files: thirteen yes-or-no facts of files and how many have them, from one pass over the evidence.

    related and contested are tables of paths; evidence has source, tool, at, and may have block, fields, geo, location.
    """
    have = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "") if c in evidence.columns else F.lit(False)
    category = V.category(F.col("source"), F.col("tool"))
    named = F.size(author(F.col("block"), F.col("fields"))) > 0 if {"block", "fields"} <= set(evidence.columns) else F.lit(False)
    facts = {
        "metadata": category == "metadata", "origin": category == "origin", "activity": category == "activity", "author": named, "tool": have("tool"), "device": F.col("source") == "device-metadata",
        "credentials": F.col("source") == "c2pa", "coordinates": have("geo"), "place": have("location"), "edited": F.col("source") == "xmp-history", "dated": have("at"),
    }
    own = evidence.groupBy("path").agg(*[F.coalesce(F.bool_or(v), F.lit(False)).alias(k) for k, v in facts.items()])
    for name, paths in (("related", related), ("contested", contested)):
        own = own.withColumn(name, F.lit(False)) if paths is None else own.join(paths.select("path", F.lit(True).alias(name)).distinct(), "path", "left")
    total = own.agg(*[F.count_if(F.coalesce(k, F.lit(False))).alias(k) for k in TALLIES])
    return total.select(F.explode(F.array(*[F.struct(F.lit(k).alias("tally"), F.col(k).alias("files")) for k in TALLIES])).alias("t")).select("t.*")


def categories(evidence: DataFrame) -> DataFrame:
    """path, category and the sources of each category in the order in which they are first seen."""
    own = evidence.withColumn("category", V.category(F.col("source"), F.col("tool"))).groupBy("path", "category", "source").agg(F.min("seq").alias("seq"))
    return own.groupBy("path", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda s: s["source"]).alias("sources"))


def same_second(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """at, files, and whether their bytes are the same, for moments that the metadata of several files share.

    Digests (sha256 of files) are only looked at for files in such a group.
    """
    own = evidence.where((V.category(F.col("source"), F.col("tool")) == "metadata") & (F.col("at") != "") & ~F.col("at").isin(*PLACEHOLDER_MOMENTS)).select("path", "at").distinct()
    shared = own.groupBy("at").agg(F.count("*").alias("n")).where("n > 1").select("at")
    met = own.join(shared, "at", "left_semi").join(files.select("path", "size", "sha256"), "path", "left")
    group = met.groupBy("at").agg(F.count("*").alias("files"), F.min("size").alias("s0"), F.max("size").alias("s1"), F.min("sha256").alias("d0"), F.max("sha256").alias("d1"), F.count("sha256").alias("known"))
    same = F.when(F.col("s0") != F.col("s1"), False).when(F.col("known") == F.col("files"), F.col("d0") == F.col("d1"))
    return group.select("at", "files", same.alias("identical"))


def groups(attributes: DataFrame, thresholds: dict[str, int] = THRESHOLDS, least: int = 2) -> DataFrame:
    """axis, key, name, paths and basis of the names that enough files share; the spelling and the basis seen first show.

    attributes has axis, name, path, seq and basis.
    """
    own = attributes.where("name is not null").withColumn("key", N.name(F.col("name"))).where("key <> ''")
    enough = F.lit(least)
    for axis, n in thresholds.items():
        enough = F.when(F.col("axis") == axis, n).otherwise(enough)
    order = F.struct("seq", "path")
    shared = own.groupBy("axis", "key").agg(F.min_by("name", order).alias("name"), F.min_by("basis", order).alias("basis"), F.count_distinct("path").alias("paths"))
    return shared.where(F.col("paths") >= enough)


def members(attributes: DataFrame, shared: DataFrame) -> DataFrame:
    """axis, key and path of the files in each group, one row for each."""
    own = attributes.where("name is not null").select("axis", N.name(F.col("name")).alias("key"), "path").distinct()
    return own.join(shared.select("axis", "key"), ["axis", "key"], "left_semi")


def placed(groups_: DataFrame) -> DataFrame:
    """Groups with their place within an axis: by falling size, then name."""
    return groups_.withColumn("place", F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("paths"), "name", "key")))


def serial(value: Column) -> Column:
    """A serial number, null for what fills the field instead of one."""
    own = F.trim(value)
    return F.when(~F.lower(own).isin("", "n/a", "na", "none", "unknown", "null", "undefined") & ~own.rlike(r"^[0\s\-.]*$"), own)


def camera_model(make: Column, model: Column) -> Column:
    """Make and model, the make once; null without a model."""
    m, k = F.trim(model), F.trim(F.coalesce(make, F.lit("")))
    return F.when(m != "", F.when((k == "") | F.lower(m).startswith(F.lower(k)), m).otherwise(F.concat(k, F.lit(" "), m)))


def without_trace(files: DataFrame, evidence: DataFrame) -> DataFrame:
    return files.join(evidence.select("path").distinct(), "path", "left_anti").select("path")


def generated(evidence: DataFrame) -> DataFrame:
    """path and declared source of the files whose manifest says that a model made them."""
    declared = F.element_at(F.split(F.regexp_replace(F.col("fields")["digitalSourceType"], "/+$", ""), "/"), -1)
    own = evidence.select("path", "seq", declared.alias("declared")).where(F.col("declared").isin(*GENERATED))
    said = F.create_map(*[F.lit(x) for kv in GENERATED.items() for x in kv])
    return own.groupBy("path").agg(F.min_by("declared", "seq").alias("declared")).select("path", F.element_at(said, F.col("declared")).alias("source"))


def shared_pivots(ids: DataFrame, most: int = 8) -> DataFrame:
    """ref and values of the identifiers that most files share: a report of the first few."""
    top = ids.where("files > 1").orderBy(F.desc("files"), F.desc("count"), "type", "normalized").limit(most)
    w = Window.orderBy(F.desc("files"), F.desc("count"), "type", "normalized")  # over the few rows of the report
    return top.withColumn("ref", reference(F.row_number().over(w), "P", 2))


def across_corpora(found: DataFrame, corpus: Column) -> DataFrame:
    """type, normalized and the corpora of values that more than one corpus has."""
    own = found.groupBy("type", "normalized").agg(F.array_sort(F.collect_set(corpus)).alias("corpora"))  # corpora are few
    return own.where(F.size("corpora") > 1)


def places(found: DataFrame, most: int = 100) -> DataFrame:
    """type, normalized, path, seq and count of where values stand; the first places of each value in each file."""
    own = found.groupBy("type", "normalized", "path", "seq").agg(F.count("*").alias("count"))
    w = Window.partitionBy("type", "normalized", "path").orderBy("seq")
    return own.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def alerts(tallied: DataFrame, ids: DataFrame, corpora: DataFrame) -> DataFrame:
    """alert and number: conflicts, coordinates, credentials, related files, values across corpora; those that are there."""
    own = tallied.where("tally in ('contested', 'coordinates', 'related')").select(F.col("tally").alias("alert"), F.col("files").alias("number"))
    secret = ids.where("type = 'secret'").agg(F.count("*").alias("number")).select(F.lit("secrets").alias("alert"), "number")
    cross = corpora.agg(F.count("*").alias("number")).select(F.lit("across corpora").alias("alert"), "number")
    return own.unionByName(secret).unionByName(cross).where("number > 0")


def described(evidence: DataFrame) -> DataFrame:
    """path, field and value of what files say of themselves: metadata only, the first value of each field; a tool counts as Software."""
    own = evidence.where(V.category(F.col("source"), F.col("tool")) == "metadata")
    stated = own.select("path", "seq", F.explode("fields").alias("field", "value"), F.lit(0).alias("k")).unionByName(own.where("tool <> ''").select("path", "seq", F.lit("Software").alias("field"), F.col("tool").alias("value"), F.lit(1).alias("k")))
    return stated.groupBy("path", "field").agg(F.min_by("value", F.struct("seq", "k")).alias("value"))


def route(leader: Column, where: Column) -> Column:
    """How a file arrived: the source of its leading origin and where it says it came from."""
    return F.when(leader.isNull(), "no origin record").otherwise(F.concat(leader, F.coalesce(F.concat(F.lit(": "), where), F.lit(""))))


def assess(shared: Column, differing: Column, left: Column, right: Column, interval: Column) -> Column:
    """The reading of a comparison: shared and differing are arrays of fields, left and right the routes of both files."""
    named = F.array_join(shared, ", ")
    same, nearby = (left == right) & (left != "no origin record"), F.coalesce(interval.endswith("seconds"), F.lit(False))
    return (
        F.when((F.size(shared) == 0) & (F.size(differing) > 0), "different devices or authors").when(F.size(shared) == 0, "too little recorded to compare")
        .when(same & nearby, F.concat(F.lit("made and acquired together: agree on "), named, F.lit(", within "), interval))
        .when(left != right, F.concat(F.lit("share an earlier life, arrived separately: agree on "), named))
        .otherwise(F.concat(F.lit("agree on "), named, F.lit(", arrival not established")))
    )


def compare(evidence: DataFrame, leaders: DataFrame, left: str, right: str) -> DataFrame:
    """One row: shared and differing fields of two files, their routes, the distance of the moments they state, and the assessment.

    leaders has path, source and where (url, command or tool) of leading origins. Only the rows of the two files are read.
    """
    two = evidence.where(F.col("path").isin(left, right))
    named = described(two).where(F.col("field").isin(*IDENTIFYING)).groupBy("field").agg(F.max(F.when(F.col("path") == left, F.col("value"))).alias("a"), F.max(F.when(F.col("path") == right, F.col("value"))).alias("b")).where("a <> '' and b <> ''")
    both = named.agg(F.array_sort(F.collect_list(F.when(F.col("a") == F.col("b"), F.col("field")))).alias("shared"), F.array_sort(F.collect_list(F.when(F.col("a") != F.col("b"), F.col("field")))).alias("differing"))
    at = lambda p: F.max_by(F.when(F.col("path") == p, M.instant(F.col("at"))), F.when((F.col("path") == p) & (V.category(F.col("source"), F.col("tool")) == "metadata") & (F.col("at") != ""), F.struct(V.priority(F.col("source")), F.col("at"))))
    times = two.agg(at(left).alias("t0"), at(right).alias("t1"))
    came = leaders.where(F.col("path").isin(left, right)).agg(F.max(F.when(F.col("path") == left, route(F.col("source"), F.col("where")))).alias("r0"), F.max(F.when(F.col("path") == right, route(F.col("source"), F.col("where")))).alias("r1"))
    none = F.lit("no origin record")
    row = both.join(times).join(came).withColumns({"r0": F.coalesce("r0", none), "r1": F.coalesce("r1", none), "interval": M.interval(F.col("t0"), F.col("t1"))})  # three tables of one row
    return row.select("shared", "differing", F.col("r0").alias("left"), F.col("r1").alias("right"), "interval", assess(F.col("shared"), F.col("differing"), F.col("r0"), F.col("r1"), F.col("interval")).alias("assessment"))
