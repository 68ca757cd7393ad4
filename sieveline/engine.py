"""A case as a set of tables that questions are asked of: the files of a folder, what they say, and what traces say of them."""

from __future__ import annotations

import functools

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vocabulary as V
from .operators import case, correlate, findings, graph, lineage, overview, pivots
from .sources import documents, readers, stores, tables

_EVIDENCE = "path seq source block tool at url referrer command note geo location match bytes size fields".split()


def coverage(found: DataFrame, stores_: DataFrame) -> DataFrame:
    """source, state, records and oldest: a source is searched where a store of it was read or it gave records, partial where stores
    were there and some gave none, unavailable where nothing was there. stores_ has source and read."""
    n = found.groupBy("source").agg(F.count("*").alias("records"), F.min(F.nullif("at", F.lit(""))).alias("oldest"))
    s = stores_.groupBy("source").agg(F.count("*").alias("stores"), F.count_if("read").alias("read"))
    every = found.sparkSession.createDataFrame([(x,) for x in V.SOURCES], "source string")
    own = every.join(n, "source", "left").join(s, "source", "left")
    state = F.when(F.coalesce("read", F.lit(0)) < F.coalesce("stores", F.lit(0)), "partial").when((F.coalesce("records", F.lit(0)) > 0) | (F.coalesce("stores", F.lit(0)) > 0), "searched").otherwise("unavailable")
    return own.select("source", state.alias("state"), F.coalesce("records", F.lit(0)).alias("records"), "oldest")


class Case:
    """The questions of a case over one folder; tables are built when they are asked for, and evidence is kept once built."""

    def __init__(self, spark: SparkSession, root: str, suffixes: set[str] | None = None, trace_root: str | None = None):
        self.spark, self.root, self.trace_root = spark, root, trace_root
        self.raw = tables.folder(spark, root, suffixes)

    def allowed(self, path: str) -> str:
        """A path under the root of the case; any other is refused."""
        base = self.root.rstrip("/")
        if ".." in path.split("/") or not (path == base or path.removeprefix("file:").startswith(base.removeprefix("file:") + "/")):
            raise ValueError(f"{path} is outside of the case")
        return path

    @functools.cached_property
    def files_table(self) -> DataFrame:
        name = F.regexp_extract("path", r"([^/]*)$", 1)
        return self.raw.select("path", name.alias("name"), V.suffix(F.col("path")).alias("suffix"), "size", "sha256", "mtime")

    @functools.cached_property
    def evidence(self) -> DataFrame:
        """What the files say of themselves, and what stores say of them: by their path, and by name where no path fits."""
        own = readers.records(self.raw)
        size = self.files_table.select("path", "size", "name")
        within = own.join(size.drop("name"), "path")
        parts = [self._shaped(within)]
        if self.trace_root:
            told = stores.traces(tables.folder(self.spark, self.trace_root, skip=False)).where("target is not null")
            exact = told.withColumn("key", F.regexp_replace("target", "^file:/*", "/")).join(size.withColumn("key", F.regexp_replace("path", "^file:/*", "/")), "key").withColumn("match", F.lit("recorded-path"))
            rest = told.join(exact.select("store", "seq").distinct(), ["store", "seq"], "left_anti")
            last = F.regexp_extract(F.regexp_replace("target", r"[\\/]+$", ""), r"([^\\/]*)$", 1)
            named = rest.withColumn("name", last).join(size, "name").withColumn("match", F.when(F.col("bytes") == F.col("size"), "name+size").otherwise("filename"))
            parts += [self._shaped(exact.drop("key")), self._shaped(named)]
        every = functools.reduce(DataFrame.unionByName, parts)
        return every.persist(StorageLevel.MEMORY_AND_DISK)

    @staticmethod
    def _shaped(rows: DataFrame) -> DataFrame:
        types = {"seq": "long", "bytes": "long", "size": "long", "fields": "map<string,string>"}
        return rows.select(*[F.col(c).cast(types.get(c, "string")).alias(c) if c in rows.columns else F.lit(None).cast(types.get(c, "string")).alias(c) for c in _EVIDENCE])

    def texts(self) -> DataFrame:
        """Passages of documents, and fields of evidence with the name of the field as where."""
        body = documents.passages(self.raw).select("path", "seq", "text", F.lit("content").alias("where"))
        said = self.evidence.select("path", F.col("seq").cast("int").alias("seq"), F.explode("fields").alias("where", "text")).select("path", "seq", "text", "where")
        return body.unionByName(said)

    def files(self, evidence: str = "any", offset: int = 0, limit: int = 50) -> DataFrame:
        own = self.files_table
        if evidence != "any":
            own = own.join(self.evidence.select("path").distinct(), "path", "left_semi" if evidence == "found" else "left_anti")
        return overview.page(own, ["path"], offset, limit)

    def file(self, path: str) -> DataFrame:
        return self.evidence.where(F.col("path") == self.allowed(path))

    def mentions(self) -> DataFrame:
        return pivots.mentions(self.texts())

    def pivots(self, type_: str | None = None, shared: bool = False) -> DataFrame:
        ids = pivots.identifiers(self.mentions())
        ids = ids if type_ is None else ids.where(F.col("type") == type_)
        return pivots.shared(ids) if shared else ids

    def findings(self) -> DataFrame:
        return findings.findings(self.evidence)

    def verdicts(self) -> DataFrame:
        return findings.verdicts(self.evidence)

    def links(self) -> DataFrame:
        return lineage.links(self.evidence)

    def tallies(self) -> DataFrame:
        return case.tallies(self.evidence, self.links(), self.verdicts().where("contested"))

    def graph(self) -> DataFrame:
        found = self.mentions()
        ids = pivots.identifiers(found)
        attributes = self.evidence.where("block is not null").select("path", "seq", "block", F.explode(case.author(F.col("block"), F.col("fields"))).alias("name")).select(F.lit("author").alias("axis"), "name", "path", "seq", F.col("block").alias("basis"))
        return graph.claims(
            graph.identifier_edges(case.places(found)), graph.derived_edges(ids, pivots.digests_of_emails(ids)), graph.content_edges(self.files_table), graph.attribute_edges(attributes), graph.lineage_edges(self.links())
        )

    def neighbors(self, node: str, kind: str | None = None) -> DataFrame:
        return graph.neighbors(self.graph(), node, kind)

    def compare(self, left: str, right: str) -> DataFrame:
        leaders = correlate.leading(self.evidence.withColumn("at", F.try_to_timestamp("at"))).where("category = 'origin'")
        where = F.coalesce("url", "command", "tool")
        met = leaders.select("path", "seq", "source").join(self.evidence.select("path", "seq", "source", where.alias("where")), ["path", "seq", "source"])
        return case.compare(self.evidence, met, self.allowed(left), self.allowed(right))

    def coverage(self) -> DataFrame:
        none = self.spark.createDataFrame([], "source string, read boolean")
        return coverage(self.evidence, none)

    def explain(self, path: str) -> DataFrame:
        """The records of a file by category, the leading ones first."""
        own = self.file(path).withColumn("category", V.category(F.col("source"), F.col("tool")))
        return own.withColumn("priority", V.priority(F.col("source"))).orderBy("category", F.desc("priority"), "seq").drop("priority")

