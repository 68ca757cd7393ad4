"""Writers: JSON lines with a schema tag, graph tables safe for spreadsheets, GraphML, linked data of cases.

Each writer is a DataFrame of text rows or cells that the executors write; the envelope around them is a few lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import graph

#: Namespace of the ids of linked data.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:sieveline:case")


def inert(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def plain(rows: DataFrame) -> DataFrame:
    """Without what says nothing: empty texts, arrays and maps become null, which writers leave out."""
    empty = {"string": lambda c: F.nullif(c, F.lit("")), "array": lambda c: F.when(F.size(c) > 0, c), "map": lambda c: F.when(F.size(c) > 0, c)}
    return rows.select(*[empty.get(f.dataType.typeName(), lambda c: c)(F.col(f"`{f.name}`")).alias(f.name) for f in rows.schema])


def json_lines(rows: DataFrame, shape: str, version: int = 1) -> DataFrame:
    """One JSON document a row, tagged with its shape; what says nothing is left out."""
    own = plain(rows)
    return own.select(F.to_json(F.struct(F.lit(f"{shape}/{version}").alias("schema"), *own.columns)).alias("value"))


def write_json(rows: DataFrame, path: str, shape: str, version: int = 1) -> None:
    json_lines(rows, shape, version).write.mode("errorifexists").text(path)


def shortened(text: Column, most: int = 1000) -> Column:
    """A text cut to so many characters, saying how many it had."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.format_string("… (%d characters)", F.length(text)))).otherwise(text)


def _joined(evidence: Column, name: str) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.transform(evidence, lambda e: e[name]), lambda x: x.isNotNull() & (x != ""))), " | ")


def graph_table(edges: DataFrame) -> DataFrame:
    """The 17 columns of a relationship (source, target, kind, count, evidence) with both its ends."""
    nodes = graph.node_table(edges).select("id", "type", "label")
    ends = lambda side: nodes.select(F.col("id").alias(side), F.col("type").alias(f"{side}_type"), F.col("label").alias(f"{side}_label"))
    e = F.col("evidence")
    at = F.array_min(F.filter(F.transform(e, lambda x: x["at"]), lambda x: x.isNotNull() & (x != "")))
    return edges.join(ends("source"), "source").join(ends("target"), "target").select(
        "source", "source_type", "source_label", "target", "target_type", "target_label", "kind", graph.edge_label(F.col("kind")).alias("label"), F.col("count").alias("weight"), F.size(e).alias("evidence_count"),
        *[_joined(e, n).alias(f"evidence_{n}") for n in ("source", "place", "category", "match", "rule")], F.coalesce(at, F.lit("")).alias("evidence_at"), F.to_json(e).alias("evidence"),
    )


def write_graph_csv(edges: DataFrame, path: str) -> None:
    own = graph_table(edges) if "evidence" in edges.columns else edges
    own.select(*[inert(F.col(c).cast("string")).alias(c) for c in own.columns]).write.mode("errorifexists").csv(path, header=True, escape='"')


def xml_text(value: Column) -> Column:
    """A text as XML 1.0 may hold it: what it must not hold as \\uXXXX, marks as entities."""
    bad = r"[^\u0009\u000A\u000D\u0020-\uD7FF\uE000-\uFFFD\x{10000}-\x{10FFFF}]"
    code = lambda c: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))
    safe = F.when(value.rlike(bad), F.array_join(F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c.rlike(bad), code(c)).otherwise(c)), "")).otherwise(value)
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        safe = F.replace(safe, F.lit(mark), F.lit(name))
    return safe


#: The lines around the elements of a GraphML document, with its typed keys.
GRAPHML_HEAD = (
    '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *(f'<key id="{k}" for="{of}" attr.name="{k}" attr.type="{t}"/>' for k, of, t in (("type", "node", "string"), ("label", "node", "string"), ("value", "node", "string"), ("kind", "edge", "string"), ("weight", "edge", "long"), ("evidence", "edge", "string"))),
    '<graph edgedefault="directed">',
)
GRAPHML_TAIL = ("</graph>", "</graphml>")


def graphml(edges: DataFrame) -> DataFrame:
    """part (0 for nodes, 1 for edges) and value: an element a row. A document is the head, the nodes, the edges and the tail."""
    x = lambda c: xml_text(F.col(c).cast("string"))
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), F.coalesce(x(c), F.lit("")), F.lit("</data>"))
    nodes = graph.node_table(edges).select(F.lit(0).alias("part"), F.concat(F.lit('<node id="'), x("id"), F.lit('">'), data("type", "type"), data("label", "label"), data("value", "value"), F.lit("</node>")).alias("value"))
    own = edges.withColumn("ground", F.to_json("evidence")) if "evidence" in edges.columns else edges.withColumn("ground", F.lit(""))
    return nodes.unionByName(own.select(F.lit(1).alias("part"), F.concat(F.lit('<edge source="'), x("source"), F.lit('" target="'), x("target"), F.lit('">'), data("kind", "kind"), data("weight", "count"), data("evidence", "ground"), F.lit("</edge>")).alias("value")))


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


# Observables of the case ontology by type of node: class, facet and its property.
OBSERVABLES = {
    "email": ("EmailAddress", "EmailAddressFacet", "addressValue"), "url": ("URL", "URLFacet", "fullValue"), "domain": ("DomainName", "DomainNameFacet", "value"), "ipv4": ("IPv4Address", "IPv4AddressFacet", "addressValue"), "ipv6": ("IPv6Address", "IPv6AddressFacet", "addressValue"),
    "mac": ("MACAddress", "MACAddressFacet", "addressValue"), "path": ("FilePath", "", ""), "registry": ("WindowsRegistryKey", "WindowsRegistryKeyFacet", "key"),
}


def case_objects(edges: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """id and value: linked data of a case, one JSON object for each node and each relationship.

    A file is known by its content where that is known, else by its place under the root of the evidence.
    """
    known = files.select(graph.file_id(F.col("path")).alias("id"), "size", "sha256")
    key = F.when(F.col("type") != "file", F.col("id")).when(F.col("sha256").isNotNull(), F.concat(F.lit("sha256:"), F.col("sha256"))).otherwise(F.concat(F.lit(f"path:{root}|"), F.col("value")))
    nodes = graph.node_table(edges).join(known, "id", "left").withColumn("at", F.concat(F.lit("kb:"), uuid5(key)))
    pick = lambda i: F.element_at(F.create_map(*[x for k, v in OBSERVABLES.items() for x in (F.lit(k), F.lit(v[i]))]), F.col("type"))
    class_ = F.when(F.col("type") == "person", "uco-identity:Identity").when(F.col("type") == "file", "uco-observable:File").otherwise(F.concat(F.lit("uco-observable:"), F.coalesce(pick(0), F.lit("ObservableObject"))))
    node = F.to_json(F.struct(F.col("at").alias("@id"), class_.alias("@type"), F.col("type").alias("sieveline:type"), F.col("value").alias("sieveline:value"), F.col("size").alias("uco-observable:sizeInBytes"), F.col("sha256").alias("uco-observable:hash")))
    ends = lambda side: nodes.select(F.col("id").alias(side), F.col("at").alias(f"{side}_at"))
    at = F.concat(F.lit("kb:"), uuid5(F.concat_ws("|", "source", "kind", "target")))
    tie = edges.join(ends("source"), "source").join(ends("target"), "target")
    link = F.to_json(F.struct(at.alias("@id"), F.lit("uco-observable:ObservableRelationship").alias("@type"), F.col("source_at").alias("uco-core:source"), F.col("target_at").alias("uco-core:target"), F.col("kind").alias("uco-core:kindOfRelationship"), F.lit(True).alias("uco-core:isDirectional"), F.col("count").alias("sieveline:count")))
    return nodes.select(F.col("at").alias("id"), node.alias("value")).unionByName(tie.select(at.alias("id"), link.alias("value")))
