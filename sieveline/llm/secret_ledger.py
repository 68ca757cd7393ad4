"""Secret scans over a ledger of blobs.

Every version of a text is a blob, addressed by the SHA-256 of its content. A run scans each pair of a blob and
a rule version that the ledger doesn't have yet, however many paths show the blob, and joins the findings back to
all paths. A ledger in the shared folder makes the next run scan new blobs and new rules only.

Defined results: null and empty texts are the empty blob, which has no finding; paths may repeat or be null (each
row gets its own result row); rows that repeat both path and text are one blob, scanned once by a task; a ledger
may hold a blob twice (two runs at once, or an append that was tried again), which gives no row twice; spans count code points,
with exclusive ends; findings of one kind don't overlap; a span list begins with the smaller start, then the kind that is
listed first; other columns never matter.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, frees

#: (kind, pattern, group whose length counts, least length). The first three are the base rules; patterns of one
#: kind are matched leftmost first without overlap, and matches that are too short are dropped afterwards.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # runs of 32 and more are the same as runs of any length, the short ones dropped
    ("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("vendor", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 0, 1),
)
BASE = 3
#: Blobs that a task remembers; one that it has forgotten is scanned again, and the ledger still gets one entry.
SEEN = 100_000
LEDGER = "blob string, rule_version string, spans array<struct<kind:int,start:int,end:int>>"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


@functools.lru_cache(4)
def _compiled(rules):
    return [(k, re.compile(p, re.ASCII).finditer, g, least) for k, (_, p, g, least) in enumerate(rules)]


def find(text: str, rules=RULES) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all findings, by start, then kind."""
    out = [(k, m.start(), m.end()) for k, it, g, least in _compiled(rules) for m in it(text) if m.end(g) - m.start(g) >= least]
    return sorted(out, key=lambda s: (s[1], s[0]))


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


@frees
def _scan(rules, batches):
    seen: set[str] = set()  # rows of one blob that repeat their path come to one task
    for b in batches:
        blobs, spans = [], []
        for blob, text in zip(b.column("blob").to_pylist(), b.column("text")):
            if blob not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(blob)
                blobs.append(blob)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in find(text.as_py() or "", rules)])
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(spans, _SPANS)], ["blob", "spans"])


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, text and the address of its blob."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, entries): doc_id and blob of every row; and the ledger entries that this run adds, one for each new blob.

    One of the rows that show a new blob stands for it, so that no text is gathered by blob, and a blob that a
    third of all rows show costs no more than another.
    """
    own = versions(docs)
    paths = cut(own.select("doc_id", "blob"))
    todo = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is not None:
        todo = todo.join(ledger.where(F.col("rule_version") == rule_version(rules)).select("blob"), "blob", "left_anti")
    todo = todo.select(F.col("blob").alias("new_blob"), F.col("doc_id").alias("new_id"))
    texts = own.join(todo, (own["blob"] == todo["new_blob"]) & own["doc_id"].eqNullSafe(todo["new_id"]), "left_semi")
    found = texts.select("blob", "text").mapInArrow(functools.partial(_scan, rules), "blob string, spans array<struct<kind:int,start:int,end:int>>")
    entries = cut(found.groupBy("blob").agg(F.max("spans").alias("spans")))  # rows may repeat
    return paths, entries.select("blob", F.lit(rule_version(rules)).alias("rule_version"), "spans")


def scan_into(spark: SparkSession, docs: DataFrame, path: str, rules=RULES) -> DataFrame:
    """Scan with the ledger in a Parquet folder: read it, append what is new, and return findings() over all of it."""
    try:
        ledger = spark.read.schema(LEDGER).parquet(path)
    except Exception as e:  # noqa: BLE001  only a folder that isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ledger = None
    paths, entries = scan(docs, ledger, rules)
    entries.write.mode("append").parquet(path)
    return findings(paths, spark.read.schema(LEDGER).parquet(path).where(F.col("rule_version") == rule_version(rules)), rules)


def findings(paths: DataFrame, entries: DataFrame, rules=RULES) -> DataFrame:
    """Every path with the spans of its blob: doc_id, a count for each base kind, base_sha256 and spans."""
    some = entries.where(F.size("spans") > 0).groupBy("blob").agg(F.max("spans").alias("spans"))  # entries of one blob are equal
    own = paths.join(some, "blob", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")))
    names = F.array(*[F.lit(r[0]) for r in rules])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return own.select("doc_id", *[count(k).alias(f"n_{rules[k][0]}") for k in range(BASE)], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
