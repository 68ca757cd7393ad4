"""Line dedup by site-relative frequency.

Pages are grouped by host. A line that stands in more than a ratio of the host's distinct texts is boilerplate of that
host, and is dropped from all of its pages; exact copies of a page count once, so copies alone make no line boilerplate.
Everything is DataFrame operations: lines become hashes, which are counted with partial aggregation; a host has at
most lines-per-page / ratio boilerplate lines, so those come together in one array for each host. Where all arrays
are small together they go to the pages, and no text is moved; else pages meet them by host and part, in as many parts as the
host has pages for.

Defined results: lines are cut at \\n and compared without white space around them; blank lines are always kept; a
line counts once for each distinct text, and one that stands in fewer than MIN_PAGES of them is no boilerplate at any ratio,
as a host of few pages would else lose all its lines; a null host is a host of its own; a null text stays null; an empty table gives
an empty one; repeated rows each stay; all other columns are passed on unchanged, whatever their names (but one that is named
__n_dropped is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_MB, cut, named, numbered, unit_hash

#: A line is boilerplate if it stands in more than RATIO of the host's distinct texts, and in MIN_PAGES of them at least. The
#: ratio is the lowest step (0.05, 0.03, 0.02, 0.015, 0.01) at which all lines that go on `check_s` are known boilerplate
#: (ad lines of `pages`); license lines of documents begin at 0.01.
RATIO, MIN_PAGES = 0.015, 3
#: Pages of a host that meet its lines in one part, where lines are too many to be sent to all pages.
PAGES = 100_000


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _key(line: Column) -> Column:
    """Hash of a line, null for a blank one."""
    bare = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare != "", F.md5(bare))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """__host and __lines: the hashes of each host's boilerplate lines."""
    of, digest = F.col(host).cast("string"), F.md5(F.col(text))
    own = pages.select(of.alias("__host"), digest.alias("__text"), F.array_compact(F.array_distinct(F.transform(_lines(text), _key))).alias("__keys"))
    own = own.groupBy("__host", "__text").agg(F.first("__keys").alias("__keys"))
    count = own.select("__host", F.explode("__keys").alias("__key")).groupBy("__host", "__key").agg(F.count(F.lit(1)).alias("__n"))
    total = pages.select(of.alias("__h"), digest.alias("__text")).distinct().groupBy("__h").agg(F.count(F.lit(1)).alias("__pages"))
    often = count.where(F.col("__n") >= min_pages).join(total, F.col("__host").eqNullSafe(F.col("__h")))
    return often.where(F.col("__n") > ratio * F.col("__pages")).groupBy("__host").agg(F.collect_list("__key").alias("__lines"))


def line_dedup(pages: DataFrame, host: str = "source", text: str = "text", key: str = "doc_id", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of the pages, text without the boilerplate lines of its host, and __n_dropped."""
    drop = cut(boilerplate(pages, host, text, ratio, min_pages))
    own = pages.select(*numbered(pages), F.col(host).cast("string").alias("of"), F.col(text).alias("text"), unit_hash(key, text).alias("at"))
    mb = (drop.agg(F.sum(F.octet_length(F.coalesce("__host", F.lit(""))) + 40 * F.size("__lines") + 64)).first()[0] or 0) / 1e6
    same = F.col("of").eqNullSafe(F.col("__host"))
    if mb <= SMALL_MB:
        met = own.join(F.broadcast(drop), same, "left")
    else:
        parts = cut(own.groupBy(F.col("of").alias("__big")).agg(F.ceil(F.count(F.lit(1)) / PAGES).cast("int").alias("parts")).where("parts > 1"))  # few hosts
        n = F.coalesce("parts", F.lit(1))
        drop = drop.join(parts, F.col("__host").eqNullSafe(F.col("__big")), "left").select("__host", "__lines", F.explode(F.sequence(F.lit(0), n - 1)).alias("__part"))
        own = own.join(parts, F.col("of").eqNullSafe(F.col("__big")), "left").withColumn("part", F.floor(F.col("at") * n).cast("int"))
        met = own.join(drop, same & (F.col("part") == F.col("__part")), "left")
    lines = _lines("text")
    # the lines of this page that are boilerplate, by a hash table over those of its host
    met = met.withColumn("gone", F.when(F.col("__lines").isNotNull(), F.array_intersect(F.transform(lines, _key), "__lines")))
    some = F.coalesce(F.size("gone"), F.lit(0)) > 0
    met = met.withColumn("kept", F.when(some, F.filter(lines, lambda x: F.coalesce(~F.array_contains("gone", _key(x)), F.lit(True)))))
    new = F.when(some, F.array_join("kept", "\n")).otherwise(F.col("text"))
    dropped = F.when(some, F.size(lines) - F.size("kept")).otherwise(0).cast("long")
    return met.select(*named(pages, ("__n_dropped",), **{text: new}), dropped.alias("__n_dropped"))


SQL = rf"""
WITH d AS (SELECT *, row_number() OVER () AS k FROM documents),
l AS (SELECT k, source, text AS whole, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
b0 AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM l),
c AS (SELECT source, bare, count(DISTINCT whole) AS n FROM b0 WHERE bare <> '' GROUP BY source, bare),
h AS (SELECT source, count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS pages FROM documents GROUP BY source),
b AS (SELECT c.source, c.bare FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO} * h.pages),
m AS (SELECT b0.k, b0.line, b0.pos, b.bare IS NOT NULL AS gone FROM b0 LEFT JOIN b ON b0.source IS NOT DISTINCT FROM b.source AND b0.bare = b.bare),
t AS (SELECT k, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) FILTER (WHERE gone) AS n_dropped FROM m GROUP BY k)
SELECT d.doc_id, d.source, t.text, coalesce(t.n_dropped, 0) AS n_dropped FROM d LEFT JOIN t USING (k)
"""
