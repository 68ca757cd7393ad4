import datetime
from html.parser import HTMLParser

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.functions import detect
from sieveline.operators import correlate, graph, lineage, overview
from sieveline.plans import catalogue
from sieveline.sources import tables
from sieveline.streaming.pivots import mention_counts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(str([None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v) for v in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_against_sql(spark, sql, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), sql.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_results_do_not_depend_on_partitions(spark):
    p = tables.passages(spark, SF)
    from sieveline.operators import pivots

    one, many = (rows(pivots.identifiers(pivots.mentions(p.repartition(n))).toPandas()) for n in (1, 7))
    assert one == many and one


def test_origin_states(spark):
    data = [("a", "http://x.com/1"), ("a", "http://x.com/1/"), ("b", "http://x.com/1"), ("b", "http://x.com/2"), ("c", "http://x.com"), ("c", "http://y.com"), ("d", "http://x.com"), ("e", None)]
    got = {r["path"]: r["state"] for r in correlate.origin_states(spark.createDataFrame(data, "path string, url string")).collect()}
    assert got == {"a": "agreement", "b": "partial agreement", "c": "conflict", "d": "single source"}


def test_lineage_cut_off(spark):
    data = [(f"p{i}", "small") for i in range(3)] + [(f"q{i}", "crowd") for i in range(20)] + [("r", None)]
    got = {r["path"]: (len(r["others"]), r["count"]) for r in lineage.siblings(spark.createDataFrame(data, "path string, id string")).collect()}
    assert got["p0"] == (2, 2) and got["q3"] == (0, 19) and "r" not in got


def test_symmetric_edges_merge(spark):
    data = [("a", "b", "same document", 2), ("b", "a", "same document", 3), ("a", "b", "email domain", 1), ("a", "b", "email domain", 1)]
    got = {(r[0], r[1], r[2]): r[3] for r in graph.merged(spark.createDataFrame(data, "source string, target string, kind string, count long")).collect()}
    assert got == {("a", "b", "same document"): 3, ("a", "b", "email domain"): 2}


def test_page_bounds(spark):
    with pytest.raises(ValueError):
        overview.page(spark.range(3), ["id"], 0, 501)


def test_misnamed(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.pdf").write_bytes(b"\x89PNG\r\n\x1a\n")
    (tmp_path / "c.txt").write_bytes(b"plain")
    got = tables.misnamed(tables.folder(spark, str(tmp_path))).collect()
    assert [(r["suffix"], r["format"]) for r in got] == [("pdf", "PNG")]


def test_stream_of_mentions(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 0, 5)
    spark.createDataFrame([(at, "a@b.com 10.0.0.1"), (at, "a@b.com")], "at timestamp, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, text string").parquet(str(tmp_path / "in"))
    q = mention_counts(stream, types={"email", "ipv4"}).writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["type"], r["count"]) for r in spark.sql("select * from seen").collect()} == {("email", 2), ("ipv4", 1)}


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_one_pass_over_texts(spark):
    plan = catalogue.pivot_all(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3 and plan.count("ArrowEvalPython") <= 3  # documents, pages and conversations once each; Python proves candidates only
    plan = catalogue.shared_pivots(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert len(detect.DETECTORS) > 20


def test_redacted_url_of_every_page(spark):
    pages = {r["page_id"]: r["url"] for r in tables.table(spark, SF, "pages").collect()}
    got = {r["page_id"]: r["url"] for r in catalogue.redacted_url(spark, SF).collect()}
    assert got.keys() == pages.keys() and any("ref=" in u for u in pages.values())
    assert got == pages  # no key of theirs is a credential
    masked = {r["page_id"]: r["without_referrer"] for r in catalogue.redacted_url(spark, SF).collect()}
    assert all(("ref=" in u or "utm_source=" in u) == ("[REDACTED:query:" in masked[k]) for k, u in pages.items())


def test_every_document_leaves_a_trace(spark):
    ids = {r["doc_id"] for r in tables.table(spark, SF, "documents").collect()}
    unknown = {r["path"] for r in catalogue.unknown_only(spark, SF).collect()}
    assert {f"documents/{i}.txt" for i in ids if i % 2 == 0}.isdisjoint(unknown) and {f"documents/{i}.txt" for i in ids if i % 2} < unknown
    named = {(r["path"], r["target"]) for r in catalogue.fallback_name_join(spark, SF).collect()}
    assert {f"documents/{i}.txt" for i in ids} == {p for p, _ in named}


class _Read(HTMLParser):
    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.found, self.silent = [], 0
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style")
        self.found += [v for k, v in attrs if v and k in ("href", "src", "cite", "action", "data", "longdesc", "poster")]

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style") and self.silent > 0

    def handle_data(self, data):
        self.found += [] if self.silent else [data]


def test_passages_of_pages_and_conversations(spark):
    from sieveline.sources import markup

    odd = """<!DOCTYPE html><!-- a@no.com --><p title="x href=y">a&#64;b.com &lt;c&gt; &copy 1 &#x41;&eacute;&notit;</p><script src='/s.js?a=1&amp;b=2'>var a = "c@no.com";</script><A HREF=/u?x&amp;y=3>d</a><img src="e&#46;png"/>end"""
    pages = [r["html"] for r in tables.table(spark, SF, "pages").collect()] + [odd]
    own = spark.createDataFrame(list(enumerate(pages)), "i int, html string").select("i", markup.passages(F.col("html")).alias("p"))
    for r in own.collect():
        assert [x for x in r["p"] if x] == [x for x in _Read(pages[r["i"]]).found if x]
    p = tables.passages(spark, SF).collect()
    turns = tables.table(spark, SF, "conversations").where("text <> ''").count()
    assert sum(r["path"].startswith("conversations/") for r in p) == turns > 0
    assert any(r["path"].startswith("pages/") and r["seq"] > 0 for r in p)


def written(spark, tmp_path, htmls: list) -> tuple[str, duckdb.DuckDBPyConnection]:
    """A folder of tables with these pages and no other texts, and a connection to it."""
    none = {"documents": "doc_id long, text string", "conversations": "conv_id long, turn long, text string"}
    for name, kind in none.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(i, f"https://w.example.com/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for name in (*none, "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    return str(tmp_path), con


def same_as_sql(spark, at: tuple, name: str) -> pd.DataFrame:
    got, want = catalogue.QUERIES[name](spark, at[0]).toPandas(), at[1].sql(catalogue.SQL[name]).df()
    assert rows(got) == rows(want)
    return got


def test_page_passages_reach_the_end_of_long_pages(spark, tmp_path):
    long = "<html><body>" + f"<p>{'long text ' * 40}</p>" * 4000 + "<p>the end</p></body></html>"
    got = same_as_sql(spark, written(spark, tmp_path, [long, f"<p>{'x' * (1 << 21)}</p><p>y</p>", "<p>a<![if x]>b</p><![foo[ x ]]>c<p>d</p>", None]), "page_passages")
    assert got.groupby("path")["text"].agg(["count", lambda x: x.str.len().sum()]).values.tolist() == [[4001, 1_600_007], [2, (1 << 21) + 1], [4, 4]]


#: Pages whose titles and headings are cut inside of a reference, as some of the tables are.
CUT = [f"<title>{t[:n]}</title><p>{t[:n]}</p><p>{t}.</p>" for t in ("Tom &amp; &quot;you&quot;", "&lt;b&#x27;s &copy;", "1 &middot; 2 &gt;") for n in range(len(t) + 1)] + ["<p>a &copyx &amp b &ampc; &#x27 d &amp;lt; & e</p>"]


def test_page_passages_of_cut_titles(spark, tmp_path):
    got = same_as_sql(spark, written(spark, tmp_path, CUT), "page_passages")
    assert {"Tom &am", "Tom &amp", "Tom &", "1 · 2 &gt", "a &copyx &amp b &ampc; &#x27 d &lt; & e"} <= set(got["text"])


def test_passage_budget_of_cut_titles(spark, tmp_path):
    got = same_as_sql(spark, written(spark, tmp_path, [*CUT, f"<title>{'x' * 1980} &amp</title><p>{'y' * 30}</p>"]), "passage_budget")
    assert {"Tom &am", "Tom &amp", "Tom &", "1 · 2 &gt", "a &copyx &amp b &ampc; &#x27 d &lt; & e"} <= set(got["text"])


#: Addresses that the end of a title cuts anywhere: .ex is no country's.
CUT_MAILS = [f"<title>To kim.{n}{'@mail4.example.com'[:n]}</title><p>kim.{n}{'@mail4.example.com'[:n]} and lee@web.zz, twice lee@web.zz</p><h1>kim@mail1.example.com</h1>" for n in range(19)]


@pytest.fixture(scope="session")
def cut_mails(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("cut"), CUT_MAILS)


def test_registered_names_outside_of_the_queries(spark):
    from sieveline.functions import normalize as N

    hosts = spark.createDataFrame([("mail4.ex",), ("mail4.eu",)], "h string")
    with N.any_country():
        loose = hosts.select(N.domain(F.col("h")))
    assert [r[0] for r in loose.collect()] == ["mail4.ex", "mail4.eu"]
    assert [r[0] for r in hosts.select(N.domain(F.col("h"))).collect()] == [None, "mail4.eu"]


@pytest.mark.parametrize("name", ["pivot_email", "dense_files", "digests_of_emails", "has_identifier", "identifier_places", "identifiers_ordered", "pivots_by_type", "graph_edges", "graph_nodes"])
def test_cut_addresses(spark, cut_mails, name):
    """What the queries of addresses give where .ex is left of .example, as their SQL."""
    got = same_as_sql(spark, cut_mails, name)
    assert got.astype(str).apply(lambda r: r.str.contains(r"@(?:mail4\.ex|web\.zz)$").any(), axis=1).any() or name in ("pivots_by_type", "dense_files")


@pytest.mark.parametrize("name", ["graph_edges", "graph_nodes"])
def test_graph_of_rows_that_are_there_twice(spark, tmp_path, name):
    """Each row of a file is an edge to its content, also where another row has the same id and text."""
    at = written(spark, tmp_path, ["<p>kim@mail1.example.com</p>"])
    spark.createDataFrame([(0, "https://w.example.com/0", "<p>kim@mail1.example.com</p>")], "page_id long, url string, html string").write.mode("append").parquet(f"{at[0]}/pages.parquet")
    got = same_as_sql(spark, at, name)
    assert (got["kind"] == "content hash").sum() == 2 if name == "graph_edges" else got.set_index("id")["degree"]["file:pages/0.html"] == 4


def test_running_numbers_of_more_rows_than_a_sample(spark):
    """Bounds that Spark draws anew for each reader of the ranges would shift the numbers against each other."""
    from sieveline.operators import ordered

    rows_ = spark.range(200_000).select((F.xxhash64("id") % 1_000_000).alias("k"), "id").groupBy("k", "id").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = ordered.running(rows_, [F.desc("k"), F.col("id").asc()], F.col("n"), parts=16)
    first = got.groupBy(F.col("k") % 2).agg(F.min("place").alias("first")).agg(F.min("first")).first()[0]
    w = got.select("k", "id", "place", "before", "top").toPandas().sort_values(["k", "id"], ascending=[False, True])
    assert first == 1 and w["place"].tolist() == list(range(1, 200_001)) and (w["before"] == w["place"] - 1).all() and (w["top"] == w["id"]).all()
