"""Lineage, graph, exports, cleaning, and a case over a folder that is built here."""

import csv
import io
import json
import uuid
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from sieveline import engine, sinks
from sieveline.functions import moments as M
from sieveline.operators import case, correlate, findings, graph, lineage, ordered
from sieveline.sources import clean, readers, tables
from tests.test_readers import DOCX, JPEG, MP4, PDF, PNG

EVIDENCE = "path string, seq long, source string, block string, tool string, at string, url string, match string, bytes long, size long, fields map<string,string>"


def evidence(spark, rows):
    names = [c.split()[0] for c in EVIDENCE.split(", ", 10)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], EVIDENCE)


def test_lineage_links(spark):
    x = lambda path, **ids: {"path": path, "seq": 0, "source": "xmp", "block": "xmp", "fields": {k.replace("_", ":"): v for k, v in ids.items()}}
    d, o, f = "xmpMM_DocumentID", "xmpMM_OriginalDocumentID", "xmpMM_DerivedFrom/stRef_documentID"
    rows = [x("a", **{d: "xmp.did:AAAA1111"}), x("b", **{d: "xmp.did:BBBB2222", f: "xmp.did:AAAA1111"}), x("c", **{d: "xmp.did:BBBB2222", o: "xmp.did:AAAA1111"}), x("z", **{d: "xmp.did:00000000"}), x("y", **{d: "xmp.did:00000000"})]
    rows += [x(f"t{i}", **{o: "xmp.did:TTTT9999"}) for i in range(12)]
    got = {(r["path"], r["kind"]): (r["others"], r["count"]) for r in lineage.links(evidence(spark, rows)).collect()}
    assert got[("b", "derived from")] == (["a"], 1) and got[("a", "source of")] == (["b"], 1) and got[("b", "same document")] == (["c"], 1)
    assert got[("c", "descends from")] == (["a"], 1) and got[("a", "original of")] == (["c"], 1) and got[("t3", "common ancestor")] == ([], 11)
    assert not any(p in ("z", "y") for p, _ in got)


def test_findings_of_mirrors_and_nulls(spark):
    rows = [
        {"path": "p", "seq": 0, "source": "document-metadata", "block": "pdf-info", "fields": {"Author": "Ann  B", "Title": "One", "CreationDate": "D:20200102030405+02'00'"}},
        {"path": "p", "seq": 1, "source": "xmp", "block": "xmp", "fields": {"DC:creator": "ann b", "dc:title": "Two", "xmp:CreateDate": "2020-01-02T01:04:05Z"}},
        {"path": "q", "seq": 0, "source": "torrent", "bytes": 0, "size": 5}, {"path": None, "seq": None, "source": None}, {"path": "r", "seq": 0, "source": "shell-history", "tool": "vim", "match": "filename"},
    ]
    got = {(r["path"], r["kind"], r["field"]) for r in findings.findings(evidence(spark, rows)).collect()}
    assert got == {("p", "attribution_conflict", "Title"), ("q", "size_corroboration", "size")}
    assert findings.findings(evidence(spark, [])).count() == 0


def test_moments(spark):
    cases = [("2020-01-02T03:04:05+02:00", "2020-01-02T01:04:05Z", True, False), ("20200102", "2020-01-02T10:00:00", True, None), ("2020:01:02 03:04:05", "2020-01-02T03:04:06", False, False), ("x", "2020-01-01", None, None), ("2020-01-03", "2020-01-02", False, True), ("2020-01-03T00:00:00", "2020-01-02T00:00:00Z", False, None)]
    got = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select(M.same_moment(F.col("a"), F.col("b")), M.after(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [c[2:] for c in cases]
    t = lambda x: F.lit(x).cast("timestamp")
    row = spark.range(1).select(
        M.apart(t("2020-03-14 00:00:00"), t("2020-01-02 00:00:00")), M.apart(t("2020-01-01 00:00:00"), t("2021-07-01 00:00:00")), M.apart(t("2020-01-01 00:00:00"), t("2020-01-01 00:00:00")), M.interval(t("2020-01-01 00:00:00"), t("2020-01-03 01:00:00")),
        M.shown(F.lit("2020-01-02T03:04:05+02:00")), M.shown(F.lit("soon")), M.iso(M.from_epoch(F.lit(86400), "mac")), M.iso(M.from_epoch(F.lit((11644473600 + 86400) * 10**7), "windows", 10**7)), M.iso6709(F.lit("+52.2297+021.0122/")), M.sexagesimal(F.lit(-21.0122), "E", "W"), M.counted(F.lit(1), "file"),
    ).first()
    assert tuple(row)[:8] == ("72 days earlier", "1 year 6 months later", None, "2 days", "2020-01-02 01:04:05 UTC", "soon", "2001-01-02T00:00:00Z", "1970-01-02T00:00:00Z")
    assert tuple(row[8]) == (52.2297, 21.0122) and row[9] == "21°00'43.92\"W" and row[10] == "1 file"


def test_running_numbers_over_ranges(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "k int, v int")
    got = sorted((r["place"], r["before"], r["k"], r["v"]) for r in ordered.running(df, [F.desc("k"), F.col("v").asc()], F.col("v"), parts=9).collect())
    total = 0
    for n, (k, v) in enumerate(sorted(((i % 7, i) for i in range(500)), key=lambda x: (-x[0], x[1])), 1):
        assert got[n - 1] == (n, total, k, v)
        total += v
    assert [r[0] for r in spark.createDataFrame([(7,), (1234,)], "n int").select(ordered.reference(F.col("n"), "F", 2)).collect()] == ["F07", "F1234"]
    assert ordered.running(df.where("false"), [F.col("k").asc()]).count() == 0


def test_case_scalars(spark):
    row = spark.range(1).select(case.camera_model(F.lit("Canon"), F.lit("Canon EOS")), case.camera_model(F.lit("Sony"), F.lit("A7")), case.camera_model(F.lit("Sony"), F.lit(None)), case.serial(F.lit(" 000-0 ")), case.serial(F.lit("A12")), lineage.meaningful(F.lit("uuid:0000-0000-0000"))).first()
    assert tuple(row) == ("Canon EOS", "Sony A7", None, None, " A12".strip(), None)


def test_compare(spark):
    rows = [{"path": p, "seq": 0, "source": "device-metadata", "block": "exif", "tool": "Cam", "at": at, "fields": {"Make": "X", "Model": m}} for p, at, m in (("a", "2020-01-02T03:04:05Z", "1"), ("b", "2020-01-02T03:04:25Z", "2"))]
    leaders = spark.createDataFrame([("a", "browser-download", "http://x"), ("b", "browser-download", "http://x")], "path string, source string, where string")
    r = case.compare(evidence(spark, rows), leaders, "a", "b").first()
    assert r["shared"] == ["Make", "Software"] and r["differing"] == ["Model"] and r["interval"] == "20 seconds" and r["left"] == "browser-download: http://x" and r["assessment"].startswith("made and acquired together")
    bare = case.compare(evidence(spark, []), leaders, "x", "y").first()
    assert bare["left"] == "no origin record" and bare["assessment"] == "too little recorded to compare"


def edges(spark):
    rows = [("file:/d/=a.txt", "email:x@y.com", "has identifier", 2, "content", "1", "2020-01-02"), ("file:/d/=a.txt", "email:x@y.com", "has identifier", 1, "content", "2", "2020-01-01"), ("file:/d/b\u0001<.txt", "person:ann & co", "author", 1, "xmp", None, None), ("file:b", "file:a", "same document", 3, "xmp", None, None), ("file:a", "file:b", "same document", 2, "xmp", None, None)]
    df = spark.createDataFrame(rows, "source string, target string, kind string, count long, s string, place string, at string")
    return graph.claims(df.select("source", "target", "kind", "count", F.array(F.struct(F.col("s").alias("source"), "place", F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("match"), F.lit(None).cast("string").alias("rule"), "at")).alias("evidence")))


def test_graph_exports(spark, tmp_path):
    e = edges(spark)
    sinks.write_graph_csv(e, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*"))[:1])
    assert len(next(csv.reader(io.StringIO(text)))) == 17
    rows = {(r["source"], r["kind"]): r for r in sinks.graph_table(e).collect()}
    one = rows[("file:/d/=a.txt", "has identifier")]
    assert (one["weight"], one["evidence_count"], one["evidence_place"], one["evidence_at"], one["label"], one["source_label"]) == (3, 2, "1 | 2", "2020-01-01", "HAS_IDENTIFIER", "=a.txt") and rows[("file:a", "same document")]["weight"] == 3
    parts = sorted(sinks.graphml(e).collect())
    tree = ElementTree.fromstring("\n".join([*sinks.GRAPHML_HEAD, *(p["value"] for p in parts), *sinks.GRAPHML_TAIL]))
    names = [x.get("id") for x in tree.iter() if x.tag.endswith("}node")]
    assert len(names) == 6 and "file:/d/b\\u0001<.txt" in names and len([x for x in tree.iter() if x.tag.endswith("}edge")]) == 3
    files = spark.createDataFrame([("/d/=a.txt", 5, "ab" * 32)], "path string, size long, sha256 string")
    objects = {r["id"]: json.loads(r["value"]) for r in sinks.case_objects(e, files, "/d").collect()}
    at = f"kb:{uuid.uuid5(sinks.NAMESPACE, 'sha256:' + 'ab' * 32)}"
    assert len(objects) == 9 and objects[at]["uco-observable:sizeInBytes"] == 5 and all(o["@id"] == k for k, o in objects.items()) and sum("uco-core:source" in o for o in objects.values()) == 3
    assert [r["id"] for r in graph.picture(graph.node_table(e), 2).collect()][0] in ("file:a", "file:b", "file:/d/=a.txt", "email:x@y.com", "file:/d/b\u0001<.txt", "person:ann & co")
    assert spark.range(1).select(graph.node_label(F.lit("message_id")), sinks.inert(F.lit("@x")), sinks.shortened(F.lit("a" * 1001))).first()[:2] == (":MessageId", "'@x")


def test_json_leaves_out_what_says_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "", [], None), (2, "x", ["a"], {"k": "v"})], "n int, s string, l array<string>, m map<string,string>")
    got = sorted(json.loads(r["value"])["n"] for r in sinks.json_lines(df, "scan").collect())
    one = json.loads(sinks.json_lines(df.where("n = 1"), "scan", 2).first()["value"])
    assert got == [1, 2] and one == {"schema": "scan/2", "n": 1}
    sinks.write_json(df, str(tmp_path / "j"), "scan")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_json(df, str(tmp_path / "j"), "scan")


def test_joins_of_traces(spark):
    files = spark.createDataFrame([("/d/a.mp4", "a.mp4", 5), ("/d/a.info.json", "a.info.json", 1), ("/d/b.txt", "b.txt", 7)], "path string, name string, size long")
    assert [(r["path"], r["sidecar"]) for r in correlate.by_sibling(files, ".info.json").collect()] == [("/d/a.mp4", "/d/a.info.json")]
    links = spark.createDataFrame([("b.txt", "/d/b.txt", 1), ("a.mp4", "C:\\x", 5)], "name string, opened_from string, bytes long")
    assert {(r["path"], r["basis"]) for r in correlate.shortcuts(files, links).collect()} == {("/d/b.txt", "recorded-path"), ("/d/a.mp4", "name+size")}
    own = spark.createDataFrame([("p", "browser-download", None, "http://A.com/x/", "http://r.com")], "path string, source string, tool string, url string, referrer string")
    ids = spark.createDataFrame([("url", "http://a.com/x")], "type string, normalized string")
    assert [(r["target"], r["kind"]) for r in correlate.origin_urls(own, ids).collect()] == [("url:http://a.com/x", "origin URL")]


CLEAN = {"a.jpg": (JPEG + b"\xff\xd9", "EXIF and XMP"), "b.png": (PNG + b"\0\0\0\0IEND\0\0\0\0", "text"), "c.mp4": (MP4, "udta"), "d.docx": (DOCX, "docProps/core.xml"), "e.svg": (b"<svg><!-- Generator: X --><metadata>m</metadata><g inkscape:label='a'/></svg>", "comments")}


def test_cleaning(spark):
    rows = [(k, d) for k, (d, _) in CLEAN.items()] + [("f.pdf", PDF), ("g.jpg", b"no"), ("h.png", None)]
    got = {r["path"]: r for r in clean.cleaned(spark.createDataFrame(rows, "path string, content binary")).collect()}
    for name, (data, part) in CLEAN.items():  # links and field orders of a document are part of its text
        assert part in got[name]["removed"] and got[name]["remaining"] == (["ooxml-properties"] if name == "d.docx" else []) and got[name]["body"] is not None, got[name]
    assert b"\xff\xda" in got["a.jpg"]["body"] and len(got["c.mp4"]["body"]) == len(MP4) and zipfile.ZipFile(io.BytesIO(got["d.docx"]["body"])).read("word/document.xml")
    assert all(got[n]["body"] is None and got[n]["note"] for n in ("f.pdf", "g.jpg", "h.png"))
    total = clean.summary(clean.cleaned(spark.createDataFrame(rows, "path string, content binary"))).first()
    assert tuple(total) == (8, 5, 1)


def test_signatures(spark):
    heads = {"png": PNG, "pdf": PDF, "docx": DOCX, "mp4": MP4, "jpg": JPEG}
    rows = [(f"/x/a.{s}", d) for s, d in heads.items()] + [("/x/odd.pdf", PNG), ("/x/page.txt", b"<!DOCTYPE html>"), ("/x/pic.png", b"<svg xmlns=''>"), ("/x/v.wav", b"RIFF\0\0\0\0AVI "), ("/x/empty.png", b"")]
    got = {r["path"]: r["format"] for r in tables.misnamed(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"/x/odd.pdf": "PNG", "/x/pic.png": "SVG", "/x/v.wav": "AVI"}
    assert [r[0] for r in spark.createDataFrame([("/a/.git/x",), ("/a/b.repro/x",), ("/a/git/x",)], "p string").select(tables.skipped(F.col("p"))).collect()] == [True, True, False]


def test_a_case_over_a_folder(spark, tmp_path):
    root, home = tmp_path / "evidence", tmp_path / "home"
    (root / "node_modules").mkdir(parents=True)
    home.mkdir()
    for name, data in (("a.jpg", JPEG), ("b.pdf", PDF), ("c.txt", b"mail ann@example.com or 10.0.0.1"), ("d.txt", b"ann@example.com"), ("node_modules/x.txt", b"no@example.com")):
        (root / name).write_bytes(data)
    (home / ".bash_history").write_bytes(b"#1577934245\nwget http://a.com/c.txt\n")
    (home / "recently-used.xbel").write_bytes(f"<xbel><bookmark href='file://{root}/c.txt' visited='2020-01-02T03:04:05Z'/></xbel>".encode())
    own = engine.Case(spark, str(root), trace_root=str(home))
    assert own.files().count() == 4 and own.files("found").count() == 3 and own.files("none").count() == 1
    ids = {(r["type"], r["normalized"]): r["files"] for r in own.pivots().collect()}
    assert ids[("email", "ann@example.com")] == 2 and ids[("ipv4", "10.0.0.1")] == 1 and ("email", "no@example.com") not in ids and ("person", "ann") in ids
    assert {r["normalized"] for r in own.pivots("email", True).collect()} == {"ann@example.com"}
    assert own.neighbors("email:ann@example.com", "has identifier").count() == 2
    path = own.files_table.where("name = 'c.txt'").first()["path"]
    assert [r["source"] for r in own.explain(path).collect()] == ["recent-documents"]
    states = {r["source"]: r["state"] for r in own.coverage().collect()}
    assert states["xmp"] == states["recent-documents"] == "searched" and states["torrent"] == "unavailable"
    assert own.verdicts().count() == 3 and own.tallies().where("tally = 'metadata'").first()["files"] == 2
    with pytest.raises(ValueError):
        own.file("/etc/passwd")
    with pytest.raises(ValueError):
        own.file(f"{root}/../x")
    assert readers.READERS
