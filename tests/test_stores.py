"""Document texts and trace stores against specimens that are built here."""

import io
import json
import plistlib
import random
import sqlite3
import struct
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from sieveline.sources import documents as D
from sieveline.sources import stores as S


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


MAIL = (
    b"Received: from mx.example.com (mx [192.0.2.1]) by in.example.org with ESMTP id AB1 for <ann@example.org>; Thu, 2 Jan 2020 03:04:05 +0200\r\nReceived: from pc by mx.example.com; Thu, 2 Jan 2020 03:00:00 +0200\r\n"
    b"From: Bob <bob@example.com>\r\nSubject: Hi\r\nDate: Thu, 2 Jan 2020 01:00:00 +0000\r\nX-Mailer: Mailer 1\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"
    b"aGVsbG8gYUBiLmNvbQ==\r\n--b\r\nContent-Type: text/html\r\n\r\n<p>see <a href='http://x.com/1'>it</a>\r\n--b\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename=a.txt\r\n\r\none\r\n--b\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename=a.txt\r\n\r\ntwo\r\n--b--\r\n"
)
GPX = "<gpx><wpt lat='1.5' lon='2.5'/><trk><trkpt lat='1' lon='2'/><trkpt lat='3' lon='4'/><trkpt lat='5' lon='6'/></trk></gpx>"
KML = "<kml><Placemark><name>Home</name><Point><coordinates>21.0,52.2,0</coordinates></Point></Placemark><Placemark><LineString><coordinates>1,2 3,4</coordinates></LineString></Placemark></kml>"
PDF = b"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R 4 0 R] >> endobj
3 0 obj << /Type /Page /Contents 5 0 R >> endobj
4 0 obj << /Type /Page /Contents 6 0 R /Resources << /Font << /F1 7 0 R >> >> >> endobj
5 0 obj << /Length 1 >> stream
BT (Mail \\(a@b.com\\)) Tj T* [(two) -300 (words) 5 (!)] TJ ET
endstream endobj
6 0 obj << /Filter /FlateDecode >> stream
""" + zlib.compress(b"BT /F1 12 Tf <00010002> Tj ET") + b"""
endstream endobj
7 0 obj << /Type /Font /ToUnicode 8 0 R >> endobj
8 0 obj << /Length 2 >> stream
beginbfchar <0001> <0041> endbfchar beginbfrange <0002> <0003> <00e9> endbfrange
endstream endobj
"""

TEXTS = {
    "txt": (b"one\n\ntwo", [("line 1", "one"), ("line 3", "two")]),
    "csv": (b'a,"b\nc",\nd', [("row 1 \xb7 column 1", "a"), ("row 1 \xb7 column 2", "b\nc"), ("row 2 \xb7 column 1", "d")]),
    "html": (b"<p>x<a href='/y'>z</a><script>no</script>", [("element 1", "x"), ("element 2", "/y"), ("element 3", "z")]),
    "gpx": (GPX.encode(), [("waypoint 1", "geo:1.5,2.5"), ("track 1 start", "geo:1,2"), ("track 1 end", "geo:5,6")]),
    "geojson": (json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [21, 52.5]}}, {"geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}}]}).encode(), [("feature 1", "geo:52.5,21"), ("feature 2 start", "geo:2,1"), ("feature 2 end", "geo:4,3")]),
    "docx": (zipped({"word/document.xml": "<w:t>Dear a@b.com</w:t>", "word/comments.xml": "<w:t>note</w:t>", "x.bin": "no"}), [("body", "Dear a@b.com"), ("comments", "note")]),
    "pptx": (zipped({"ppt/slides/slide3.xml": "<a:t>S</a:t>"}), [("slide 3", "S")]),
    "kmz": (zipped({"doc.kml": KML}), [("map", None), ("placemark 1", "geo:52.2,21.0"), ("placemark 2 start", "geo:2,1"), ("placemark 2 end", "geo:4,3")]),
    "pdf": (PDF, [("page 1", "Mail (a@b.com)\ntwo words!"), ("page 2", "A\xe9")]),
    "eml": (MAIL, [("body", "hello a@b.com"), ("body (html)", "see  http://x.com/1 it")]),
}


@pytest.mark.parametrize("suffix", TEXTS)
def test_texts(suffix):
    data, want = TEXTS[suffix]
    got = D.read(suffix, data)
    for place, text in want:
        assert any(p == place and (text is None or t.strip() == text or t.split() == text.split()) for p, t in got), got
    for n in range(0, len(data), max(1, len(data) // 25)):
        D.read(suffix, data[:n])


def test_budget_cuts_the_passage_that_reaches_it():
    assert D.read("txt", b"abc\ndefg\nhij", 5) == [("line 1", "abc"), ("line 2", "de")]
    assert D.decoded("é".encode("utf-16")) == "é" and D.decoded(b"\xef\xbb\xbfa") == "a" and D.decoded(b"\xe9") == "é"


def database(*statements):
    db = sqlite3.connect(":memory:")
    for s in statements:
        db.execute(s)
    db.commit()
    return db.serialize()


CHROME = database(
    "CREATE TABLE downloads (id, target_path, tab_url, referrer, start_time, total_bytes, mime_type, state)", "CREATE TABLE downloads_url_chains (id, chain_index, url)", f"INSERT INTO downloads VALUES (1, '/d/a.zip', 'http://t', 'http://r', {(11644473600 + 86400) * 10**6}, 9, 'x', 1)",
    "INSERT INTO downloads_url_chains VALUES (1, 0, 'http://one'), (1, 1, 'http://two')",
)
FIREFOX = database(
    "CREATE TABLE moz_annos (place_id, anno_attribute_id, content, dateAdded)", "CREATE TABLE moz_anno_attributes (id, name)", "CREATE TABLE moz_places (id, url)", "INSERT INTO moz_places VALUES (7, 'http://f')",
    "INSERT INTO moz_anno_attributes VALUES (1, 'downloads/destinationFileURI'), (2, 'downloads/metaData')", "INSERT INTO moz_annos VALUES (7, 1, 'file:///d/b%20c.zip', 86400000000), (7, 2, '{\"fileSize\": 5}', 0)",
)
QUARANTINE = database("CREATE TABLE LSQuarantineEvent (LSQuarantineEventIdentifier, LSQuarantineTimeStamp, LSQuarantineAgentName, LSQuarantineDataURLString, LSQuarantineOriginURLString)", "INSERT INTO LSQuarantineEvent VALUES ('ID1', 86400, 'Safari', 'http://a.com/x%20y.dmg', 'http://o')")
TORRENT = b"d8:announce8:http://a13:announce-listll8:http://b8:http://aee10:created by3:mkt13:creation datei86400e4:infod5:filesld6:lengthi5e4:pathl1:d5:a.txteed6:lengthi7e4:pathl5:b.bineee4:name1:t12:piece lengthi1eee"
LINK = struct.pack("<I", 76) + b"\0" * 16 + struct.pack("<I", 2) + b"\0" * 20 + struct.pack("<QI", (11644473600 + 86400) * 10**7, 42) + b"\0" * 20
LINK += struct.pack("<5I", 60, 28, 1, 28, 45) + b"\0" * 8 + struct.pack("<IIII", 17, 3, 0xABCD1234, 16) + b"\0" + b"C:\\x\\a.doc\0" + b"\0" * 8

STORES = {
    "/h/.config/google-chrome/Default/History": (CHROME, {"target": "/d/a.zip", "url": "http://two", "at": "1970-01-02T00:00:00Z", "bytes": 9, "tool": "chrome", "referrer": "http://r"}),
    "/h/.mozilla/firefox/p/places.sqlite": (FIREFOX, {"target": "/d/b c.zip", "url": "http://f", "at": "1970-01-02T00:00:00Z", "bytes": 5, "tool": "firefox"}),
    "/h/com.apple.LaunchServices.QuarantineEventsV2": (QUARANTINE, {"target": "x y.dmg", "at": "2001-01-02T00:00:00Z", "tool": "Safari"}),
    "/h/.bash_history": (b"#1577934245\nsudo wget http://a.com/f.zip -O 'my file.zip'\nls\n", {"tool": "wget", "at": "2020-01-02T03:04:05Z", "url": "http://a.com/f.zip"}),
    "/h/.zsh_history": (b": 1577934245:0;curl -o x http://b\n", {"tool": "curl", "at": "2020-01-02T03:04:05Z", "command": "curl -o x http://b"}),
    "/h/fish_history": (b"- cmd: git clone x\n  when: 1577934245\n", {"tool": "git", "at": "2020-01-02T03:04:05Z"}),
    "/h/recently-used.xbel": (b"<xbel xmlns:b='b'><bookmark href='file:///d/a%20b' visited='2020-01-02T03:04:05.6Z'><info><b:application name='Viewer'/></info></bookmark></xbel>", {"target": "/d/a b", "tool": "Viewer", "at": "2020-01-02T03:04:05Z"}),
    "/h/.local/share/Trash/info/a.txt.trashinfo": (b"[Trash Info]\nPath=/h/d%20e/a.txt\nDeletionDate=2020-01-02T03:04:05\n", {"target": "/h/.local/share/Trash/files/a.txt", "at": "2020-01-02T03:04:05Z"}),
    "/d/a.exe:Zone.Identifier": (b"[ZoneTransfer]\r\nZoneId=3\r\nHostUrl=http://h\r\n", {"target": "/d/a.exe", "url": "http://h"}),
    "/d/v.info.json": (json.dumps({"webpage_url": "http://v", "epoch": 86400, "title": "T"}).encode(), {"target": "/d/v", "url": "http://v", "at": "1970-01-02T00:00:00Z"}),
    "/h/.config/Nextcloud/nextcloud.cfg": (b"[Accounts]\n0\\Folders\\1\\localPath=/h/Cloud/\n", {"target": "/h/Cloud", "tool": "Nextcloud"}),
    "/h/.dropbox/info.json": (b'{"personal": {"path": "/h/Dropbox"}}', {"target": "/h/Dropbox", "tool": "Dropbox"}),
    "/h/syncthing/config.xml": (b"<configuration><folder path='/h/Sync/'/></configuration>", {"target": "/h/Sync", "tool": "Syncthing"}),
    "/d/t.torrent": (TORRENT, {"target": "a.txt", "bytes": 5, "at": "1970-01-02T00:00:00Z", "tool": "mkt"}),
    "/d/a.lnk": (LINK, {"target": "a.doc", "at": "1970-01-02T00:00:00Z", "bytes": 42}),
    "/d/m.eml": (MAIL, {"source": "email-delivery", "tool": "in.example.org", "at": "2020-01-02T01:04:05Z"}),
}


@pytest.mark.parametrize("path", STORES)
def test_store(path):
    data, want = STORES[path]
    got = S.parse(path, data)
    assert got and {k: got[0].get(k) for k in want} == want, got
    random.seed(2)
    for _ in range(40):
        odd = bytearray(data[: random.randint(0, len(data))])
        for _ in range(min(len(odd), 3)):
            odd[random.randrange(len(odd))] = random.randrange(256)
        S.parse(path, bytes(odd))


def test_store_details():
    assert S.parse("/h/.bash_history", STORES["/h/.bash_history"][0])[1]["command"] == "ls"
    second = S.parse("/d/t.torrent", TORRENT)[1]
    assert second["target"] == "b.bin" and second["fields"]["trackers"] == "http://a http://b" and second["url"].startswith("magnet:?xt=urn:btih:")
    assert S.parse("/d/a.lnk", LINK)[0]["fields"] == {"OpenedFrom": "C:\\x\\a.doc", "VolumeSerial": "ABCD1234"}
    mail = S.parse("/d/m.eml", MAIL)
    assert [r["source"] for r in mail] == ["email-delivery", "email-relay", "email-header"] and mail[0]["fields"]["ConnectingAddress"] == "192.0.2.1" and mail[2]["tool"] == "Mailer 1"
    assert list(S.where_froms(plistlib.dumps(["http://u", "http://r"], fmt=plistlib.FMT_BINARY), "/a"))[0]["referrer"] == "http://r"
    assert S.quarantine_attribute("0083;5e0d5da5;Safari;ID1") == {"flags": "0083", "at": "2020-01-02T03:04:05Z", "agent": "Safari", "id": "ID1"}
    with pytest.raises(ValueError):
        S.bdecode(b"l" * 100)


def test_archives_and_what_files_carry(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("d/x.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    rows = [("/a.zip", zipped({"d/y.txt": "hello"})), ("/b.tar.gz", tar.getvalue()), ("/c.txt.gz", __import__("gzip").compress(b"plain")), ("/m.eml", MAIL), ("/bad.zip", b"PK\3\4"), ("/n.zip", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {(r["container"], r["name"], r["size"], bytes(r["content"])) for r in S.archive_members(df).collect()}
    assert got == {("/a.zip", "y.txt", 5, b"hello"), ("/b.tar.gz", "x.txt", 3, b"abc"), ("/c.txt.gz", "c.txt", 5, b"plain")}
    assert [(r["name"], bytes(r["content"]).strip()) for r in S.carried_files(df).orderBy("name").collect()] == [("a (2).txt", b"two"), ("a.txt", b"one")]
    stores = spark.createDataFrame([(p, d) for p, (d, _) in STORES.items()] + [("/x/none", b"")], "path string, content binary").repartition(4)
    assert {r["store"] for r in S.traces(stores).select("store").collect()} == set(STORES)
    texts = spark.createDataFrame([(f"/t/a.{s}", d) for s, (d, _) in TEXTS.items()] + [("/t/a.bin", b"x"), ("/t/n.txt", None)], "path string, content binary")
    assert {r["path"] for r in D.passages(texts).select("path").distinct().collect()} == {f"/t/a.{s}" for s in TEXTS}


def test_attachments_of_pdf_and_packed_objects():
    pdf = b"%PDF-1.4\n1 0 obj << /Type /Filespec /F (a.txt) /EF << /F 2 0 R >> >> endobj\n2 0 obj << /Type /EmbeddedFile /Filter /FlateDecode >> stream\n" + zlib.compress(b"inside") + b"\nendstream endobj\n"
    assert list(S.children(pdf, "/x.pdf")) == [("a.txt", b"inside")] and list(S.children(b"no", "/x.pdf")) == []
    body = struct.pack("<IH", 0, 2) + b"C:\\d\\tool.exe\0C:\\d\\tool.exe\0" + struct.pack("<II", 3, 4) + b"tmp\0" + struct.pack("<I", 5) + b"bytes"
    assert S.packager(body) == ("tool.exe", b"bytes") and S.packager(body[:-1]) is None and S.packager(b"") is None and list(S.children(b"no", "/x.doc")) == []


def test_messenger_names(spark):
    names = ["IMG-20240115-WA0001.jpg", "IMG-20241315-WA0001.jpg", "photo_2024-01-15_10-11-12.jpg", "holiday.jpg"]
    got = {r["n"]: r["m"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", S.messenger(F.col("n")).alias("m")).collect()}
    assert tuple(got[names[0]]) == ("WhatsApp", "img", "2024-01-15") and got[names[1]] is None and tuple(got[names[2]]) == ("Telegram", "photo", "2024-01-15") and got[names[3]] is None


def test_history_matches(spark):
    names = ["tmp", "report.pdf", "a.b", "archive.tar.gz", "notes.txt"]
    commands = ["wget http://x/report.pdf", "cp /tmp/a.b /y", "tar xf 'old-archive.tar.gz.bak'", "cat notes", "ls /tmp/"]
    files = spark.createDataFrame([(f"/d/{n}", n) for n in names], "path string, name string")
    own = spark.createDataFrame([(c, {"words": "\n".join(S.command_words(c)[1])}) for c in commands], "command string, fields map<string,string>")
    got = {(r["path"], r["command"]) for r in S.history_matches(files, own).collect()}
    want = {(f"/d/{n}", c) for n in names for c in commands if n in (w := S.command_words(c)[1]) or n in [x.rstrip("/").rpartition("/")[2] for x in w] or (len(n) >= 6 and "." in n and n in c)}
    assert got == want
