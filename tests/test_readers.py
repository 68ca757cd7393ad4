"""Readers against specimens that are built here, and on broken ones."""

import io
import json
import random
import struct
import zipfile
import zlib

import pytest

from sieveline.sources import readers as R


def tiff(entries, gps=()):
    """A little-endian TIFF of text tags, with a GPS directory of texts and rationals."""
    n = len(entries) + bool(gps)
    blob, out, base = b"", b"", 8 + 2 + 12 * n + 4
    for tag, text in entries:
        raw = text.encode() + b"\0"
        out += struct.pack("<HHI", tag, 2, len(raw)) + (struct.pack("<I", base + len(blob)) if len(raw) > 4 else raw.ljust(4, b"\0"))
        blob += raw if len(raw) > 4 else b""
    if gps:
        at = base + len(blob)
        out += struct.pack("<HHII", 0x8825, 4, 1, at)
        more, body, start = b"", b"", at + 2 + 12 * len(gps) + 4
        for tag, value in gps:
            if isinstance(value, str):
                more += struct.pack("<HHI", tag, 2, 2) + value.encode().ljust(4, b"\0")
            else:
                more += struct.pack("<HHII", tag, 5, len(value), start + len(body))
                body += b"".join(struct.pack("<II", round(v * 1000), 1000) for v in value)
        blob += struct.pack("<H", len(gps)) + more + b"\0\0\0\0" + body
    return b"II*\0" + struct.pack("<IH", 8, n) + out + b"\0\0\0\0" + blob


EXIF = tiff([(0x10F, "Canon"), (0x110, "Canon EOS 5D"), (0x131, "Editor 2"), (0x132, "2020:01:02 03:04:05"), (0x13B, "Ann")], [(1, "N"), (2, [52, 13, 46.92]), (3, "W"), (4, [21, 0, 44])])
XMP = b"""<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:xmpMM="http://ns.adobe.com/xap/1.0/mm/"
 xmlns:stEvt="http://ns.adobe.com/xap/1.0/sType/ResourceEvent#" xmlns:stRef="http://ns.adobe.com/xap/1.0/sType/ResourceRef#" xmp:CreatorTool="Tool 1" xmp:CreateDate="2021-05-06T07:08:09+02:00"><dc:creator><rdf:Seq><rdf:li>Ann</rdf:li><rdf:li>Bob</rdf:li></rdf:Seq></dc:creator>
 <xmpMM:DerivedFrom stRef:documentID="xmp.did:12345678"/><xmpMM:History><rdf:Seq><rdf:li stEvt:action="saved" stEvt:when="2021-05-07T00:00:00Z" stEvt:softwareAgent="Tool 2"/><rdf:li stEvt:action="undated"/></rdf:Seq></xmpMM:History></rdf:Description></rdf:RDF></x:xmpmeta>"""


def irb(number, body):
    return b"8BIM" + struct.pack(">H", number) + b"\0\0" + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)


def dataset(record, number, text):
    return bytes([0x1C, record, number]) + struct.pack(">H", len(text)) + text


IPTC = dataset(1, 90, b"\x1b%G") + dataset(2, 80, "Zoë".encode()) + dataset(2, 55, b"20200102") + dataset(2, 60, b"101112+0200") + dataset(2, 90, b"Oslo") + dataset(2, 25, b"a") + dataset(2, 25, b"b")


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


ICC = bytearray(132 + 12 + 20)
ICC[36:40], ICC[16:20], ICC[24:36] = b"acsp", b"RGB ", struct.pack(">6H", 2019, 1, 2, 3, 4, 5)
ICC[128:132], ICC[132:144], ICC[144:164] = struct.pack(">I", 1), struct.pack(">4sII", b"desc", 144, 20), b"desc\0\0\0\0" + struct.pack(">I", 5) + b"sRGB\0\0\0\0"
JPEG = (
    b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\2\1\0\x48\0\x48\0\0") + segment(0xE1, b"Exif\0\0" + EXIF) + segment(0xE2, b"ICC_PROFILE\0\1\1" + bytes(ICC)) + segment(0xED, b"Photoshop 3.0\0" + irb(0x0404, IPTC) + irb(0x040A, b"\1") + irb(0x040B, b"http://a.com"))
    + segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + XMP) + b"\xff\xda\0\2" + b"\0" * 9
)


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + b"\0\0\0\0"


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"Software\0Draw 3") + chunk(b"zTXt", b"Comment\0\0" + zlib.compress(b"hello")) + chunk(b"iTXt", b"Author\0\0\0\0\0" + "Zoë".encode()) + chunk(b"tEXt", b"Creation Time\x002020-02-03T04:05:06Z") + chunk(b"eXIf", EXIF) + chunk(b"IDAT", b"") + chunk(b"tEXt", b"Late\0x")


def iff(order, name, body):
    return name + struct.pack(order + "I", len(body)) + body + b"\0" * (len(body) % 2)


def id3(version=3):
    frame = lambda name, text: name + struct.pack(">I", len(text) + 1) + b"\0\0" + b"\0" + text
    body = frame(b"TSSE", b"LAME 3") + frame(b"TYER", b"2001") + frame(b"TIT2", b"Song")
    return b"ID3" + bytes([version, 0, 0, 0, 0, len(body) >> 7, len(body) & 127]) + body


BEXT = b"desc".ljust(256, b"\0") + b"Recorder".ljust(32, b"\0") + b"ref".ljust(32, b"\0") + b"2020-01-02" + b"03:04:05" + struct.pack("<QH", 7, 1) + b"\0" * 254
INFO = b"INFO" + iff("<", b"ISFT", b"Audacity\0") + iff("<", b"INAM", b"Take")
WAV = iff("<", b"RIFF", b"WAVE" + iff("<", b"bext", BEXT) + iff("<", b"LIST", INFO) + iff("<", b"data", b"\0" * 5))
AIFF = iff(">", b"FORM", b"AIFF" + iff(">", b"NAME", b"Tune") + iff(">", b"ANNO", b"one") + iff(">", b"ANNO", b"two") + iff(">", b"COMM", struct.pack(">hIh", 2, 44100, 16) + struct.pack(">HQ", 16398, 44100 << 48)) + iff(">", b"ID3 ", id3()))
COMMENTS = struct.pack("<I", 6) + b"Lavf58" + struct.pack("<I", 2) + struct.pack("<I", 10) + b"TITLE=Song" + struct.pack("<I", 9) + b"DATE=2011"
FLAC = b"fLaC" + bytes([0, 0, 0, 34]) + b"\0" * 34 + bytes([0x84]) + len(COMMENTS).to_bytes(3, "big") + COMMENTS
OGG = b"OggS\0" + b"\0" * 21 + bytes([2, 8, len(COMMENTS) + 8]) + b"OpusHead" + b"OpusTags" + COMMENTS
APE_ITEMS = struct.pack("<II", 4, 0) + b"Year\0" + b"1999" + struct.pack("<II", 3, 0) + b"Artist\0" + b"A\0B"
APE = b"audio" * 9 + APE_ITEMS + b"APETAGEX" + struct.pack("<IIII", 2000, len(APE_ITEMS) + 32, 2, 0) + b"\0" * 8


def element(key, body):
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + bytes([0x40 | len(body) >> 8, len(body) & 255]) + body


MKV = element(0x1A45DFA3, b"") + element(0x18538067, element(0x1549A966, element(0x7BA9, b"Film") + element(0x4D80, b"libmatroska") + element(0x5741, b"mkvmerge") + element(0x4461, struct.pack(">q", 86400 * 10**9))))


def box(name, *bodies):
    body = b"".join(bodies)
    return struct.pack(">I4s", len(body) + 8, name) + body


MOOV = box(b"moov", box(b"mvhd", struct.pack(">III", 0, 2082844800 + 86400, 0) + b"\0" * 88), box(b"trak", box(b"mdia", box(b"hdlr", b"\0" * 8 + b"vide" + b"\0" * 12), box(b"minf", box(b"stbl", box(b"stsd", b"\0" * 8 + struct.pack(">I4s", 8, b"avc1")))))), box(b"udta", box(b"\xa9xyz", b"\0\x12\x15\xc7" + b"+52.2297+021.0122/"), box(b"\xa9too", b"\0\7\0\0Lavf58"), box(b"\xa9mak", b"\0\0\0\0Acme"), box(b"\xa9mod", b"\0\0\0\0Cam 1")))
MP4 = box(b"ftyp", b"isom\0\0\0\0") + MOOV

PDF = (
    b"%PDF-1.4\n1 0 obj\n<< /Producer (Lib \\(x\\)) /Creator <FEFF00410042> /Author (Ann) /CreationDate (D:20200102030405+02'00') >>\nendobj\n"
    b"2 0 obj << /Type /Filespec /F (a.txt) >> endobj\n3 0 obj << /S /URI /URI (http://a.com/x) >> endobj 4 0 obj << /OpenAction 5 0 R /JavaScript 6 0 R >> endobj\ntrailer << /Info 1 0 R /ID [<AA11> <BB22>] >>\n%%EOF\n1 0 obj\n<< /Producer (New) /Author (Ann) >>\nendobj\ntrailer << /Info 1 0 R >>\n%%EOF\n"
)


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = zipped({
    "docProps/core.xml": '<c:p xmlns:c="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:t="http://purl.org/dc/terms/"><dc:creator>Ann</dc:creator><c:lastModifiedBy>Bob</c:lastModifiedBy><t:created>2020-01-02T03:04:05Z</t:created></c:p>',
    "docProps/app.xml": '<P xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"><Application>Word</Application><AppVersion>16.0</AppVersion></P>',
    "word/_rels/document.xml.rels": '<R xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Type="http://x/hyperlink" Target="http://a.com" TargetMode="External"/></R>',
    "word/document.xml": '<w:document xmlns:w="w"><w:p><w:r><w:t>Dear a@b.com</w:t></w:r></w:p><w:instrText>DDEAUTO cmd x</w:instrText></w:document>',
})
ODT = zipped({"meta.xml": '<o:document-meta xmlns:o="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:m="urn:oasis:names:tc:opendocument:xmlns:meta:1.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><o:meta><m:generator>Office 7</m:generator><dc:creator>Ann</dc:creator><m:creation-date>2020-01-02T03:04:05</m:creation-date><m:document-statistic m:page-count="3"/><m:user-defined m:name="Dept">X</m:user-defined></o:meta></o:document-meta>'})
EPUB = zipped({"META-INF/container.xml": '<c xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="x.opf"/></rootfiles></c>', "x.opf": '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:creator>Ann</dc:creator><dc:date>2019</dc:date><meta name="generator" content="Sigil"/></metadata></package>'})
PE = bytearray(600)
PE[:2], PE[60:64], PE[128:140], PE[154:156] = b"MZ", struct.pack("<I", 128), b"PE\0\0" + struct.pack("<HHI", 0x8664, 1, 1577934245), bytes([14, 2])
PE[300:340] = b"RSDS" + bytes(range(16)) + struct.pack("<I", 3) + b"c:\\x\\a.pdb\0".ljust(16, b"\0")
PE[400:460] = ("ProductName\0\0Tool X\0".encode("utf-16-le")).ljust(60, b"\0")


def font():
    name = struct.pack(">HHH", 0, 2, 30) + struct.pack(">6H", 3, 1, 1033, 1, 8, 0) + struct.pack(">6H", 3, 1, 1033, 8, 8, 8) + "Face".encode("utf-16-be") + "Made".encode("utf-16-be")
    head = b"\0\1\0\0" + struct.pack(">i", 0x18000) + b"\0" * 12 + struct.pack(">QQ", 2082844800 + 86400, 0) + b"\0" * 18
    tables, at, directory, body = ((b"head", head), (b"name", name)), 12 + 32, b"", b""
    for tag, data in tables:
        directory += struct.pack(">4sIII", tag, 0, at + len(body), len(data))
        body += data
    return b"\0\1\0\0" + struct.pack(">HHHH", 2, 0, 0, 0) + directory + body + b"\0" * 8


def ole():
    text = b"Ann\0"
    section = struct.pack("<II", 0, 2) + struct.pack("<IIII", 4, 24, 12, 24 + 12) + struct.pack("<II", 30, len(text)) + text + struct.pack("<IQ", 64, (11644473600 + 86400) * 10**7)
    stream = b"\xfe\xff" + b"\0" * 26 + b"\0" * 16 + struct.pack("<I", 48) + section
    stream = stream.ljust(4096, b"\0")
    entry = lambda name, kind, child, start, size: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<H", 2 * len(name) + 2) + bytes([kind, 1]) + struct.pack("<III", 0xFFFFFFFF, 0xFFFFFFFF, child)).ljust(116, b"\0") + struct.pack("<IQ", start, size)
    directory = entry("Root Entry", 5, 1, 0xFFFFFFFE, 0) + entry("\x05SummaryInformation", 2, 0xFFFFFFFF, 2, len(stream)) + b"\0" * 256
    fat = struct.pack("<128I", 0xFFFFFFFD, 0xFFFFFFFE, *range(3, 10), 0xFFFFFFFE, *[0xFFFFFFFF] * 118)
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + fat + directory + stream


CASES = {
    "exif": ("jpg", JPEG, {"tool": "Canon EOS 5D (processed with Editor 2)", "at": "2020-01-02T03:04:05Z", "geo": "52.22970,-21.01222", "source": "device-metadata"}, {"Artist": "Ann", "JFIF:Version": "1.02", "JFIF:Density": "72x72 dots per inch", "ICC:ColorSpace": "RGB", "ICC:Description": "sRGB", "ICC:Created": "2019-01-02T03:04:05Z"}),
    "iptc": ("jpg", JPEG, {"at": "2020-01-02T08:11:12Z", "location": "Oslo", "source": "iptc"}, {"By-line": "Zoë", "Keywords": "a, b"}),
    "photoshop-irb": ("jpg", JPEG, {}, {"Photoshop:CopyrightFlag": "copyrighted", "Photoshop:URL[1]": "http://a.com"}),
    "xmp": ("jpg", JPEG, {"tool": "Tool 1", "at": "2021-05-06T05:08:09Z", "note": "author Ann, Bob"}, {"dc:creator": "Ann, Bob", "xmpMM:DerivedFrom/stRef:documentID": "xmp.did:12345678"}),
    "xmp-history": ("jpg", JPEG, {"at": "2021-05-07T00:00:00Z", "tool": "Tool 2"}, {"stEvt:action": "saved"}),
    "png-text": ("png", PNG, {"tool": "Draw 3", "at": "2020-02-03T04:05:06Z", "note": "author Zoë"}, {"Comment": "hello", "Model": "Canon EOS 5D"}),
    "riff": ("wav", WAV, {"tool": "Recorder (edited with Audacity)", "at": "2020-01-02T03:04:05Z"}, {"Title": "Take", "bext:Description": "desc", "bext:TimeReference": "7"}),
    "aiff": ("aif", AIFF, {"tool": "LAME 3", "at": "2001-01-01T00:00:00Z"}, {"Name": "Tune", "Annotation": "one", "Annotation[2]": "two", "SampleRate": "44100 Hz", "Duration": "1.0 s"}),
    "id3": ("mp3", id3() + b"\xff\xfb", {"tool": "LAME 3", "at": "2001-01-01T00:00:00Z"}, {"title": "Song"}),
    "ape-tag": ("ape", APE, {"at": "1999-01-01T00:00:00Z"}, {"Artist": "A / B"}),
    "vorbis-comment": ("flac", FLAC, {"tool": "Lavf58", "at": "2011-01-01T00:00:00Z"}, {"TITLE": "Song"}),
    "matroska": ("mkv", MKV, {"tool": "mkvmerge (muxed with libmatroska)", "at": "2001-01-02T00:00:00Z"}, {"Title": "Film"}),
    "isobmff": ("mp4", MP4, {"tool": "Acme Cam 1 (encoded with Lavf58)", "at": "1970-01-02T00:00:00Z", "geo": "52.22970,21.01220", "source": "device-metadata"}, {"Track[1]": "vide avc1"}),
    "pdf-info": ("pdf", PDF, {"tool": "New", "note": "author Ann"}, {"IncrementalUpdates": "1", "Update[1]:Replaced": "1", "PermanentID": "aa11", "ChangingID": "bb22", "EmbeddedFile[1]": "a.txt", "URI[1]": "http://a.com/x", "OpenAction": "present", "JavaScript": "present"}),
    "ooxml-properties": ("docx", DOCX, {"tool": "Word 16.0", "at": "2020-01-02T03:04:05Z", "note": "author Ann; last edited by Bob"}, {"ExternalLink[1]": "hyperlink: http://a.com", "DDE[1]": "DDEAUTO cmd x"}),
    "odf-meta": ("odt", ODT, {"tool": "Office 7", "at": "2020-01-02T03:04:05Z"}, {"page-count": "3", "Dept": "X"}),
    "epub-package": ("epub", EPUB, {"tool": "Sigil", "at": "2019-01-01T00:00:00Z"}, {"creator": "Ann"}),
    "rtf-generator": ("rtf", b"{\\rtf1{\\*\\generator Msftedit 5.41;}}", {"tool": "Msftedit 5.41"}, {}),
    "svg-metadata": ("svg", b'<svg><!-- Generator: Draw 2 --><dc:creator>Ann</dc:creator></svg>', {"tool": "Draw 2", "note": "author Ann"}, {}),
    "notebook-kernel": ("ipynb", json.dumps({"metadata": {"kernelspec": {"display_name": "Py 3"}, "language_info": {"name": "python", "version": "3.1"}}}).encode(), {"tool": "Jupyter (Py 3, python 3.1)"}, {}),
    "web-document": ("html", b'<html lang="en"><title>T</title><meta name=generator content="Gen 1"><link rel=canonical href="http://a.com/"><script type="application/ld+json">{"headline": "H", "author": {"name": "Ann"}, "datePublished": "2020-01-02"}</script>', {"tool": "Gen 1", "at": "2020-01-02T00:00:00Z", "note": "author Ann"}, {"canonical": "http://a.com/", "lang": "en", "jsonld:headline": "H"}),
    "pe-header": ("exe", bytes(PE), {"tool": "Tool X", "at": "2020-01-02T03:04:05Z"}, {"Machine": "x64", "LinkerVersion": "14.2", "PDBPath": "c:\\x\\a.pdb", "PDBAge": "3"}),
    "font-tables": ("ttf", font(), {"tool": "Made", "at": "1970-01-02T00:00:00Z", "note": "family Face"}, {"FontRevision": "1.500", "Container": "TrueType"}),
    "ole-summary": ("doc", ole(), {"at": "1970-01-02T00:00:00Z", "note": "author Ann"}, {"Author": "Ann"}),
}


@pytest.mark.parametrize("block", CASES)
def test_reader(block):
    suffix, data, want, fields = CASES[block]
    got = [r for r in R.read(suffix, data) if r["block"] == block]
    assert got, R.read(suffix, data)
    assert {k: got[0].get(k) for k in want} == want and {k: got[0]["fields"].get(k) for k in fields} == fields


def test_opus_tags_and_an_info_of_the_past():
    assert R.read("opus", OGG)[0]["fields"]["TITLE"] == "Song"
    first = PDF[: PDF.index(b"%%EOF") + 5]
    assert R.read("pdf", first)[0]["tool"] == "Lib (x) (created in AB)" and R.read("pdf", first)[0]["at"] == "2020-01-02T01:04:05Z"


@pytest.mark.parametrize("block", CASES)
def test_broken_files(block):
    suffix, data, _, _ = CASES[block]
    random.seed(1)
    for n in [0, 1, 3, 8, 11, 12, 20, len(data) // 2, len(data) - 1]:
        R.read(suffix, data[:n])
    for _ in range(60):
        odd = bytearray(data)
        for _ in range(random.randint(1, 8)):
            odd[random.randrange(len(odd))] = random.choice([0, 255, random.randrange(256)])
        R.read(suffix, bytes(odd))


def test_records_of_a_table(spark):
    rows = [(f"/x/{b}.{s}", d) for b, (s, d, _, _) in CASES.items()] + [("/x/none.xyz", b"abc"), ("/x/empty.pdf", b""), ("/x/null.png", None)]
    got = R.records(spark.createDataFrame(rows, "path string, content binary").repartition(3)).collect()
    assert {r["block"] for r in got} >= set(CASES) and not any(r["path"].startswith(("/x/none", "/x/empty", "/x/null")) for r in got)
    assert all(r["fields"] is not None for r in got)


def coded(value):
    """A value as CBOR."""
    head = lambda major, n: bytes([major << 5 | n]) if n < 24 else bytes([major << 5 | 24, n]) if n < 256 else bytes([major << 5 | 25]) + n.to_bytes(2, "big")
    if isinstance(value, bool):
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return head(0, value)
    if isinstance(value, bytes):
        return head(2, len(value)) + value
    if isinstance(value, str):
        return head(3, len(value.encode())) + value.encode()
    if isinstance(value, list):
        return head(4, len(value)) + b"".join(map(coded, value))
    return head(5, len(value)) + b"".join(coded(k) + coded(v) for k, v in value.items())


def jumb(label, *bodies):
    return box(b"jumb", box(b"jumd", b"\0" * 16 + b"\3" + label.encode() + b"\0"), *bodies)


def test_content_credentials():
    import hashlib

    from sieveline.sources import credentials as C

    plain = b"\x89PNG\r\n\x1a\n" + chunk(b"IDAT", b"abc") + chunk(b"IEND", b"")
    digest = hashlib.sha256(plain).digest()

    def store(want):
        hash_ = jumb("c2pa.hash.data", box(b"cbor", coded({"alg": "sha256", "hash": want, "exclusions": [{"start": 8, "length": size[0]}]})))
        acts = jumb("c2pa.actions", box(b"cbor", coded({"actions": [{"action": "c2pa.created", "when": "2024-01-02T03:04:05Z", "digitalSourceType": "http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia", "softwareAgent": {"name": "Maker", "version": "2"}}]})))
        part = jumb("c2pa.ingredient__1", box(b"cbor", coded({"title": "base.png", "relationship": "parentOf", "c2pa_manifest": "x"})))
        claim = jumb("c2pa.claim.v2", box(b"cbor", coded({"claim_generator_info": [{"name": "Signer", "version": "1"}]})))
        return jumb("c2pa", jumb("urn:uuid:1", jumb("c2pa.claim", box(b"cbor", coded({"claim_generator": "Old"})))), jumb("urn:uuid:2", hash_, acts, part, claim))

    size = [0]
    for _ in range(3):
        size[0] = len(chunk(b"caBX", store(digest)))
    for want, said in ((digest, "binding matches the file"), (b"\0" * 32, "binding does not match the file")):
        data = plain[:8] + chunk(b"caBX", store(want)) + plain[8:]
        r = next(r for r in R.read("png", data) if r["block"] == "c2pa")
        assert r["tool"] == "Signer 1 (Maker 2)" and r["at"] == "2024-01-02T03:04:05Z" and said in r["note"] and "derived from base.png" in r["note"] and r["note"].endswith("signature not verified")
        assert r["fields"]["manifests"] == "2" and r["fields"]["Ingredient[1]:manifest"] == "own manifest" and r["fields"]["actions"] == "c2pa.created"
    assert C.cbor(coded({"a": [1, True, b"x", "é"], "b": 300}))[0] == {"a": [1, True, b"x", "é"], "b": 300} and C.cbor(b"\x9f\x01\x02\xff")[0] == [1, 2] and C.cbor(b"\xfb" + struct.pack(">d", 1.5))[0] == 1.5
    for bad in (b"", b"\x9f\x01", b"\x5a\xff\xff\xff\xff", b"\x81" * 100):
        with pytest.raises((ValueError, IndexError)):
            C.cbor(bad)
    app11 = b"JP" + struct.pack(">HI", 1, 1) + store(digest)
    assert C.store(b"\xff\xd8" + segment(0xEB, app11) + b"\xff\xda\0\2")[1] == "JPEG APP11"


def test_examination_of_pictures(spark):
    from sieveline.sources import images as I

    tables = segment(0xDB, b"\0" + bytes(I.scaled(I.LUMA, 83)) + b"\1" + bytes(I.scaled(I.CHROMA, 83)))
    frame = lambda w, h: segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"\0" * 9)
    small = b"\xff\xd8" + frame(10, 10) + b"\xff\xda\0\2\0\xff\xd9"
    exif = tiff([(0xA431, "SN1234")]) + small
    data = b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + exif) + tables + frame(40, 20) + b"\xff\xda\0\2ab\xff\0c\xff\xd0d\xff\xd9tail"
    got = I.facts(data)
    assert (got["quality"], got["quality.distance"], got["dimensions"], got["frame"], got["restarts"], got["trailing"], got["ended"]) == ("83", "0", "40x20", "baseline", "1", "4", "yes")
    assert got["preview.dimensions"] == "10x10" and "conflict.preview" in got and I.facts(b"no") == {} and "broken" in I.facts(b"\xff\xd8ab")
    for q in range(1, 101):
        assert I.quality({0: I.scaled(I.LUMA, q), 1: I.scaled(I.CHROMA, q)})[1] == 0
    rows = [("/a.jpg", data), ("/b.jpeg", data), ("/c.jpg", b"no"), ("/d.jpg", None), ("/e.png", data)]
    photos = I.examined(spark.createDataFrame(rows, "path string, content binary"))
    assert [tuple(r) for r in I.by_serial(photos).collect()] == [("SN1234", 2)] and tuple(I.summary(photos).first()) == (4, 2, 2, 2, 2, 0)


def test_formats_by_registry(spark):
    from sieveline.sources import formats as S

    xml = b"""<FFSignatureFile xmlns="http://www.nationalarchives.gov.uk/pronom/SignatureFile"><InternalSignatureCollection>
    <InternalSignature ID="1"><ByteSequence Reference="BOFoffset"><SubSequence SubSeqMinOffset="0" SubSeqMaxOffset="4"><Sequence>255044462D</Sequence></SubSequence></ByteSequence></InternalSignature>
    <InternalSignature ID="2"><ByteSequence Reference="BOFoffset"><SubSequence SubSeqMinOffset="0" SubSeqMaxOffset="0"><Sequence>255044462D312E(34|35)</Sequence></SubSequence></ByteSequence><ByteSequence Reference="EOFoffset"><SubSequence SubSeqMinOffset="0" SubSeqMaxOffset="3"><Sequence>2525454F46</Sequence></SubSequence></ByteSequence></InternalSignature>
    </InternalSignatureCollection><FileFormatCollection><FileFormat ID="10" Name="PDF" PUID="fmt/1"><InternalSignatureID>1</InternalSignatureID><Extension>pdf</Extension></FileFormat>
    <FileFormat ID="11" Name="PDF" Version="1.4" PUID="fmt/2" MIMEType="application/pdf"><InternalSignatureID>2</InternalSignatureID><HasPriorityOverFileFormatID>10</HasPriorityOverFileFormatID></FileFormat><FileFormat ID="12" Name="Text" PUID="x/1"><Extension>txt</Extension></FileFormat></FileFormatCollection></FFSignatureFile>"""
    known = S.registry(xml)
    rows = [("/a.pdf", b"%PDF-1.4 x %%EOF\n"), ("/b.pdf", b"\n\n%PDF-1.9"), ("/c.txt", b"hello"), ("/d.bin", b"?"), ("/e.txt", None)]
    got = {(r["path"], r["puid"], r["basis"]) for r in S.formats(spark.createDataFrame(rows, "path string, content binary"), known).collect()}
    assert got == {("/a.pdf", "fmt/2", "signature"), ("/b.pdf", "fmt/1", "signature"), ("/c.txt", "x/1", "extension"), ("/e.txt", "x/1", "extension")}
    import re

    for seq, yes, no in (("41??43", b"AxC", b"AC"), ("41{2-3}42", b"AxxB", b"AxB"), ("41*42", b"A...B", b"B.A"), ("[41:43]5A", b"BZ", b"DZ"), ("[!41]5A", b"BZ", b"AZ"), ("'GIF'(38|39)", b"GIF9", b"GIF7")):
        assert re.search(S.pattern(seq), yes) and not re.search(S.pattern(seq), no), seq


def noted(make, note):
    """A TIFF with a camera and a maker note."""
    name = make.encode() + b"\0"
    at = 8 + 2 + 24 + 4
    sub = at + len(name)
    place = sub + 2 + 12 + 4
    body = note(place)
    return b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 0x10F, 2, len(name), at) + struct.pack("<HHII", 0x8769, 4, 1, sub) + b"\0\0\0\0" + name + struct.pack("<H", 1) + struct.pack("<HHII", 0x927C, 7, len(body), place) + b"\0\0\0\0" + body


def test_maker_notes():
    entry = lambda order, tag, text, at: struct.pack(order + "H", 1) + struct.pack(order + "HHII", tag, 2, len(text), at) + b"\0\0\0\0" + text
    cases = {
        "Canon": (lambda p: entry("<", 9, b"Owner Ann\0", p + 18), "Canon:OwnerName", "Owner Ann"),
        "NIKON": (lambda p: b"Nikon\0\2\0\0\0" + b"MM\0*" + struct.pack(">I", 8) + entry(">", 0x1D, b"SN-12345\0", 26), "Nikon:SerialNumber", "SN-12345"),
        "FUJIFILM": (lambda p: b"FUJIFILM" + struct.pack("<I", 12) + entry("<", 0x10, b"FF-12345\0", 30), "Fujifilm:InternalSerialNumber", "FF-12345"),
        "Apple": (lambda p: b"Apple iOS\0\0\1MM" + entry(">", 0x11, b"UUID-1234\0", 32), "Apple:ContentIdentifier", "UUID-1234"),
        "SONY": (lambda p: b"SONY DSC \0\0\0" + entry("<", 0xB020, b"Vivid...\0", p + 30), "Sony:CreativeStyle", "Vivid..."),
    }
    for make, (note, key, want) in cases.items():
        tiff = noted(make, note)
        r = next(r for r in R.read("jpg", b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + tiff) + b"\xff\xda\0\2") if r["block"] == "maker-notes")
        assert r["fields"][key] == want, (make, r)
        for n in range(0, len(tiff), 7):
            R.read("tif", tiff[:n])


def test_telemetry():
    klv = lambda key, kind, size, body: key + kind + bytes([size]) + struct.pack(">H", len(body) // size) + body + b"\0" * (-len(body) % 4)
    fixes = b"".join(struct.pack(">5i", round(lat * 1e7), round(lon * 1e7), 0, 0, 0) for lat, lon in ((52.2297, 21.0122), (52.23, 21.02)))
    inner = klv(b"STNM", b"c", 1, b"GPS") + klv(b"GPSU", b"U", 16, b"200102030405.000") + klv(b"SCAL", b"l", 4, struct.pack(">5i", 10**7, 10**7, 1, 1, 1)) + klv(b"GPS5", b"l", 20, fixes)
    sample = klv(b"DEVC", b"\0", 1, klv(b"DVNM", b"c", 1, b"Camera 9") + klv(b"STRM", b"\0", 1, inner))
    head = box(b"ftyp", b"isom\0\0\0\0")
    at = len(head) + 8
    table = box(b"stbl", box(b"stsd", b"\0" * 8 + struct.pack(">I4s", 8, b"gpmd")), box(b"stsz", struct.pack(">III", 0, 0, 1) + struct.pack(">I", len(sample))), box(b"stco", struct.pack(">III", 0, 1, at)), box(b"stsc", struct.pack(">IIIII", 0, 1, 1, 1, 1)))
    data = head + box(b"mdat", sample) + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", table))))
    r = next(r for r in R.read("mp4", data) if r["block"] == "gpmf")
    assert r["tool"] == "Camera 9" and r["geo"] == "52.22970,21.01220" and r["at"] == "2020-01-02T03:04:05Z" and r["fields"]["GPMF:GPSPoints"] == "2" and r["fields"]["GPMF:GPSLast"] == "52.23000,21.02000" and r["fields"]["GPMF:Streams"] == "GPS"
    for n in range(0, len(data), 5):
        R.read("mp4", data[:n])
