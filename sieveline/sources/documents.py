"""Texts of documents as passages: bytes of one file in, (place, text) out.

Text by line, tables by cell, pages by element with their links, maps by position, packages by part, PDF by page and
messages by body. Blank passages are left out, and each file gives at most `budget` characters, in order; the passage
that reaches the bound is cut. Without a budget each file gives everything.
"""

from __future__ import annotations

import csv
import email
import email.policy
import functools
import html
import io
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import cfb_streams, inflate, member, package, pdf_text

#: Characters of a file and parts of a package that are read.
BUDGET, PARTS = 1 << 20, 64
# Attributes that hold an address; parts of packages and what they are called.
LINKS = frozenset("href src cite action data longdesc poster".split())
PLACES = (
    (r"word/document\d*\.xml", "body"), (r"word/footnotes\d*\.xml", "footnotes"), (r"word/endnotes\d*\.xml", "endnotes"), (r"word/comments\d*\.xml", "comments"), (r"ppt/slides/slide(\d+)\.xml", "slide {}"), (r"ppt/notesSlides/notesSlide(\d+)\.xml", "slide {} notes"),
    (r"xl/sharedStrings\.xml", "cell text"), (r"xl/worksheets/sheet(\d+)\.xml", "sheet {}"), (r"content\.xml", "body"), (r"styles\.xml", "headers and footers"), (r"[^/]+\.kml", "map"), (r"content\.json", "body"), (r"Graphs/Graph(\d+)\.graphml", "graph {}"), (r"(?:.*/)?([^/]+\.x?html?)", "{}"),
)

Passage = tuple[str, str]


def decoded(raw: bytes) -> str:
    """UTF-8 or UTF-16 by its mark, else UTF-8, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def lines(text: str) -> Iterator[Passage]:
    return ((f"line {n}", line) for n, line in enumerate(text.split("\n"), 1))


def cells(text: str, delimiter: str) -> Iterator[Passage]:
    """One passage for each cell; a quoted cell of several lines is one."""
    csv.field_size_limit(1 << 30)
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    n = 0
    try:
        for row in rows:
            n += 1
            yield from ((f"row {n} · column {k}", cell) for k, cell in enumerate(row, 1))
    except csv.Error:
        return


class _Markup(HTMLParser):
    """Texts outside of scripts and styles, addresses of attributes, and the points of tracks and maps."""

    def __init__(self, labels: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.points: list[tuple[str, int, tuple[str, str]]] = []
        self.silent, self.labels = 0, LINKS | labels
        self.counts = dict.fromkeys(("waypoint", "track", "placemark"), 0)
        self.track: list[tuple[str, str]] | None = None
        self.shape, self.text = "", None

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        self.silent += tag in ("script", "style")
        self.found += [v for k, v in attrs if v and k in self.labels]
        pair = (own.get("lat"), own.get("lon"))
        if tag == "wpt" and all(pair):
            self.counts["waypoint"] += 1
            self.points.append(("waypoint", self.counts["waypoint"], pair))
        elif tag == "trk":
            self.counts["track"] += 1
            self.track = []
        elif tag == "trkpt" and self.track is not None and all(pair):
            self.track.append(pair)
        elif tag == "placemark":
            self.counts["placemark"] += 1
            self.shape = ""
        elif tag in ("point", "linestring"):
            self.shape = tag
        elif tag == "coordinates":
            self.text = ""

    def parse_html_declaration(self, i):
        """A section in brackets is a comment, as browsers read it; the parser's own way fails at unknown ones and loses the page."""
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style") and self.silent > 0
        if tag == "trk":
            self._ends("track", self.track or [])
            self.track = None
        elif tag == "coordinates" and self.text is not None:
            pairs = [(p[1], p[0]) for x in self.text.split() if len(p := x.split(",")) >= 2]
            if self.shape == "point" and pairs:
                self.points.append(("placemark", self.counts["placemark"], pairs[0]))
            elif self.shape == "linestring":
                self._ends("placemark", pairs)
            self.text, self.shape = None, ""

    def _ends(self, kind, pairs):
        n = self.counts[kind]
        self.points += [(f"{kind} {n} start", 0, pairs[0])] if pairs else []
        self.points += [(f"{kind} {n} end", 0, pairs[-1])] if len(pairs) > 1 else []

    def handle_data(self, data):
        if self.text is not None:
            self.text += data
        if not self.silent:
            self.found.append(data)


def _parsed(text: str, labels: frozenset[str] = frozenset()) -> _Markup:
    own = _Markup(labels)
    own.feed(text)
    own.close()
    return own


def markup(text: str) -> Iterator[Passage]:
    return ((f"element {k}", t) for k, t in enumerate(_parsed(text).found, 1))


def closed(text: str) -> str:
    """HTML in which only what has its semicolon is a reference: all other ampersands are written out."""
    return re.sub(r"&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|([A-Za-z][A-Za-z0-9]*;))?", lambda m: m[0] if (m[1] in html.entities.html5 if m[1] else m[0] != "&") else f"&amp;{m[0][1:]}", text)


def stripped(text: str) -> str:
    return " ".join(t for t in _parsed(text).found if t.strip())


def positions(text: str) -> Iterator[Passage]:
    """The named points of a GPX or KML file, and where its tracks begin and end, as geo: addresses."""
    return ((f"{kind} {n}" if n else kind, f"geo:{lat},{lon}") for kind, n, (lat, lon) in _parsed(text).points)


def features(text: str) -> Iterator[Passage]:
    """Points and ends of lines of GeoJSON, which writes the longitude first."""
    try:
        top = json.loads(text)
    except (ValueError, RecursionError):
        return
    many = top.get("features") if isinstance(top, dict) and isinstance(top.get("features"), list) else [top]
    real = lambda p: isinstance(p, list) and len(p) > 1 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in p[:2])
    for n, feature in enumerate(many, 1):
        shape = feature.get("geometry", feature) if isinstance(feature, dict) else None
        if not isinstance(shape, dict):
            continue
        at = shape.get("coordinates")
        if shape.get("type") == "Point" and real(at):
            yield f"feature {n}", f"geo:{at[1]},{at[0]}"
        elif shape.get("type") == "LineString" and isinstance(at, list) and (points := [p for p in at if real(p)]):
            yield f"feature {n} start", f"geo:{points[0][1]},{points[0][0]}"
            if len(points) > 1:
                yield f"feature {n} end", f"geo:{points[-1][1]},{points[-1][0]}"


def parts(data: bytes) -> Iterator[Passage]:
    """The parts of a package that hold what it says, in the order of the package."""
    archive, n = package(data), 0
    for name in archive.namelist() if archive else ():
        place = next((label.format(*m.groups()) for pattern, label in PLACES if (m := re.fullmatch(pattern, name, re.I))), None)
        if place is None or (n := n + 1) > PARTS:
            continue
        text = decoded(member(archive, name))
        yield place, text if name.endswith(".json") else stripped(text)
        if name.lower().endswith(".kml"):
            yield from positions(text)


def message(data: bytes) -> Iterator[Passage]:
    """Decoded bodies of a mail, none of its headers."""
    for part in email.message_from_bytes(data, policy=email.policy.default).walk():
        if part.get_content_maintype() == "text":
            try:
                text = part.get_content()
            except (LookupError, ValueError, UnicodeError):
                continue
            yield ("body (html)", stripped(text)) if part.get_content_subtype() == "html" else ("body", text)


def outlook(data: bytes) -> Iterator[Passage]:
    streams = cfb_streams(data)
    for name, coding in (("__substg1.0_1000001F", "utf-16-le"), ("__substg1.0_1000001E", "utf-8")):
        if name in streams:
            yield "body", streams[name].decode(coding, "replace").rstrip("\0")
            return


# PDF

_OBJECT = re.compile(rb"(?:^|[\r\n\s])(\d+)\s+\d+\s+obj\b(.*?)endobj", re.S)
_SHOW = re.compile(rb"/(\w+)\s+[\d.]+\s+Tf|\(((?:\\.|[^\\)])*+)\)\s*(?:Tj|'|\")|<([0-9A-Fa-f\s]*)>\s*Tj|\[((?:\((?:\\.|[^\\)])*+\)|<[0-9A-Fa-f\s]*>|[^\]()<>])*+)\]\s*TJ|(T\*|\b(?:Td|TD|Tm|ET)\b)", re.S)
_STRINGS = re.compile(rb"\(((?:\\.|[^\\)])*+)\)|<([0-9A-Fa-f\s]*)>|(-?\d+(?:\.\d+)?)", re.S)


def _body(raw: bytes) -> bytes:
    m = re.search(rb"stream\r?\n", raw)
    if not m:
        return b""
    data = raw[m.end() : raw.rfind(b"endstream")]
    return inflate(data, 16 << 20) if b"FlateDecode" in raw[: m.start()] else data


def _cmap(data: bytes) -> dict[int, str]:
    """Codes of a font and the characters they stand for."""
    out: dict[int, str] = {}
    read = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        out |= {int(a, 16): read(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<((?:[0-9A-Fa-f]{2})+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<((?:[0-9A-Fa-f]{2})+)>", block):
            first, start = int(a, 16), read(c)
            out |= {first + k: start[:-1] + chr(ord(start[-1]) + k) for k in range(min(int(b, 16) - first + 1, 65536)) if start and ord(start[-1]) + k < 0x110000}
    return out


def _shown(content: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    out, font = [], {}

    def said(literal: bytes | None, hexed: bytes | None) -> str:
        raw = bytes.fromhex((h := re.sub(rb"\s", b"", hexed).decode()) + "0" * (len(h) % 2)) if hexed is not None else None
        if font and raw is not None:
            wide = 2 if max(font) > 255 or len(raw) % 2 == 0 and not any(b in font for b in raw) else 1
            return "".join(font.get(int.from_bytes(raw[i : i + wide], "big"), "") for i in range(0, len(raw), wide))
        text = pdf_text(literal) if raw is None else raw.decode("latin-1")
        return "".join(font.get(ord(c), c) for c in text) if font else text

    for name, literal, hexed, array, move in ((m[1], m[2], m[3], m[4], m[5]) for m in _SHOW.finditer(content)):
        if name:
            font = fonts.get(name, {})
        elif move:
            out.append("\n" if move in (b"T*", b"ET") else " ")
        elif array is not None:
            for a, b, shift in ((s[1], s[2], s[3]) for s in _STRINGS.finditer(array)):
                out.append((" " if float(shift) < -200 else "") if shift else said(a, b))
        else:
            out.append(said(literal, hexed))
    return re.sub(r"[ \t]+", " ", "".join(out)).strip()


def pdf_pages(data: bytes) -> Iterator[Passage]:
    """Texts of the pages in the order of the page tree, by content streams and the fonts' own maps."""
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for raw in list(objects.values()):  # objects that are packed in streams
        if re.search(rb"/Type\s*/ObjStm", raw):
            body, first = _body(raw), int((re.search(rb"/First\s+(\d+)", raw) or [0, 0])[1])
            heads = list(map(int, re.findall(rb"\d+", body[:first])))
            for number, at, end in zip(heads[::2], heads[1::2], [*heads[3::2], len(body) - first]):
                objects.setdefault(number, body[first + at : first + end])
    ref = lambda raw, key: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if (m := re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", raw)) else []
    catalog = next((raw for raw in objects.values() if re.search(rb"/Type\s*/Catalog\b", raw)), b"")
    todo, pages, seen = ref(catalog, b"Pages"), [], set()
    while todo:
        n = todo.pop(0)
        if n in seen or n not in objects:
            continue
        seen.add(n)
        if re.search(rb"/Type\s*/Pages\b", objects[n]):
            todo = ref(objects[n], b"Kids") + todo
        else:
            pages.append(n)
    for k, n in enumerate(pages or [n for n, raw in objects.items() if re.search(rb"/Type\s*/Page\b", raw)], 1):
        raw = objects[n]
        own = b"".join(objects.get(i, b"") for i in ref(raw, b"Resources")) + raw
        font_at = b"".join(objects.get(i, b"") for i in ref(own, b"Font")) + own
        fonts = {name: _cmap(_body(objects.get((ref(objects.get(int(i), b""), b"ToUnicode") or [-1])[0], b""))) for name, i in re.findall(rb"/(\w+)\s+(\d+)\s+0\s+R", font_at) if int(i) in objects and b"/Font" in objects[int(i)]}
        yield f"page {k}", _shown(b"\n".join(_body(objects.get(i, b"")) for i in ref(raw, b"Contents")), fonts)


def pdf_attachments(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the files that a PDF carries."""
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for raw in objects.values():
        at = re.search(rb"/EF\s*<<[^>]*?/U?F\s+(\d+)\s+\d+\s+R", raw)
        if at and (body := objects.get(int(at[1]))) is not None:
            name = re.search(rb"/UF\s*\(((?:\\.|[^\\)])*+)\)", raw) or re.search(rb"/F\s*\(((?:\\.|[^\\)])*+)\)", raw)
            yield (pdf_text(name[1]) if name else "attachment"), _body(body)


# Suffixes of texts by the way they are read.
TEXT = frozenset("txt md log json yaml yml ini cfg conf toml sql py js ts sh xml rst tex srt vtt ics vcf".split())
READERS = {
    **{s: lambda b: lines(decoded(b)) for s in TEXT}, "csv": lambda b: cells(decoded(b), ","), "tsv": lambda b: cells(decoded(b), "\t"), **{s: lambda b: markup(decoded(b)) for s in ("html", "htm", "xhtml", "svg")},
    **{s: lambda b: [*markup(decoded(b)), *positions(decoded(b))] for s in ("gpx", "kml")}, "geojson": lambda b: [*lines(decoded(b)), *features(decoded(b))],
    **{s: parts for s in "docx docm pptx pptm xlsx xlsm odt ods odp epub kmz xmind mtgx".split()}, "pdf": pdf_pages, "eml": message, "msg": outlook,
}


def read(suffix: str, data: bytes, budget: int | None = BUDGET, cut: bool = False) -> list[Passage]:
    """Passages of one file within its budget; a broken file gives those before the break. cut: the file is HTML whose texts may end inside of a reference, so one without its semicolon is none."""
    out, left = [], budget
    try:
        for place, text in READERS.get(suffix.lower().lstrip("."), lambda _: ())(closed(decoded(data)).encode() if cut else data):
            if text and text.strip() and (left is None or left > 0):
                out.append((place, text[:left]))
                left = None if left is None else left - len(text)
    except (ValueError, LookupError, AssertionError, RecursionError, OverflowError):
        pass
    return out


def _read(budget: int | None, cut: bool, batches):
    for b in batches:
        for path, data in zip(b.column("path").to_pylist(), b.column("content")):  # a file at a time
            found = read(path.rpartition(".")[2], data.as_py() or b"", budget, cut)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(range(len(found)), pa.int32()), *(pa.array(list(c), pa.string()) for c in zip(*found))], ["path", "seq", "place", "text"])


def passages(files: DataFrame, budget: int | None = BUDGET, cut: bool = False) -> DataFrame:
    """path, seq, place and text of every file (path, content) of a known suffix. cut: as read() says, where all files are HTML."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.where(suffix.isin(*READERS)).select("path", "content").mapInArrow(functools.partial(_read, budget, cut), "path string, seq int, place string, text string")
