"""Readers of what files say of themselves: bytes of one file in, records out.

A record is a block (the standard that it is written in) with its source, tool, at, geo, location, note and fields. All
readers share one way to walk: bytes cut into named pieces by a function for each family (RIFF and IFF chunks, PNG chunks, JPEG
segments, ISO boxes, EBML elements, TIFF directories). What is broken ends the walk; what was read before it stays.
`records` runs them over a table of files in Arrow batches; a file is chosen by its suffix, so others are never decoded.
"""

from __future__ import annotations

import datetime
import functools
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of one value, and of one inflated stream, that are read.
VALUE, INFLATED = 4096, 4 << 20
UTC = datetime.timezone.utc

Record = dict


def record(block: str, fields: dict[str, str], source: str = "document-metadata", **more: str | None) -> list[Record]:
    """One record, none if it says nothing."""
    own = {k: v for k, v in fields.items() if v not in (None, "")}
    return [{"source": source, "block": block, "fields": own} | {k: v for k, v in more.items() if v}] if own or any(more.values()) else []


def iso(year, month=1, day=1, hour=0, minute=0, second=0, offset: int = 0) -> str | None:
    """A moment in UTC, null for one that no calendar has."""
    try:
        at = datetime.datetime(int(year), int(month), int(day), int(hour), int(minute), int(second), tzinfo=UTC) - datetime.timedelta(minutes=offset)
    except (ValueError, OverflowError):
        return None
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


_STAMP = re.compile(r"\s*(?:D:)?(\d{4})\D?(\d{2})?\D?(\d{2})?(?:\D?(\d{2})\D?(\d{2})\D?(\d{2})?)?(?:\.\d+)?\s*(?:(Z)|([+-])(\d{2})'?:?(\d{2})?)?")


def moment(text: str | None) -> str | None:
    """ISO, EXIF, PDF and IPTC spellings as UTC; a missing zone counts as UTC."""
    m = _STAMP.match(text or "")
    if not m:
        return None
    offset = (int(m[9]) * 60 + int(m[10] or 0)) * (-1 if m[8] == "-" else 1) if m[8] else 0
    return iso(m[1], m[2] or 1, m[3] or 1, m[4] or 0, m[5] or 0, m[6] or 0, offset)


def since(seconds: float, year: int) -> str | None:
    """Seconds since the first day of a year."""
    try:
        return (datetime.datetime(year, 1, 1, tzinfo=UTC) + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ") if seconds else None
    except OverflowError:
        return None


def clean(raw: bytes, encoding: str = "utf-8") -> str:
    try:
        text = raw[:VALUE].decode(encoding)
    except (UnicodeDecodeError, LookupError):
        text = raw[:VALUE].decode("latin-1")
    return " ".join(text.replace("\0", " ").split())


def inflate(data: bytes, most: int = INFLATED) -> bytes:
    """What a zlib stream holds, up to a bound; a broken one gives what came before the break."""
    try:
        return zlib.decompressobj().decompress(data, most)
    except zlib.error:
        return b""


# pieces


def chunks(data: bytes, at: int, end: int, order: str) -> Iterator[tuple[bytes, bytes]]:
    """(name, body) of chunks of four letters, a length and a body that is padded to even: RIFF (<) and IFF (>)."""
    end = min(end, len(data))
    while at + 8 <= end:
        name, size = struct.unpack_from(order + "4sI", data, at)
        yield name, data[at + 8 : min(at + 8 + size, end)]
        at += 8 + size + size % 2


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, bytes]]:
    """(type, body) of ISO media boxes."""
    end = len(data) if end is None else min(end, len(data))
    while at + 8 <= end:
        size, name = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = end - at if size == 0 else size
        if size < head:
            return
        yield name, data[at + head : min(at + size, end)]
        at += size


def find_box(data: bytes, *path: bytes) -> bytes | None:
    for name in path:
        data = next((body for kind, body in boxes(data) if kind == name), None)
        if data is None:
            return None
    return data


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, body) of a JPEG's segments up to its image data."""
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xDA or size < 2:
            return
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8 if data[:8] == b"\x89PNG\r\n\x1a\n" else len(data)
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        if name in (b"IDAT", b"IEND"):
            return
        yield name, data[at + 8 : at + 8 + size]
        at += 12 + size


def package(data: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, NotImplementedError, ValueError, OSError, struct.error):
        return None


def member(archive: zipfile.ZipFile | None, name: str, most: int = 8 * INFLATED) -> bytes:
    """Bytes of a member, nothing if it isn't there or is larger than a bound."""
    try:
        if archive is None or archive.getinfo(name).file_size > most:
            return b""
        return archive.read(name)
    except (KeyError, RuntimeError, NotImplementedError, zipfile.BadZipFile, zlib.error, OSError):
        return b""


def tree(xml: bytes | str) -> ElementTree.Element | None:
    """Parsed XML; none for broken one, and for one that declares entities."""
    raw = xml if isinstance(xml, bytes) else xml.encode()
    if not raw or b"<!ENTITY" in raw:
        return None
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return None


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def texts(root: ElementTree.Element | None) -> dict[str, str]:
    """Texts of the children by local name, the first of each."""
    out: dict[str, str] = {}
    for child in root if root is not None else ():
        if (child.text or "").strip():
            out.setdefault(local(child.tag), child.text.strip())
    return out


# audio

# Frames of ID3, text chunks of IFF and fields of RIFF by the names they are shown under.
ID3 = {"TSSE": "encoder", "TENC": "encoder", "TSSA": "encoder", "TDRC": "date", "TYER": "date", "TDAT": "date", "TPE1": "artist", "TIT2": "title", "TSS": "encoder", "TEN": "encoder", "TYE": "date", "TP1": "artist", "TT2": "title"}
IFF_TEXT = {b"NAME": "Name", b"AUTH": "Author", b"(c) ": "Copyright", b"ANNO": "Annotation"}
RIFF_INFO = {
    "IARL": "ArchivalLocation", "IART": "Artist", "ICMS": "Commissioned", "ICMT": "Comment", "ICOP": "Copyright", "ICRD": "DateCreated", "ICRP": "Cropped", "IDIM": "Dimensions", "IDPI": "DotsPerInch", "IENG": "Engineer",
    "IGNR": "Genre", "IKEY": "Keywords", "ILGT": "Lightness", "IMED": "Medium", "INAM": "Title", "IPLT": "PaletteSetting", "IPRD": "Product", "ISBJ": "Subject", "ISFT": "Software", "ISHP": "Sharpness", "ISRC": "Source",
    "ISRF": "SourceForm", "ITCH": "Technician", "ICNM": "Cinematographer", "IENC": "EncodedBy", "ILNG": "Language",
}
BEXT = (("Description", 0, 256), ("Originator", 256, 288), ("OriginatorReference", 288, 320), ("OriginationDate", 320, 330), ("OriginationTime", 330, 338))


def _sevens(raw: bytes) -> int:
    return functools.reduce(lambda n, b: n << 7 | b & 0x7F, raw, 0)


def id3_frames(data: bytes) -> dict[str, str]:
    """Meaning and text of the frames of an ID3v2 tag at the beginning."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}
    version, body, at, out = data[3], data[10 : 10 + _sevens(data[6:10])], 0, {}
    name_size, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at]:
        name = body[at : at + name_size].decode("latin-1")
        raw = body[at + name_size : at + name_size + (3 if version == 2 else 4)]
        size = _sevens(raw) if version == 4 else int.from_bytes(raw, "big")
        text = body[at + head : at + head + size]
        if name in ID3 and text:
            value = text[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(text[0], "latin-1"), "replace").strip("\0 ")
            if value:
                out.setdefault(ID3[name], value)
        at += head + max(size, 1)
    return out


def id3(data: bytes) -> list[Record]:
    f = id3_frames(data)
    return record("id3", f, tool=f.get("encoder"), at=moment(f.get("date"))) if f else []


def ape(data: bytes) -> list[Record]:
    """Text items of an APEv2 tag at the end, before an old ID3 tag if there is one."""
    at = next((len(data) - n for n in (32, 160) if data[max(0, len(data) - n) :][:8] == b"APETAGEX"), None)
    if at is None:
        return []
    _, size, count, _ = struct.unpack_from("<IIII", data, at + 8)
    body, pos, out = data[max(0, at + 32 - size) : at], 0, {}
    for _ in range(count):
        if pos + 8 > len(body):
            break
        n, flags = struct.unpack_from("<II", body, pos)
        stop = body.find(b"\0", pos + 8)
        if stop < 0:
            break
        if not flags & 6:
            out.setdefault(body[pos + 8 : stop].decode("latin-1"), " ".join(body[stop + 1 : stop + 1 + n].decode("utf-8", "replace").replace("\0", " / ").split()))
        pos = stop + 1 + n
    low = {k.lower(): v for k, v in out.items()}
    return record("ape-tag", out, tool=low.get("encoder") or low.get("tool name"), at=moment(low.get("year"))) if out else []


def _extended(raw: bytes) -> float:
    """An 80-bit floating point number."""
    top, mantissa = struct.unpack(">HQ", raw)
    return 0.0 if not mantissa or top & 0x7FFF > 0x4400 else mantissa * 2.0 ** ((top & 0x7FFF) - 16446) * (-1 if top >> 15 else 1)


def aiff(data: bytes) -> list[Record]:
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        return []
    out, notes = {}, 0
    for name, body in chunks(data, 12, len(data), ">"):
        if name in IFF_TEXT:
            notes += name == b"ANNO"
            out.setdefault(IFF_TEXT[name] + (f"[{notes}]" if name == b"ANNO" and notes > 1 else ""), clean(body, "utf-8"))
        elif name == b"ID3 ":
            out |= {f"id3:{k}": v for k, v in id3_frames(body).items()}
        elif name == b"COMM" and len(body) >= 18:
            channels, frames, bits = struct.unpack_from(">hIh", body)
            rate = _extended(body[8:18])
            out |= {"Channels": str(channels), "SampleSize": f"{bits} bit", "SampleRate": f"{rate:g} Hz" if rate else "", "Duration": f"{frames / rate:.1f} s" if rate and frames else ""}
    return record("aiff", out, tool=out.get("id3:encoder"), at=moment(out.get("id3:date")))


def riff(data: bytes) -> list[Record]:
    """INFO, broadcast extension and ID3 of a RIFF file; sample data is never looked into."""
    if data[:4] != b"RIFF":
        return []
    out, todo = {}, [data[12 : 8 + int.from_bytes(data[4:8], "little")]]
    while todo:
        part = todo.pop()
        for name, body in chunks(part, 0, len(part), "<"):
            if name == b"LIST" and body[:4] == b"INFO":
                for key, value in chunks(body, 4, len(body), "<"):
                    code = key.decode("latin-1")
                    out.setdefault(RIFF_INFO.get(code, code.strip()), clean(value))
            elif name == b"LIST" and body[:4] not in (b"movi", b"rec ", b"wavl"):
                todo.append(body[4:])
            elif name == b"bext" and len(body) >= 602:
                out |= {f"bext:{k}": clean(body[a:b]) for k, a, b in BEXT}
                reference, version = struct.unpack_from("<QH", body, 338)
                out |= {"bext:TimeReference": str(reference or ""), "bext:Version": str(version), "bext:UMID": body[348:412].hex() if any(body[348:412]) else ""}
            elif name.lower() == b"id3 ":
                out |= {f"id3:{k}": v for k, v in id3_frames(body).items()}
    began = moment(f"{out.get('bext:OriginationDate', '')}T{out.get('bext:OriginationTime', '')}")
    recorder, editor = out.get("bext:Originator"), out.get("Software") or out.get("id3:encoder")
    tool = f"{recorder} (edited with {editor})" if recorder and editor and editor.lower() not in recorder.lower() else recorder or editor
    return record("riff", out, tool=tool, at=began or moment(out.get("DateCreated") or out.get("id3:date")))


def _comments(data: bytes) -> dict[str, str]:
    """Vendor and comments in the way of Vorbis; a name that repeats keeps all values."""
    n = int.from_bytes(data[:4], "little")
    out, at = {"Vendor": clean(data[4 : 4 + n])}, 8 + n
    for _ in range(int.from_bytes(data[4 + n : 8 + n], "little")):
        if at + 4 > len(data):
            break
        n = int.from_bytes(data[at : at + 4], "little")
        name, eq, value = data[at + 4 : at + 4 + n].partition(b"=")
        if eq and value:
            key = name.decode("ascii", "replace")
            out[key] = f"{out[key]}, {clean(value)}" if key in out else clean(value)
        at += 4 + n
    return out


def vorbis(data: bytes) -> list[Record]:
    """Comments of FLAC, and of the second packet of an Ogg stream."""
    block = b""
    if data[:4] == b"fLaC":
        at = 4
        while at + 4 <= len(data):
            kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
            if kind & 0x7F == 4:
                block = data[at + 4 : at + 4 + size]
                break
            if kind & 0x80:
                break
            at += 4 + size
    elif data[:4] == b"OggS":
        packets, part, at = [], b"", 0
        while data[at : at + 4] == b"OggS" and len(packets) < 2:
            count = data[at + 26] if at + 26 < len(data) else 0
            table, at = data[at + 27 : at + 27 + count], at + 27 + count
            for n in table:
                part, at = part + data[at : at + n], at + n
                if n < 255:
                    packets.append(part)
                    part = b""
        second = packets[1] if len(packets) > 1 else b""
        block = second[7:] if second[:7] == b"\x03vorbis" else second[8:] if second[:8] == b"OpusTags" else b""
    f = _comments(block) if len(block) > 8 else {}
    low = {k.upper(): v for k, v in f.items()}
    return record("vorbis-comment", f, tool=low.get("ENCODER") or low.get("VENDOR"), at=moment(low.get("DATE"))) if f else []


# Elements of Matroska by number: containers to go into, and texts by the name they are shown under.
EBML_INTO, EBML_TEXT = {0x18538067, 0x1549A966}, {0x7BA9: "Title", 0x4D80: "MuxingApp", 0x5741: "WritingApp", 0x7384: "SegmentFilename"}


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    n = 9 - data[at].bit_length()
    value = int.from_bytes(data[at : at + n], "big")
    return (value if keep else value & (1 << 7 * n) - 1), at + n


def matroska(data: bytes) -> list[Record]:
    if data[:4] != b"\x1a\x45\xdf\xa3":
        return []
    out, when, todo = {}, None, [(0, len(data))]
    while todo:
        at, end = todo.pop()
        while at + 2 <= end and data[at]:
            key, at = _vint(data, at, True)
            if at >= end or not data[at]:
                break
            size, body = _vint(data, at, False)
            size = min(size, end - body)
            if key in EBML_INTO:
                todo.append((body, body + size))
            elif key in EBML_TEXT:
                out.setdefault(EBML_TEXT[key], clean(data[body : body + size]))
            elif key == 0x4461 and size == 8:
                when = since(int.from_bytes(data[body : body + 8], "big", signed=True) / 1e9, 2001)
            at = body + size
    writing, muxing = out.get("WritingApp"), out.get("MuxingApp")
    tool = f"{writing} (muxed with {muxing})" if writing and muxing and writing.lower() != muxing.lower() else writing or muxing
    return record("matroska", out, tool=tool, at=when)


# images

# Tags of TIFF and of its GPS directory; types and sizes of values.
TAGS = {
    0x0100: "ImageWidth", 0x0101: "ImageLength", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x829A: "ExposureTime",
    0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9204: "ExposureBiasValue", 0x9205: "MaxApertureValue", 0x920A: "FocalLength", 0x9286: "UserComment", 0x9290: "SubSecTime",
    0x9291: "SubSecTimeOriginal", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber", 0xA432: "LensSpecification",
    0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber",
}
GPS_TAGS = {
    0x00: "GPSVersionID", 0x01: "GPSLatitudeRef", 0x02: "GPSLatitude", 0x03: "GPSLongitudeRef", 0x04: "GPSLongitude", 0x05: "GPSAltitudeRef", 0x06: "GPSAltitude", 0x07: "GPSTimeStamp", 0x08: "GPSSatellites", 0x09: "GPSStatus",
    0x0A: "GPSMeasureMode", 0x0B: "GPSDOP", 0x10: "GPSImgDirectionRef", 0x11: "GPSImgDirection", 0x12: "GPSMapDatum", 0x1D: "GPSDateStamp",
}
TIFF_TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_POINTERS = {0x8769: TAGS, 0x8825: GPS_TAGS}


def tiff_tags(data: bytes) -> dict[str, object]:
    """Values by name of a TIFF's first directory and of those it points to for camera and position."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return {}
    out: dict[str, object] = {}
    todo, seen = [(struct.unpack_from(order + "I", data, 4)[0], TAGS)], set()
    while todo:
        at, names = todo.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        for k in range(struct.unpack_from(order + "H", data, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(data):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            size = count * (8 if kind in (5, 10) else struct.calcsize(TIFF_TYPES.get(kind, "B")))
            place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            if tag in _POINTERS:
                todo.append((struct.unpack_from(order + "I", data, entry + 8)[0], _POINTERS[tag]))
                continue
            if size > VALUE or place + size > len(data) or tag == 0x927C:
                continue
            raw = data[place : place + size]
            if kind in (2, 7):
                value = clean(raw[8:] if tag == 0x9286 else raw)
            elif kind in (5, 10):
                pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
                value = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2])]
            elif kind in TIFF_TYPES:
                value = list(struct.unpack(order + TIFF_TYPES[kind] * count, raw))
            else:
                continue
            out.setdefault(names.get(tag, f"0x{tag:04x}"), value[0] if isinstance(value, list) and len(value) == 1 else value)
    return out


def shown(value: object) -> str:
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".")
    return ", ".join(map(shown, value)) if isinstance(value, list) else str(value)


def position(tags: dict[str, object]) -> str | None:
    """Latitude and longitude of GPS tags with five places."""
    out = []
    for name, ref, most, negative in (("GPSLatitude", "GPSLatitudeRef", 90, "S"), ("GPSLongitude", "GPSLongitudeRef", 180, "W")):
        part = tags.get(name)
        if not isinstance(part, list) or len(part) != 3 or str(tags.get(ref, "")).upper() not in ("N", "S", "E", "W"):
            return None
        degrees = part[0] + part[1] / 60 + part[2] / 3600
        if degrees > most:
            return None
        out.append(-degrees if str(tags[ref]).upper() == negative else degrees)
    return None if not any(out) else "{:.5f},{:.5f}".format(*out)


def camera(tags: dict[str, object]) -> str | None:
    make, model = (str(tags.get(k, "")).strip() for k in ("Make", "Model"))
    return (model if not make or model.lower().startswith(make.lower()) else f"{make} {model}") if model else make or None


def exif_payload(data: bytes) -> bytes:
    """The TIFF part of a JPEG, PNG, WebP, HEIF or TIFF file."""
    if data[:2] == b"\xff\xd8":
        return next((body[6:] for marker, body in segments(data) if marker == 0xE1 and body[:6] == b"Exif\0\0"), b"")
    if data[:4] == b"\x89PNG":
        return next((body for name, body in png_chunks(data) if name == b"eXIf"), b"")
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        body = next((body for name, body in chunks(data, 12, len(data), "<") if name == b"EXIF"), b"")
        return body[6:] if body[:6] == b"Exif\0\0" else body
    if data[4:8] == b"ftyp":
        at = data.find(b"Exif\0\0")
        return data[at + 6 :] if at >= 0 else b""
    return data if data[:4] in (b"II*\0", b"MM\0*") else b""


# Units of a JFIF header and fields of an ICC header.
JFIF_UNITS = {0: "none", 1: "dots per inch", 2: "dots per cm"}


def jpeg_fields(data: bytes) -> dict[str, str]:
    """JFIF, JFXX and ICC of a JPEG."""
    out, profile = {}, []
    for marker, body in segments(data):
        if marker == 0xE0 and body[:5] == b"JFIF\0" and len(body) >= 14:
            out |= {"JFIF:Version": f"{body[5]}.{body[6]:02d}", "JFIF:Density": f"{int.from_bytes(body[8:10], 'big')}x{int.from_bytes(body[10:12], 'big')} {JFIF_UNITS.get(body[7], body[7])}"}
            if body[12] and body[13]:
                out["JFIF:Thumbnail"] = f"{body[12]}x{body[13]} RGB"
        elif marker == 0xE0 and body[:5] == b"JFXX\0":
            out["JFXX:Thumbnail"] = "present"
        elif marker == 0xE2 and body[:12] == b"ICC_PROFILE\0":
            profile.append((body[12], body[14:]))
        elif marker == 0xFE:
            out.setdefault("Comment", clean(body))
    icc = b"".join(part for _, part in sorted(profile))
    if len(icc) >= 132 and icc[36:40] == b"acsp":
        out |= {f"ICC:{name}": clean(icc[a : a + 4]) for name, a in (("CMM", 4), ("DeviceClass", 12), ("ColorSpace", 16), ("Platform", 40), ("Manufacturer", 48), ("Model", 52), ("Creator", 80))}
        out["ICC:Created"] = iso(*struct.unpack_from(">6H", icc, 24)) or ""
        for k in range(min(int.from_bytes(icc[128:132], "big"), 64)):
            name, at, size = struct.unpack_from(">4sII", icc, 132 + 12 * k) if 144 + 12 * k <= len(icc) else (b"", 0, 0)
            if name == b"desc" and icc[at : at + 4] == b"desc":
                out["ICC:Description"] = clean(icc[at + 12 : at + 12 + int.from_bytes(icc[at + 8 : at + 12], "big")])
            elif name == b"desc" and icc[at : at + 4] == b"mluc" and at + 28 <= len(icc):
                n, start = struct.unpack_from(">II", icc, at + 20)
                out["ICC:Description"] = clean(icc[at + start : at + start + n], "utf-16-be")
    return out


def exif(data: bytes) -> list[Record]:
    tags = tiff_tags(exif_payload(data))
    fields = {k: shown(v) for k, v in tags.items()} | jpeg_fields(data)
    device, software = camera(tags), str(tags.get("Software") or "") or None
    tool = f"{device} (processed with {software})" if device and software and software.lower() not in device.lower() else device or software
    source = "device-metadata" if device else "document-metadata"
    return record("exif", fields, source, tool=tool, at=moment(str(tags.get("DateTimeOriginal") or tags.get("DateTime") or "")), geo=position(tags)) if fields else []


def resources(data: bytes) -> Iterator[tuple[int, str, bytes]]:
    """(number, name, payload) of image resource blocks."""
    at = 0
    while data[at : at + 4] == b"8BIM" and at + 12 <= len(data):
        number, n = int.from_bytes(data[at + 4 : at + 6], "big"), data[at + 6]
        start = at + 6 + (n + 1 + (n + 1) % 2)
        size = int.from_bytes(data[start : start + 4], "big")
        yield number, data[at + 7 : at + 7 + n].decode("latin-1"), data[start + 4 : start + 4 + size]
        at = start + 4 + size + size % 2


def irb_payload(data: bytes) -> bytes:
    if data[:2] == b"\xff\xd8":
        return b"".join(body[14:] for marker, body in segments(data) if marker == 0xED and body[:14] == b"Photoshop 3.0\0")
    if data[:4] == b"8BPS" and len(data) > 34:
        at = 30 + int.from_bytes(data[26:30], "big")
        return data[at + 4 : at + 4 + int.from_bytes(data[at : at + 4], "big")]
    return b""


def photoshop(data: bytes) -> list[Record]:
    out, paths, tool = {}, 0, None
    for number, name, body in resources(irb_payload(data)):
        if number == 0x040A and body:
            out["Photoshop:CopyrightFlag"] = "copyrighted" if body[0] else "not marked"
        elif number == 0x040B:
            out["Photoshop:URL[1]"] = clean(body)
        elif number == 0x0425:
            out["Photoshop:CaptionDigest"] = body.hex()
        elif number == 0x0421 and len(body) > 9:
            n = int.from_bytes(body[5:9], "big")
            tool = body[9 : 9 + 2 * n].decode("utf-16-be", "replace").strip("\0")
            out["Photoshop:Writer"] = tool
        elif 0x07D0 <= number <= 0x0BB6 and name:
            paths += 1
            out[f"Photoshop:Path[{paths}]:Name"] = name
    return record("photoshop-irb", out, tool=tool) if out else []


# Datasets of IIM's application record.
IIM = {
    0: "RecordVersion", 5: "ObjectName", 7: "EditStatus", 10: "Urgency", 15: "Category", 20: "SupplementalCategory", 22: "FixtureIdentifier", 25: "Keywords", 26: "ContentLocationCode", 27: "ContentLocationName", 30: "ReleaseDate",
    35: "ReleaseTime", 40: "SpecialInstructions", 45: "ReferenceService", 47: "ReferenceDate", 50: "ReferenceNumber", 55: "DateCreated", 60: "TimeCreated", 62: "DigitalCreationDate", 63: "DigitalCreationTime", 65: "OriginatingProgram",
    70: "ProgramVersion", 75: "ObjectCycle", 80: "By-line", 85: "By-lineTitle", 90: "City", 92: "Sub-location", 95: "Province-State", 100: "Country-PrimaryLocationCode", 101: "Country-PrimaryLocationName",
    103: "OriginalTransmissionReference", 105: "Headline", 110: "Credit", 115: "Source", 116: "CopyrightNotice", 118: "Contact", 120: "Caption-Abstract", 122: "Writer-Editor", 131: "ImageOrientation", 135: "LanguageIdentifier",
}


def iptc(data: bytes) -> list[Record]:
    block = next((body for number, _, body in resources(irb_payload(data)) if number == 0x0404), b"")
    entries, at = [], 0
    while at + 5 <= len(block) and block[at] == 0x1C:
        kind, number, size = block[at + 1], block[at + 2], int.from_bytes(block[at + 3 : at + 5], "big")
        at += 5
        if size & 0x8000:  # the length of the length
            n = size & 0x7FFF
            size, at = int.from_bytes(block[at : at + n], "big"), at + n
        if size > len(block) - at:
            break
        entries.append((kind, number, block[at : at + size]))
        at += size
    coded = "utf-8" if any((k, n) == (1, 90) and b"\x1b%G" in v for k, n, v in entries) else "latin-1"
    out: dict[str, str] = {}
    for kind, number, value in entries:
        if kind == 2 and value:
            name = IIM.get(number, f"2:{number}")
            text = str(int.from_bytes(value[:2], "big")) if number == 0 else value.decode(coded, "replace").strip("\0 ")
            out[name] = f"{out[name]}, {text}" if name in out else text
    day, clock = out.get("DateCreated", ""), out.get("TimeCreated", "")
    at_ = moment(f"{day[:4]}-{day[4:6]}-{day[6:8]}T{clock}" if re.match(r"\d{6}", clock) else day) if re.match(r"\d{8}", day) else None
    place = ", ".join(out[k] for k in ("Sub-location", "City", "Province-State", "Country-PrimaryLocationName") if out.get(k))
    tool = " ".join(out[k] for k in ("OriginatingProgram", "ProgramVersion") if out.get(k))
    return record("iptc", out, "iptc", tool=tool, at=at_, location=place) if out else []


# Keys of PNG texts by what they say.
PNG_TOOL, PNG_DATE, PNG_AUTHOR = ("Software", "Source", "Creator", "generator"), ("Creation Time", "create-date", "date:create"), ("Author", "Artist", "Copyright")
XMP_KEY = "XML:com.adobe.xmp"


def png_texts(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, body in png_chunks(data):
        key, zero, rest = body.partition(b"\0")
        if not zero or name not in (b"tEXt", b"zTXt", b"iTXt"):
            continue
        if name == b"zTXt":
            text = inflate(rest[1:]).decode("latin-1")
        elif name == b"iTXt":
            packed, body = rest[:1] != b"\0", rest[2:].split(b"\0", 2)[-1]
            text = (inflate(body) if packed else body).decode("utf-8", "replace")
        else:
            text = rest.decode("latin-1")
        out.setdefault(key.decode("latin-1").strip(), text.strip())
    return out


def png(data: bytes) -> list[Record]:
    said = png_texts(data)
    tags = tiff_tags(exif_payload(data)) if data[:4] == b"\x89PNG" else {}
    first = lambda keys: next((said[k] for k in keys if said.get(k)), None)
    fields = {k: v[:VALUE] for k, v in said.items() if k != XMP_KEY} | {k: shown(v) for k, v in tags.items()}
    return record("png-text", fields, tool=first(PNG_TOOL) or camera(tags), at=moment(first(PNG_DATE)) or moment(str(tags.get("DateTimeOriginal") or tags.get("DateTime") or "")), note=first(PNG_AUTHOR) and f"author {first(PNG_AUTHOR)}") if fields else []


# Namespaces of XMP by prefix.
XMP_PREFIX = {
    "http://purl.org/dc/elements/1.1/": "dc", "http://ns.adobe.com/xap/1.0/": "xmp", "http://ns.adobe.com/xap/1.0/mm/": "xmpMM", "http://ns.adobe.com/xap/1.0/sType/ResourceEvent#": "stEvt", "http://ns.adobe.com/xap/1.0/sType/ResourceRef#": "stRef",
    "http://ns.adobe.com/xap/1.0/rights/": "xmpRights", "http://ns.adobe.com/photoshop/1.0/": "photoshop", "http://ns.adobe.com/tiff/1.0/": "tiff", "http://ns.adobe.com/exif/1.0/": "exif", "http://ns.adobe.com/exif/1.0/aux/": "aux",
    "http://ns.adobe.com/pdf/1.3/": "pdf", "http://ns.adobe.com/camera-raw-settings/1.0/": "crs", "http://iptc.org/std/Iptc4xmpCore/1.0/xmlns/": "Iptc4xmpCore", "http://iptc.org/std/Iptc4xmpExt/2008-02-29/": "Iptc4xmpExt",
}
_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
_LISTS = {f"{_RDF}{x}" for x in ("Seq", "Bag", "Alt")}
#: Steps of a history and entries of a list that are shown one by one.
STEPS, ENTRIES = 25, 3


def _prefixed(tag: str) -> str:
    space, _, name = tag.removeprefix("{").rpartition("}")
    return f"{XMP_PREFIX.get(space, space.rstrip('/#').rpartition('/')[2])}:{name}" if space else name


def _flat(element: ElementTree.Element, deep: int = 0) -> dict[str, str]:
    """Attributes and children of a description by their paths; lists of texts joined, structures a level down."""
    out = {_prefixed(k): v.strip() for k, v in element.attrib.items() if not k.startswith((_RDF, "{http://www.w3.org/XML")) and v.strip()}
    for child in element:
        name = _prefixed(child.tag)
        if name == "xmpMM:History" and not deep:
            continue
        items = [i for c in child if c.tag in _LISTS for i in c]
        said = (child.text or "").strip() or ", ".join(t for i in items if (t := (i.text or "").strip()))
        if said:
            out.setdefault(name, said)
        elif deep < 4:
            entries = items or [child]
            if len(entries) > ENTRIES:
                out.setdefault(name, f"{len(entries)} entries, {ENTRIES} shown")
            for k, entry in enumerate(entries[:ENTRIES], 1):
                for key, value in _flat(entry, deep + 1).items():
                    out.setdefault(f"{name if len(entries) == 1 else f'{name}[{k}]'}/{key}", value)
    return out


def xmp_packet(data: bytes) -> bytes:
    if data[:4] == b"\x89PNG" and (said := png_texts(data).get(XMP_KEY)):
        return said.encode()
    m = re.search(rb"<([A-Za-z][\w.-]{0,30}:)?xmpmeta[\s>]", data)
    if not m:
        return b""
    close = b"</" + (m[1] or b"") + b"xmpmeta>"
    end = data.find(close, m.end())
    return data[m.start() : end + len(close)] if end >= 0 else b""


def xmp(data: bytes) -> list[Record]:
    """The properties of a packet, and a dated record for each step of its history."""
    root = tree(xmp_packet(data))
    if root is None:
        return []
    fields: dict[str, str] = {}
    for description in root.iter(f"{_RDF}Description"):
        fields = _flat(description) | fields
    steps = [_flat(i, 1) for h in root.iter("{http://ns.adobe.com/xap/1.0/mm/}History") for c in h for i in c]
    dated = [s for s in steps if moment(s.get("stEvt:when"))]
    low = {k.lower(): v for k, v in fields.items()}
    out = record("xmp", fields, "xmp", tool=low.get("xmp:creatortool"), at=moment(low.get("xmp:createdate")), note=low.get("dc:creator") and f"author {low['dc:creator']}") if fields or dated else []
    for s in dated[:STEPS]:
        out += record("xmp-history", s, "xmp-history", tool=s.get("stEvt:softwareAgent"), at=moment(s["stEvt:when"]), note=s.get("stEvt:action"))
    return out


# video

# Keys of QuickTime metadata by what they say.
QUICKTIME = {"com.apple.quicktime.make": "Make", "com.apple.quicktime.model": "Model", "com.apple.quicktime.software": "Encoder", "com.apple.quicktime.creationdate": "CreationTime", "com.apple.quicktime.location.ISO6709": "Location"}


def iso6709(text: str) -> str | None:
    m = re.match(r"([+-]\d{1,2}(?:\.\d+)?)([+-]\d{1,3}(?:\.\d+)?)", text or "")
    return f"{float(m[1]):.5f},{float(m[2]):.5f}" if m and abs(float(m[1])) <= 90 and abs(float(m[2])) <= 180 else None


def isobmff(data: bytes) -> list[Record]:
    moov = find_box(data, b"moov")
    if data[4:8] not in (b"ftyp", b"moov", b"wide", b"mdat") or moov is None:
        return []
    out: dict[str, str] = {}
    head = find_box(moov, b"mvhd") or b""
    if len(head) >= 20:
        seconds = struct.unpack_from(">Q" if head[0] else ">I", head, 4)[0]
        out["CreationTime"] = since(seconds, 1904) or ""
    for kind, body in boxes(find_box(moov, b"udta") or b""):
        if kind in (b"\xa9too", b"\xa9swr", b"\xa9enc"):
            out.setdefault("Encoder", clean(body[4:]))
        elif kind in (b"\xa9mak", b"\xa9mod", b"\xa9xyz"):
            out[{b"\xa9mak": "Make", b"\xa9mod": "Model", b"\xa9xyz": "Location"}[kind]] = clean(body[4:])
    meta = find_box(moov, b"meta") or (find_box(moov, b"udta", b"meta") or b"    ")[4:]
    keys = find_box(meta, b"keys") or b""
    names = [clean(body) for _, body in boxes(keys, 8)]
    for kind, body in boxes(find_box(meta, b"ilst") or b""):
        number = int.from_bytes(kind, "big")
        value = clean((find_box(body, b"data") or b"")[8:])
        name = names[number - 1] if 0 < number <= len(names) else None
        if name in QUICKTIME:
            out[QUICKTIME[name]] = value
        elif name:
            out[f"QuickTime:{name}"] = value
        elif kind == b"\xa9too":
            out.setdefault("Encoder", value)
    for k, (_, trak) in enumerate((b for b in boxes(moov) if b[0] == b"trak"), 1):
        handler, form = find_box(trak, b"mdia", b"hdlr") or b"", find_box(trak, b"mdia", b"minf", b"stbl", b"stsd") or b""
        out[f"Track[{k}]"] = " ".join(x for x in (clean(handler[8:12]), clean(form[12:16])) if x)
    geo = iso6709(out.get("Location", ""))
    device = " ".join(out[k] for k in ("Make", "Model") if out.get(k))
    tool = f"{device} (encoded with {out['Encoder']})" if device and out.get("Encoder") else device or out.get("Encoder")
    return record("isobmff", out | {"Location": geo}, "device-metadata" if device else "document-metadata", tool=tool, at=moment(out.get("CreationTime")), geo=geo)


# documents

# Entries of a PDF's Info dictionary; marks of its structure; namespaces of properties.
PDF_INFO = rb"/(Producer|Creator|Author|Title|Subject|Keywords|CreationDate|ModDate|Trapped)\s*(?:\(((?:\\.|[^\\)])*+)\)|<([0-9A-Fa-f\s]*)>)"
PDF_MARKS = (("OpenAction", rb"/OpenAction\b"), ("JavaScript", rb"/(?:JavaScript|JS)\b"), ("Launch", rb"/S\s*/Launch\b"), ("AcroForm", rb"/AcroForm\b"), ("XFA", rb"/XFA\s*(?:\[|\d+\s+\d+\s+R|\()"))
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_text(raw: bytes) -> str:
    """A literal string of a PDF."""
    data = re.sub(rb"\\([0-7]{1,3}|\r\n|[\s\S])", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], b"" if m[1].isspace() else m[1]), raw)
    return (data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")).strip("\0 ")


def pdf_streams(data: bytes) -> bytes:
    """Inflated streams that hold structure, up to a bound."""
    out, size = [], 0
    for m in re.finditer(rb"stream\r?\n", data):
        if size < INFLATED and data[m.end() : m.end() + 1] in (b"x", b"H", b"h"):
            body = inflate(data[m.end() : data.find(b"endstream", m.end())])
            if b"/" in body[:4096]:
                out.append(body)
                size += len(body)
    return b"\n".join(out)


def pdf(data: bytes) -> list[Record]:
    if data[:1024].find(b"%PDF-") < 0:
        return []
    packed = pdf_streams(data)
    whole, info = data + packed, data + packed
    if refs := re.findall(rb"/Info\s+(\d+)\s+(\d+)\s+R\b", data):
        objects = re.findall(rb"(?:^|[\r\n])\s*" + refs[-1][0] + rb"\s+" + refs[-1][1] + rb"\s+obj\b(.*?)endobj", data, re.S)
        info = objects[-1] if objects and re.search(PDF_INFO, objects[-1]) else info
    out: dict[str, str] = {}
    for m in re.finditer(PDF_INFO, info):
        raw = pdf_text(m[2]) if m[3] is None else pdf_text(bytes.fromhex(x + "0" * (len(x) % 2)) if (x := re.sub(rb"\s", b"", m[3]).decode()) else b"")
        if raw:
            out.setdefault(m[1].decode(), raw)
    linear = b"/Linearized" in data[:1024]
    if (saves := data.count(b"%%EOF") - linear) > 1:
        out["IncrementalUpdates"] = str(saves - 1)
        seen: set[int] = set()
        for k, part in enumerate(data.split(b"%%EOF")[:-1][linear:]):
            numbers = {int(n) for n in re.findall(rb"(?:^|[\r\n])\s*(\d+)\s+\d+\s+obj\b", part)}
            if k and numbers & seen:
                out[f"Update[{k}]:Replaced"] = ", ".join(map(str, sorted(numbers & seen)))
            if k and numbers - seen:
                out[f"Update[{k}]:Added"] = ", ".join(map(str, sorted(numbers - seen)))
            seen |= numbers
    for first, second in re.findall(rb"/ID\s*\[\s*<([0-9A-Fa-f\s]*)>\s*<([0-9A-Fa-f\s]*)>\s*\]", data)[-1:]:
        out |= {"PermanentID": re.sub(rb"\s", b"", first).decode().lower(), "ChangingID": re.sub(rb"\s", b"", second).decode().lower()}
    if re.search(rb"/Encrypt\s*(?:<<|\d+\s+\d+\s+R)", data):
        out["Encrypted"] = "yes"
    names = list(dict.fromkeys(pdf_text(m[1]) for m in re.finditer(rb"/Type\s*/Filespec\b[^>]{0,400}?/U?F\s*\(((?:\\.|[^\\)])*+)\)", whole)))
    if n := max(len(names), len(re.findall(rb"/Type\s*/EmbeddedFile\b", whole))):
        out |= {"EmbeddedFiles": str(n)} | {f"EmbeddedFile[{k}]": x for k, x in enumerate(names[:16], 1)}
    if n := len(re.findall(rb"/Type\s*/Sig\b", whole)):
        out["Signatures"] = str(n)
    out |= {name: "present" for name, mark in PDF_MARKS if re.search(mark, whole)}
    if links := list(dict.fromkeys(pdf_text(m[1]) for m in re.finditer(rb"/URI\s*\(((?:\\.|[^\\)])*+)\)", whole))):
        out |= {"URIs": str(len(links))} | {f"URI[{k}]": x for k, x in enumerate(links[:16], 1)}
    producer, creator = out.get("Producer"), out.get("Creator")
    tool = f"{producer} (created in {creator})" if producer and creator and producer != creator else producer or creator
    return record("pdf-info", out, tool=tool, at=moment(out.get("CreationDate")), note=out.get("Author") and f"author {out['Author']}")


def ooxml(data: bytes) -> list[Record]:
    archive = package(data)
    core, app = texts(tree(member(archive, "docProps/core.xml"))), texts(tree(member(archive, "docProps/app.xml")))
    out = app | core
    links, orders = [], []
    for name in sorted(archive.namelist() if archive else ()):
        if name.endswith(".rels"):
            root = tree(member(archive, name))
            links += [(r.get("Type", "").rpartition("/")[2], r.get("Target", "")) for r in (root if root is not None else ()) if r.get("TargetMode") == "External"]
        elif re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml", name):
            said = " ".join(a or b for a, b in re.findall(r"<w:instrText[^>]*>([^<]*)</w:instrText>|<w:fldSimple[^>]*w:instr=\"([^\"]*)\"", member(archive, name).decode("utf-8", "replace")))
            orders += [" ".join(x.split()) for x in re.findall(r"\bDDE(?:AUTO)?\b[^<>]{0,200}", said)]
    out |= {f"ExternalLink[{k}]": f"{kind}: {to}" for k, (kind, to) in enumerate(dict.fromkeys(links), 1) if k <= 16} | {f"DDE[{k}]": x for k, x in enumerate(dict.fromkeys(orders), 1) if k <= 16}
    tool = " ".join(app[k] for k in ("Application", "AppVersion") if app.get(k))
    said = [f"author {core['creator']}"] if core.get("creator") else []
    said += [f"last edited by {core['lastModifiedBy']}"] if core.get("lastModifiedBy") not in (None, core.get("creator")) else []
    return record("ooxml-properties", out, tool=tool, at=moment(core.get("created")), note="; ".join(said)) if out else []


def odf(data: bytes) -> list[Record]:
    root = tree(member(package(data), "meta.xml"))
    meta = next((e for e in (root if root is not None else ()) if local(e.tag) == "meta"), root)
    out, own = {}, {}
    for child in meta if meta is not None else ():
        text, marks = (child.text or "").strip(), {local(k): v for k, v in child.attrib.items()}
        if local(child.tag) == "user-defined":
            own.setdefault(marks.get("name", ""), text)
            continue
        if text:
            out.setdefault(local(child.tag), text)
        out = marks | out
    out = {k: v for k, v in own.items() if k} | out
    author = out.get("creator") or out.get("initial-creator")
    return record("odf-meta", out, tool=out.get("generator"), at=moment(out.get("creation-date")), note=author and f"author {author}") if out else []


def epub(data: bytes) -> list[Record]:
    archive = package(data)
    box = tree(member(archive, "META-INF/container.xml"))
    path = next((e.get("full-path") for e in (box.iter() if box is not None else ()) if local(e.tag) == "rootfile"), None) or next((n for n in (archive.namelist() if archive else ()) if n.endswith(".opf")), "")
    root = tree(member(archive, path))
    out: dict[str, str] = {}
    generator = None
    for e in root.iter() if root is not None else ():
        if "purl.org/dc" in e.tag and (e.text or "").strip():
            out.setdefault(local(e.tag), e.text.strip())
        elif local(e.tag) == "meta" and (e.get("name") or "").lower() in ("generator", "calibre:timestamp"):
            generator = generator or e.get("content")
    return record("epub-package", out, tool=generator, at=moment(out.get("date")), note=out.get("creator") and f"author {out['creator']}") if out or generator else []


def rtf(data: bytes) -> list[Record]:
    m = re.search(rb"\{\\\*\\generator ([^;}]{1,200})", data[: 1 << 18]) if data[:5] == b"{\\rtf" else None
    return record("rtf-generator", {}, tool=m[1].decode("latin-1").strip()) if m else []


def svg(data: bytes) -> list[Record]:
    text = data[: 1 << 18].decode("utf-8", "replace")
    m = re.search(r"<!--\s*(?:Generator|Created with)\s*:?\s*([^\n]{3,120}?)\s*-->", text, re.I)
    version = re.search(r'inkscape:version="([^"]{1,60})"', text)
    author = re.search(r"<dc:creator>.*?<dc:title>([^<]+)|<dc:creator>([^<]+)", text, re.S)
    tool = m[1] if m else f"Inkscape {version[1]}" if version else None
    name = (author[1] or author[2] or "").strip() if author else None
    return record("svg-metadata", {}, tool=tool, note=name and f"author {name}")


def notebook(data: bytes) -> list[Record]:
    try:
        meta = json.loads(data).get("metadata") or {}
    except (ValueError, AttributeError):
        return []
    language = meta.get("language_info") or {}
    parts = [x for x in ((meta.get("kernelspec") or {}).get("display_name"), " ".join(str(language[k]) for k in ("name", "version") if language.get(k))) if x]
    author = next((a.get("name") for a in meta.get("authors") or () if isinstance(a, dict)), None)
    return record("notebook-kernel", {}, tool=f"Jupyter ({', '.join(parts)})" if parts else "Jupyter notebook", note=author and f"author {author}")


# Meta names of pages that say who made them and how.
WEB_META = ("generator", "author", "creator", "publisher", "copyright", "description", "keywords", "date", "dcterms.created", "dcterms.modified", "dc.creator", "dc.date", "dc.title", "article:author", "article:published_time", "article:modified_time", "og:title", "og:type", "og:url", "og:site_name", "og:locale", "og:image", "og:description", "twitter:creator", "twitter:site", "twitter:title", "application-name")


def web(data: bytes) -> list[Record]:
    """Title, language, canonical address, meta names and JSON-LD of a page; the first value of each counts."""
    text = data[:INFLATED].decode("utf-8", "replace")
    out: dict[str, str] = {}
    marks = lambda tag: {k.lower(): " ".join((a or b or c).split()) for k, a, b, c in re.findall(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", tag)}
    if m := re.search(r"<title[^>]*>([^<]*)", text, re.I):
        out["title"] = " ".join(m[1].split())
    for name, tag in re.findall(r"<(html|link|meta)\b([^>]*)>", text, re.I):
        own = marks(tag)
        if name.lower() == "html" and own.get("lang"):
            out.setdefault("lang", own["lang"])
        elif name.lower() == "link" and own.get("rel", "").lower() == "canonical":
            out.setdefault("canonical", own.get("href", ""))
        elif (key := (own.get("name") or own.get("property") or "").lower()) in WEB_META:
            out.setdefault(key, own.get("content", "")[:VALUE])
    for block in re.findall(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", text, re.I | re.S)[:16]:
        try:
            nodes = json.loads(block)
        except ValueError:
            continue
        for node in nodes if isinstance(nodes, list) else [nodes]:
            for key in ("@type", "headline", "name", "datePublished", "dateModified", "author", "publisher"):
                value = node.get(key) if isinstance(node, dict) else None
                value = value[0] if isinstance(value, list) and value else value
                value = value.get("name") if isinstance(value, dict) else value
                if isinstance(value, str):
                    out.setdefault(f"jsonld:{key}", value)
    author = out.get("author") or out.get("article:author") or out.get("jsonld:author")
    made = out.get("article:published_time") or out.get("dcterms.created") or out.get("jsonld:datePublished") or out.get("date")
    return record("web-document", out, tool=out.get("generator"), at=moment(made), note=author and f"author {author}") if out else []


# Machines of PE files, names of font tables, property numbers of OLE summaries.
PE_MACHINE = {0x014C: "x86", 0x8664: "x64", 0x01C0: "ARM", 0x01C4: "ARM Thumb-2", 0xAA64: "ARM64", 0x0200: "Itanium"}
FONT_NAMES = {0: "Copyright", 1: "Family", 2: "Subfamily", 3: "UniqueID", 4: "FullName", 5: "Version", 6: "PostScriptName", 7: "Trademark", 8: "Manufacturer", 9: "Designer", 10: "Description", 11: "VendorURL", 12: "DesignerURL", 13: "License", 14: "LicenseURL", 16: "TypographicFamily", 17: "TypographicSubfamily"}
OLE_SUMMARY = {2: "Title", 3: "Subject", 4: "Author", 5: "Keywords", 6: "Comments", 7: "Template", 8: "LastAuthor", 9: "RevisionNumber", 10: "TotalEditingTime", 11: "LastPrinted", 12: "Created", 13: "Modified", 14: "Pages", 15: "Words", 16: "Characters", 18: "Application"}


def pe(data: bytes) -> list[Record]:
    """Header, debug path and version strings of a Windows program."""
    at = int.from_bytes(data[60:64], "little")
    if data[:2] != b"MZ" or data[at : at + 4] != b"PE\0\0":
        return []
    machine, _, linked = struct.unpack_from("<HHI", data, at + 4)
    out = {"Machine": PE_MACHINE.get(machine, f"0x{machine:04x}"), "LinkerVersion": f"{data[at + 26]}.{data[at + 27]}", "LinkTime": since(linked, 1970) or ""}
    if (m := data.find(b"RSDS")) >= 0 and m + 24 < len(data):
        a, b, c = struct.unpack_from("<IHH", data, m + 4)
        out |= {"PDBGuid": f"{a:08x}-{b:04x}-{c:04x}-{data[m + 12 : m + 14].hex()}-{data[m + 14 : m + 20].hex()}", "PDBAge": str(struct.unpack_from("<I", data, m + 20)[0]), "PDBPath": clean(data[m + 24 : max(m + 24, data.find(b"\0", m + 24))])}
    for name in ("ProductName", "FileDescription", "ProductVersion", "FileVersion", "CompanyName", "OriginalFilename", "LegalCopyright"):
        key = name.encode("utf-16-le") + b"\0\0"
        if (m := data.find(key)) >= 0:
            body = data[m + len(key) : m + len(key) + 2 * VALUE]
            text = body[: len(body) // 2 * 2].decode("utf-16-le", "replace").lstrip("\0")
            out[name] = text.partition("\0")[0].strip()
    product, version = out.get("ProductName") or out.get("FileDescription"), out.get("ProductVersion")
    year = int(out["LinkTime"][:4]) if out["LinkTime"] else 0
    return record("pe-header", out, tool=" ".join(x for x in (product, version) if x), at=out["LinkTime"] if 1990 <= year <= 2040 else None)


def font(data: bytes) -> list[Record]:
    """Names and dates of TrueType, OpenType and WOFF fonts."""
    kinds = {b"\0\1\0\0": "TrueType", b"OTTO": "OpenType", b"true": "TrueType", b"wOFF": "WOFF"}
    magic = data[:4]
    if magic == b"ttcf" and len(data) > 16:
        base = int.from_bytes(data[12:16], "big")
        magic, start = data[base : base + 4], base
    else:
        start = 0
    if magic not in kinds:
        return []
    tables = {}
    woff = magic == b"wOFF"
    for k in range(int.from_bytes(data[start + (12 if woff else 4) :][:2], "big")):
        entry = start + (44 + 20 * k if woff else 12 + 16 * k)
        if entry + 20 > len(data):
            break
        name, a, b, c = struct.unpack_from(">4sIII", data, entry)
        tables[name] = (inflate(data[a : a + b]) if b < c else data[a : a + b]) if woff else data[b : b + c]
    out = {"Container": kinds[magic]}
    names = tables.get(b"name", b"")
    if len(names) >= 6:
        count, base = struct.unpack_from(">HH", names, 2)
        for k in range(count):
            if 18 + 12 * k > len(names):
                break
            platform, _, _, number, size, at = struct.unpack_from(">6H", names, 6 + 12 * k)
            if number in FONT_NAMES:
                raw = names[base + at : base + at + size]
                text = raw.decode("utf-16-be" if platform in (0, 3) else "mac_roman", "replace").strip("\0 ")
                if text and (platform == 3 or FONT_NAMES[number] not in out):
                    out[FONT_NAMES[number]] = " ".join(text.split())
    head = tables.get(b"head", b"")
    if len(head) >= 36:
        made, changed = struct.unpack_from(">QQ", head, 20)
        out |= {"Created": since(made, 1904) or "", "Modified": since(changed, 1904) or "", "FontRevision": f"{struct.unpack_from('>i', head, 4)[0] / 65536:.3f}"}
    vendor = clean(tables.get(b"OS/2", b"")[58:62])
    return record("font-tables", out | {"VendorID": vendor}, tool=out.get("Manufacturer") or vendor, at=out.get("Created"), note=out.get("Family") and f"family {out['Family']}")


def cfb_streams(data: bytes) -> dict[str, bytes]:
    """Streams of a compound file by their paths."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(data) < 512:
        return {}
    size, small = 1 << int.from_bytes(data[30:32], "little"), 1 << int.from_bytes(data[32:34], "little")
    if not 7 <= size.bit_length() <= 17 or small > size:
        return {}
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    first_dir, cutoff, first_mini, _, first_difat = (struct.unpack_from("<I", data, at)[0] for at in (48, 56, 60, 64, 68))
    fat_sectors = [n for n in struct.unpack_from("<109I", data, 76) if n < 0xFFFFFFF0]
    seen: set[int] = set()
    while first_difat < 0xFFFFFFF0 and first_difat not in seen:
        seen.add(first_difat)
        more = struct.unpack(f"<{len(sector(first_difat)) // 4}I", sector(first_difat))
        fat_sectors += [n for n in more[:-1] if n < 0xFFFFFFF0]
        first_difat = more[-1] if more else 0xFFFFFFFE
    fat = [n for s in fat_sectors for n in struct.unpack(f"<{len(sector(s)) // 4}I", sector(s))]

    def chain(n: int, table: list[int], read: Callable[[int], bytes]) -> bytes:
        out, met = [], set()
        while n < len(table) and n not in met:
            met.add(n)
            out.append(read(n))
            n = table[n]
        return b"".join(out)

    entries = chain(first_dir, fat, sector)
    rows = [entries[i : i + 128] for i in range(0, len(entries) - 127, 128)]
    if not rows:
        return {}
    raw = chain(first_mini, fat, sector)
    mini = list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
    root = chain(struct.unpack_from("<I", rows[0], 116)[0], fat, sector)
    out: dict[str, bytes] = {}
    todo, met = [(struct.unpack_from("<I", rows[0], 76)[0], "")], set()
    while todo:
        k, base = todo.pop()
        if k >= len(rows) or k in met:
            continue
        met.add(k)
        row = rows[k]
        n = int.from_bytes(row[64:66], "little")
        name = base + row[: max(0, n - 2)].decode("utf-16-le", "replace")
        left, right, child, start, length = (struct.unpack_from("<I", row, at)[0] for at in (68, 72, 76, 116, 120))
        todo += [(left, base), (right, base), (child, name + "/")]
        if row[66] == 2:
            body = chain(start, fat, sector) if length >= cutoff else chain(start, mini, lambda i: root[i * small : (i + 1) * small])
            out[name] = body[:length]
    return out


def property_set(raw: bytes) -> dict[int, object]:
    """Numbers and values of the first section of an OLE property set."""
    if len(raw) < 48 or raw[:2] != b"\xfe\xff":
        return {}
    base = int.from_bytes(raw[44:48], "little")
    out: dict[int, object] = {}
    for k in range(min(int.from_bytes(raw[base + 4 : base + 8], "little"), 256)):
        if base + 16 + 8 * k > len(raw):
            break
        number, at = struct.unpack_from("<II", raw, base + 8 + 8 * k)
        body = raw[base + at : base + at + 8 + VALUE]
        if len(body) < 8:
            continue
        kind = int.from_bytes(body[:4], "little")
        if kind in (30, 31):
            n = int.from_bytes(body[4:8], "little")
            out[number] = body[8 : 8 + n * (2 if kind == 31 else 1)].decode("utf-16-le" if kind == 31 else "cp1252", "replace").strip("\0 ")
        elif kind == 64 and len(body) >= 12:
            out[number] = struct.unpack_from("<Q", body, 4)[0]
        elif kind in (2, 3):
            out[number] = struct.unpack_from("<h" if kind == 2 else "<i", body, 4)[0]
    return out


def ole(data: bytes) -> list[Record]:
    streams = cfb_streams(data)
    found = property_set(next((v for k, v in streams.items() if k.endswith("\x05SummaryInformation")), b""))
    out = {}
    for number, name in OLE_SUMMARY.items():
        value = found.get(number)
        if isinstance(value, int) and name in ("LastPrinted", "Created", "Modified"):
            value = since(value / 1e7, 1601)
        elif isinstance(value, int) and name == "TotalEditingTime":
            value = f"{value // 10**7} s"
        if value not in (None, "", 0):
            out[name] = str(value)
    if any("VBA/" in k or k.endswith("/VBA") for k in streams):
        out["Macros"] = "present"
    return record("ole-summary", out, tool=out.get("Application"), at=out.get("Created"), note=out.get("Author") and f"author {out['Author']}") if out else []


# Which readers look at files of a suffix.
READERS: dict[str, tuple[Callable[[bytes], list[Record]], ...]] = {
    s: readers
    for suffixes, readers in (
        ("pdf", (pdf, xmp)), ("docx xlsx pptx docm xlsm pptm dotx", (ooxml,)), ("odt ods odp odg", (odf,)), ("epub", (epub,)), ("rtf", (rtf,)), ("svg", (svg, xmp)), ("ipynb", (notebook,)), ("html htm xhtml", (web,)),
        ("jpg jpeg jpe", (exif, photoshop, iptc, xmp)), ("tif tiff dng nef cr2 arw webp heic heif avif", (exif, xmp)), ("png", (png, xmp)), ("psd psb", (photoshop, iptc, xmp)), ("mp4 m4v m4a mov 3gp", (isobmff, xmp)),
        ("wav bwf avi", (riff,)), ("mkv mka webm", (matroska,)), ("flac ogg oga opus", (vorbis,)), ("mp3", (id3, ape)), ("aif aiff aifc", (aiff,)), ("ape wv mpc", (ape,)), ("exe dll sys scr ocx", (pe,)), ("ttf otf ttc woff", (font,)),
        ("doc xls ppt msg msi", (ole,)),
    )
    for s in suffixes.split()
}


#: Suffixes of files that may have content credentials.
SIGNED = frozenset("jpg jpeg jpe png webp wav avi mp4 m4v m4a mov heic heif avif tif tiff dng svg".split())


def read(suffix: str, data: bytes) -> list[Record]:
    """Records of one file; a reader that a broken file stops gives nothing."""
    out: list[Record] = []
    if suffix.lower().lstrip(".") in SIGNED:
        from .credentials import c2pa

        try:
            out += c2pa(data)
        except (struct.error, IndexError, ValueError, KeyError, TypeError, AttributeError, OverflowError, RecursionError):
            out = []
    for reader in (*READERS.get(suffix.lower().lstrip("."), ()), *_more(suffix.lower().lstrip("."))):
        try:
            out += reader(data)
        except (struct.error, IndexError, ValueError, KeyError, UnicodeError, OverflowError, RecursionError):
            continue
    return out


@functools.lru_cache(256)
def _more(suffix: str) -> tuple[Callable[[bytes], list[Record]], ...]:
    """Readers that build on those of this module."""
    from .devices import maker_notes, telemetry

    readers = READERS.get(suffix, ())
    return ((maker_notes,) if exif in readers else ()) + ((telemetry,) if isobmff in readers else ())


_SCHEMA = "path string, seq long, source string, block string, tool string, at string, geo string, location string, note string, fields map<string,string>"
_TEXTS = ("source", "block", "tool", "at", "geo", "location", "note")


def _read(batches):
    for b in batches:
        for path, data in zip(b.column("path").to_pylist(), b.column("content")):  # a file at a time
            found = read(path.rpartition(".")[2], data.as_py() or b"")
            if found:
                columns = [pa.array([path] * len(found)), pa.array(range(len(found)), pa.int64()), *(pa.array([r.get(k) for r in found], pa.string()) for k in _TEXTS)]
                maps = pa.array([[(k, str(v)) for k, v in r["fields"].items()] for r in found], pa.map_(pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([*columns, maps], ["path", "seq", *_TEXTS, "fields"])


def records(files: DataFrame) -> DataFrame:
    """path, seq and record of every file (path, content) of a known suffix."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.where(suffix.isin(*READERS)).select("path", "content").mapInArrow(_read, _SCHEMA)
