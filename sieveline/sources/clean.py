"""Removal of metadata: bytes in, bytes without what the file says of itself out, and what was taken.

JPEG segments, PNG chunks, SVG elements, ISO media boxes and properties of packages go; image data is never
touched. What is left is read again by the readers of this package, so a result says what still speaks.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import readers

# What goes from each kind of file.
JPEG_GOES = {0xE1: "EXIF and XMP", 0xE2: "ICC profile", 0xED: "Photoshop and IPTC", 0xFE: "comment", 0xEB: "content credentials"}
PNG_GOES = {b"tEXt": "text", b"zTXt": "text", b"iTXt": "text", b"eXIf": "EXIF", b"tIME": "time", b"caBX": "content credentials"}
BOXES_GO, BOXES_INTO, TIMED = (b"udta", b"meta", b"uuid"), (b"moov", b"trak", b"mdia"), (b"mvhd", b"tkhd", b"mdhd")
PACKAGE_GOES = ("docProps/core.xml", "docProps/app.xml", "docProps/custom.xml", "docProps/thumbnail.jpeg", "meta.xml", "Thumbnails/thumbnail.png")

Stripped = tuple[bytes, list[str]]


def jpeg(data: bytes) -> Stripped:
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    out, gone, at = [data[:2]], [], 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2:
            raise ValueError("broken segment")
        if data[at + 1] in JPEG_GOES:
            gone.append(JPEG_GOES[data[at + 1]])
        else:
            out.append(data[at : at + 2 + size])
        at += 2 + size
    end = data.rfind(b"\xff\xd9")
    if 0 <= end < len(data) - 2:
        gone.append("bytes behind the image")
        data = data[: end + 2]
    return b"".join([*out, data[at:]]), gone


def png(data: bytes) -> Stripped:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    out, gone, at = [data[:8]], [], 8
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        if name in PNG_GOES:
            gone.append(PNG_GOES[name])
        else:
            out.append(data[at : at + 12 + size])
        at += 12 + size
        if name == b"IEND":
            gone += ["bytes behind the image"] if at < len(data) else []
            break
    return b"".join(out), gone


def svg(data: bytes) -> Stripped:
    gone = []
    for name, pattern in (("comments", rb"<!--.*?-->"), ("metadata", rb"<metadata\b.*?</metadata\s*>"), ("editor attributes", rb"\s(?:inkscape|sodipodi):[\w-]+=(?:\"[^\"]*\"|'[^']*')"), ("editor elements", rb"<(?:inkscape|sodipodi):[\w-]+\b[^>]*/>")):
        data, n = re.subn(pattern, b"", data, flags=re.S)
        gone += [name] if n else []
    return data, gone


def _boxes(data: bytes, gone: list[str]) -> bytes:
    """Boxes with those that go made free, so that every place in the file stays where it is, and times set to nought."""
    out = bytearray(data)
    todo = [(0, len(data))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            size, name = struct.unpack_from(">I4s", out, at)
            head = 8
            if size == 1 and at + 16 <= end:
                size, head = struct.unpack_from(">Q", out, at + 8)[0], 16
            size = end - at if size == 0 else size
            if size < head or at + size > end:
                break
            if name in BOXES_GO:
                gone.append(name.decode("latin-1"))
                out[at + 4 : at + 8] = b"free"
                out[at + head : at + size] = bytes(size - head)
            elif name in BOXES_INTO:
                todo.append((at + head, at + size))
            elif name in TIMED and size > head + 20:
                wide = 16 if out[at + head] else 8
                if any(out[at + head + 4 : at + head + 4 + wide]):
                    gone.append("times")
                    out[at + head + 4 : at + head + 4 + wide] = bytes(wide)
            at += size
    return bytes(out)


def movie(data: bytes) -> Stripped:
    if data[4:8] != b"ftyp":
        raise ValueError("no ISO media")
    gone: list[str] = []
    return _boxes(data, gone), list(dict.fromkeys(gone))


def packaged(data: bytes) -> Stripped:
    """A package without its properties; parts that must be there are left empty, and times of members are set to the first one a zip can hold."""
    source = readers.package(data)
    if source is None:
        raise ValueError("no package")
    out, gone = io.BytesIO(), []
    with zipfile.ZipFile(out, "w") as target:
        for info in source.infolist():
            body = source.read(info)
            if info.filename in PACKAGE_GOES:
                gone.append(info.filename)
                root = re.search(rb"<(?!\?|!)([\w:.-]+)((?:\s+xmlns(?::\w+)?=(?:\"[^\"]*\"|'[^']*'))*)", body)
                if not root:
                    continue
                body = b"<" + root[1] + root[2] + b"/>"
            clean = zipfile.ZipInfo(info.filename)
            clean.compress_type = info.compress_type
            target.writestr(clean, body)
    return out.getvalue(), gone


WAYS = {**dict.fromkeys(("jpg", "jpeg", "jpe"), jpeg), "png": png, "svg": svg, **dict.fromkeys(("mp4", "m4v", "m4a", "mov", "3gp"), movie), **dict.fromkeys("docx xlsx pptx docm xlsm pptm odt ods odp".split(), packaged)}


def strip(suffix: str, data: bytes) -> tuple[bytes | None, list[str], list[str], str | None]:
    """(body, removed, blocks that still speak, note); no body where the file can't be cleaned."""
    way = WAYS.get(suffix.lower().lstrip("."))
    if way is None:
        return None, [], [], "no way to clean this format"
    try:
        body, gone = way(data)
    except (ValueError, struct.error, IndexError, RuntimeError, NotImplementedError, zipfile.BadZipFile, OSError) as e:
        return None, [], [], f"not cleaned: {e}"
    left = [r["block"] for r in readers.read(suffix, body) if r["fields"] and not all(k.startswith(("JFIF", "Track")) or k == "ImageWidth" for k in r["fields"])]
    return body, list(dict.fromkeys(gone)), left, None


def _clean(batches):
    for b in batches:
        for path, data in zip(b.column("path").to_pylist(), b.column("content")):  # a file at a time
            body, gone, left, note = strip(path.rpartition(".")[2], data.as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([body], pa.binary()), pa.array([gone], pa.list_(pa.string())), pa.array([left], pa.list_(pa.string())), pa.array([note], pa.string())], ["path", "body", "removed", "remaining", "note"])


def cleaned(files: DataFrame) -> DataFrame:
    """path, body, removed, remaining and note of every file (path, content)."""
    return files.select("path", "content").mapInArrow(_clean, "path string, body binary, removed array<string>, remaining array<string>, note string")


def summary(results: DataFrame) -> DataFrame:
    """How many files there are, how many were cleaned, and how many still speak."""
    return results.agg(F.count("*").alias("files"), F.count("body").alias("cleaned"), F.count_if(F.size("remaining") > 0).alias("still_readable"))
