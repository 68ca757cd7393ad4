"""Examination of JPEG files: structure, quality, previews, and what does not fit together."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import case
from .readers import exif_payload, tiff_tags

# The quantization tables of the JPEG standard's annex K, in zigzag order; names of frames.
LUMA = (16, 11, 12, 14, 12, 10, 16, 14, 13, 14, 18, 17, 16, 19, 24, 40, 26, 24, 22, 22, 24, 49, 35, 37, 29, 40, 58, 51, 61, 60, 57, 51, 56, 55, 64, 72, 92, 78, 64, 68, 87, 69, 55, 56, 80, 109, 81, 87, 95, 98, 103, 104, 103, 62, 77, 113, 121, 112, 100, 120, 92, 101, 103, 99)
CHROMA = (17, 18, 18, 24, 21, 24, 47, 26, 26, 47, 99, 66, 56, 66, 99, 99, 99, 99, 99, 99, *(99 for _ in range(44)))
FRAMES = {0xC0: "baseline", 0xC1: "extended", 0xC2: "progressive", 0xC3: "lossless"}


def scaled(base: tuple[int, ...], quality: int) -> tuple[int, ...]:
    """A standard table at a quality from 1 to 100, by the rule that most encoders follow."""
    factor = 5000 // quality if quality < 50 else 200 - 2 * quality
    return tuple(min(255, max(1, (v * factor + 50) // 100)) for v in base)


def quality(tables: dict[int, tuple[int, ...]]) -> tuple[int, int] | None:
    """The nearest quality and how far its tables are from those of the file (0: exactly these)."""
    bases = [(tables[i], base) for i, base in ((0, LUMA), (1, CHROMA)) if i in tables]
    if not bases:
        return None
    off = lambda q: sum(abs(a - b) for own, base in bases for a, b in zip(own, scaled(base, q)))
    best = min(range(1, 101), key=lambda q: (off(q), -q))
    return best, off(best)


def structure(data: bytes) -> dict[str, object]:
    """Markers, frame, tables, restarts and what stands behind the end, of a JPEG; empty for other bytes."""
    if data[:2] != b"\xff\xd8":
        return {}
    out: dict[str, object] = {"markers": [], "tables": {}, "restarts": 0, "ended": False, "trailing": 0}
    at = 2
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            return out | {"broken": at}
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return out | {"ended": True, "trailing": len(data) - at - 2}
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) < size - 2:
            return out | {"broken": at}
        out["markers"].append(f"{marker:02X}")
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                values = body[1 : 1 + n]
                out["tables"][number] = tuple(int.from_bytes(values[i : i + 1 + bool(wide)], "big") for i in range(0, len(values), 1 + bool(wide)))
                body = body[1 + n :]
        elif marker in FRAMES and len(body) >= 6:
            out |= {"frame": FRAMES[marker], "height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "components": body[5]}
        at += 2 + size
        if marker == 0xDA:  # entropy-coded data, up to the next marker that is no restart and no stuffed byte
            while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data) and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                out["restarts"] += data[at + 1] != 0
                at += 2
            if at < 0:
                return out
    return out


def preview(data: bytes) -> bytes:
    """The thumbnail that an EXIF block carries, if it is a JPEG of its own."""
    block = exif_payload(data)
    at = block.find(b"\xff\xd8\xff", 8)
    end = block.find(b"\xff\xd9", at)
    return block[at : end + 2] if 0 <= at < end else b""


def facts(data: bytes) -> dict[str, str]:
    """What an examination of a picture shows, by name."""
    own = structure(data)
    if not own:
        return {}
    out = {"markers": " ".join(own["markers"]), "frame": own.get("frame"), "dimensions": f"{own['width']}x{own['height']}" if "width" in own else None, "components": own.get("components"), "restarts": own["restarts"] or None}
    if found := quality(own["tables"]):
        out |= {"quality": found[0], "quality.distance": found[1]}
    out |= {"ended": "yes" if own["ended"] else "no", "trailing": own["trailing"] or None, "broken": own.get("broken")}
    tags = tiff_tags(exif_payload(data))
    said = (tags.get("ExifImageWidth"), tags.get("ExifImageHeight"))
    if all(said) and "width" in own and said != (own["width"], own["height"]):
        out["conflict.dimensions"] = f"EXIF says {said[0]}x{said[1]}"
    small = preview(data)
    if small:
        mini = structure(small)
        out |= {"preview.sha256": hashlib.sha256(small).hexdigest(), "preview.dimensions": f"{mini['width']}x{mini['height']}" if "width" in mini else None}
        if mini.get("height") and own.get("height") and abs(mini["width"] / mini["height"] / (own["width"] / own["height"]) - 1) > 0.05:
            out["conflict.preview"] = "its shape is not that of the picture"
    if serial := tags.get("BodySerialNumber"):
        out["serial"] = serial
    return {k: str(v) for k, v in out.items() if v is not None}


def _examine(batches):
    for b in batches:
        for path, data in zip(b.column("path").to_pylist(), b.column("content")):  # a file at a time
            try:
                found = list(facts(data.as_py() or b"").items())
            except (ValueError, IndexError, ZeroDivisionError, KeyError):
                found = [("broken", "unreadable")]
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([found], pa.map_(pa.string(), pa.string()))], ["path", "facts"])


def examined(files: DataFrame) -> DataFrame:
    """path and facts of every JPEG (path, content)."""
    return files.where(F.col("path").rlike(r"(?i)\.jpe?g$")).select("path", "content").mapInArrow(_examine, "path string, facts map<string,string>")


def by_serial(photos: DataFrame) -> DataFrame:
    """serial and number of pictures of the cameras that took more than one."""
    return photos.select("path", case.serial(F.col("facts")["serial"]).alias("serial")).where("serial is not null").groupBy("serial").agg(F.count_distinct("path").alias("photos")).where("photos > 1")


def _has(*keys: str) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.coalesce(F.map_contains_key("facts", k), F.lit(False))
    return F.count_if(out)


def summary(photos: DataFrame) -> DataFrame:
    """How many pictures there are, how many could be read, have conflicts, previews and bytes behind their end."""
    return photos.agg(F.count("*").alias("photos"), F.count_if(F.size("facts") > 0).alias("read"), _has("conflict.dimensions", "conflict.preview").alias("conflicts"), _has("preview.sha256").alias("previews"), _has("trailing").alias("trailing"), _has("broken").alias("broken"))
