"""What devices write in their own ways: maker notes of cameras, and telemetry tracks of video files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from .readers import TIFF_TYPES, VALUE, Record, boxes, clean, exif_payload, find_box, record, shown

# How maker notes begin: mark, order of bytes (empty: that of the file, ?: said at an offset), where the directory is, and
# whether places count from the note (True) or from the TIFF header; names of tags by vendor.
LAYOUTS = (
    ("Nikon", b"Nikon\0\2", "tiff", 10, True), ("Olympus", b"OLYMPUS\0II", "<", 12, True), ("Olympus", b"OLYMP\0", "", 8, False), ("Fujifilm", b"FUJIFILM", "<", 12, True), ("Apple", b"Apple iOS\0", ">", 14, True), ("Sony", b"SONY DSC \0\0\0", "", 12, False),
    ("Panasonic", b"Panasonic\0\0\0", "", 12, False), ("Pentax", b"PENTAX \0", ">", 10, True), ("Pentax", b"AOC\0", "", 6, False),
)
NAMES = {
    "Canon": {0x0006: "ImageType", 0x0007: "FirmwareVersion", 0x0008: "FileNumber", 0x0009: "OwnerName", 0x000C: "SerialNumber", 0x0010: "ModelID", 0x0095: "LensModel", 0x0096: "InternalSerialNumber"},
    "Nikon": {0x0002: "ISO", 0x0004: "Quality", 0x001D: "SerialNumber", 0x0084: "Lens", 0x00A7: "ShutterCount"}, "Olympus": {0x0207: "CameraType", 0x0209: "CameraID", 0x0404: "SerialNumber"}, "Fujifilm": {0x0000: "Version", 0x0010: "InternalSerialNumber", 0x1000: "Quality"},
    "Apple": {0x0001: "Version", 0x000B: "BurstUUID", 0x0011: "ContentIdentifier", 0x0015: "ImageUniqueID"}, "Sony": {0xB020: "CreativeStyle", 0xB001: "ModelID"}, "Panasonic": {0x0002: "FirmwareVersion", 0x0025: "InternalSerialNumber", 0x0051: "LensType", 0x0052: "LensSerialNumber"},
    "Pentax": {0x0005: "ModelID", 0x0229: "SerialNumber"},
}
#: Tags of a note that are shown.
SHOWN = 128


def directory(data: bytes, order: str, at: int, base: int = 0) -> Iterator[tuple[int, object]]:
    """(tag, value) of the entries of a directory; values whose place is not in the data are left out."""
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(data):
            return
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        unit = 8 if kind in (5, 10) else struct.calcsize(TIFF_TYPES[kind]) if kind in TIFF_TYPES else 1 if kind in (2, 7) else 0
        size = unit * count
        place = entry + 8 if size <= 4 else base + struct.unpack_from(order + "I", data, entry + 8)[0]
        if not 0 < size <= VALUE or place + size > len(data):
            continue
        raw = data[place : place + size]
        if kind in (2, 7):
            yield tag, clean(raw) if kind == 2 or raw.strip(b"\0").isascii() and raw.strip(b"\0").decode("latin-1").isprintable() else raw[:64].hex()
        elif kind in (5, 10):
            pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
            yield tag, [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2])]
        else:
            yield tag, list(struct.unpack(order + TIFF_TYPES[kind] * count, raw))


def _place(tiff: bytes, order: str) -> tuple[int, int] | None:
    """Where the maker note is, and how long."""
    first = struct.unpack_from(order + "I", tiff, 4)[0]
    for at, wanted in ((first, 0x8769), (None, 0x927C)):
        at = sub if at is None else at
        for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
            tag, _, count, value = struct.unpack_from(order + "HHII", tiff, at + 2 + 12 * k)
            if tag == wanted == 0x927C:
                return value, count
            if tag == wanted:
                sub = value
                break
        else:
            return None
    return None


def maker_notes(data: bytes) -> list[Record]:
    tiff = exif_payload(data)
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    found = _place(tiff, order) if order and len(tiff) > 8 else None
    if not found:
        return []
    at, size = found
    note = tiff[at : at + size]
    make = "Canon"
    begin, base, own = at, 0, order
    for name, mark, said, skip, inside in LAYOUTS:
        if note.startswith(mark):
            make, begin, base, own = name, at + skip, at if inside else 0, said or order
            if said == "tiff":  # a TIFF of its own behind the mark
                own = {b"II": "<", b"MM": ">"}.get(note[skip : skip + 2], order)
                base, begin = at + skip, at + skip + struct.unpack_from(own + "I", note, skip + 4)[0]
            elif name == "Fujifilm":
                begin = at + struct.unpack_from("<I", note, 8)[0]
            break
    else:
        if not clean(tiff).strip() or b"Canon" not in tiff[:4096]:
            return []
    names = NAMES[make]
    fields = {f"{make}:{names.get(tag, f'0x{tag:04x}')}": shown(v[0] if isinstance(v, list) and len(v) == 1 else v)[:256] for tag, v in list(directory(tiff, own, begin, base))[:SHOWN]}
    return record("maker-notes", fields, "device-metadata", note=f"{len(fields)} entries of {make}") if fields else []


# telemetry

# Types of values in GPMF.
GPMF_TYPES = {"b": "b", "B": "B", "s": "h", "S": "H", "l": "i", "L": "I", "f": "f", "d": "d", "j": "q", "J": "Q"}


def gpmf(data: bytes, deep: int = 0) -> Iterator[tuple[str, object]]:
    """(key, value) of the records of a telemetry sample, in order; containers are gone into."""
    at = 0
    while at + 8 <= len(data) and deep < 8:
        key, kind, size, repeat = struct.unpack_from(">4sBBH", data, at)
        body = data[at + 8 : at + 8 + size * repeat]
        at += 8 + (size * repeat + 3) // 4 * 4
        name = key.decode("latin-1")
        if kind == 0:
            yield from gpmf(body, deep + 1)
        elif chr(kind) in GPMF_TYPES and len(body) == size * repeat:
            code = GPMF_TYPES[chr(kind)]
            n = size // struct.calcsize(code)
            yield name, [struct.unpack_from(f">{n}{code}", body, i * size) for i in range(repeat)]
        else:
            yield name, clean(body)


def samples(data: bytes, table: bytes) -> Iterator[bytes]:
    """The samples of a track by its sample table."""
    sizes, offsets, runs = find_box(table, b"stsz") or b"", find_box(table, b"stco"), find_box(table, b"stsc") or b""
    wide = offsets is None
    offsets = (find_box(table, b"co64") or b"") if wide else offsets
    if len(sizes) < 12 or len(offsets) < 8:
        return
    same, count = struct.unpack_from(">II", sizes, 4)
    length = lambda i: same or (struct.unpack_from(">I", sizes, 12 + 4 * i)[0] if 16 + 4 * i <= len(sizes) else 0)
    steps = [struct.unpack_from(">II", runs, 8 + 12 * k) for k in range((len(runs) - 8) // 12)] or [(1, 1)]
    i = 0
    for chunk in range(min(int.from_bytes(offsets[4:8], "big"), (len(offsets) - 8) // (8 if wide else 4))):
        at = struct.unpack_from(">Q" if wide else ">I", offsets, 8 + chunk * (8 if wide else 4))[0]
        for _ in range(next(n for first, n in reversed(steps) if first <= chunk + 1 or first == steps[0][0])):
            if i >= count:
                return
            yield data[at : at + length(i)]
            at, i = at + length(i), i + 1


def telemetry(data: bytes) -> list[Record]:
    """Device, streams and positions of the telemetry track of a video: how many, the first and the last."""
    moov = find_box(data, b"moov") if data[4:8] in (b"ftyp", b"wide", b"mdat", b"moov") else None
    devices, streams, points, times, fields = {}, {}, 0, [], {}
    first = last = None
    for name, trak in boxes(moov or b""):
        table = find_box(trak, b"mdia", b"minf", b"stbl") if name == b"trak" else None
        if not table or (find_box(table, b"stsd") or b"")[12:16] != b"gpmd":
            continue
        for sample in samples(data, table):
            scale: list[float] = [1.0]
            for key, value in gpmf(sample):
                if key == "DVNM":
                    devices[str(value)] = None
                elif key == "STNM":
                    streams[str(value)] = None
                elif key == "SCAL":
                    scale = [float(x) for row in value for x in row]
                elif key == "GPSU":
                    times.append(str(value))
                elif key == "GPS5" and value:
                    fix = lambda row: (row[0] / (scale[0] or 1), row[1] / (scale[1 % len(scale)] or 1))  # noqa: B023, E731  used at once
                    points += len(value)
                    first, last = first or fix(value[0]), fix(value[-1])
    if not (devices or streams or points):
        return []
    fields |= {"GPMF:Device": ", ".join(devices), "GPMF:Streams": ", ".join(streams)}
    stamp = lambda t: f"20{t[:2]}-{t[2:4]}-{t[4:6]}T{t[6:8]}:{t[8:10]}:{t[10:12]}Z" if len(t) >= 12 and t[:12].isdigit() else None
    began, ended = (stamp(times[0]), stamp(times[-1])) if times else (None, None)
    if points:
        fields |= {"GPMF:GPSPoints": str(points), "GPMF:GPSFirst": "{:.5f},{:.5f}".format(*first), "GPMF:GPSLast": "{:.5f},{:.5f}".format(*last), "GPMF:GPSStart": began or "", "GPMF:GPSEnd": ended or ""}
    return record("gpmf", fields, "device-metadata", tool=next(iter(devices), None), at=began, geo=fields.get("GPMF:GPSFirst"), note=f"GPS track of {points} points" if points else None)
