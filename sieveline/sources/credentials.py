"""Content credentials: the manifest store of a file, read without any key.

A store is a tree of JUMBF boxes whose leaves are CBOR. The last manifest describes the file as it is; earlier ones
are its history. The hard binding (a digest of the file without the store) is checked, the signature is not, and the note says so.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

from .readers import Record, boxes, chunks, png_chunks, record, segments

#: Depth of values and of boxes, and the items of one value, that are read.
DEEP, ITEMS = 32, 1 << 16
# What a declared source of a picture means; digests of bindings; the box of a store in ISO media.
SOURCES = {
    "trainedAlgorithmicMedia": "generated by an AI model", "compositeWithTrainedAlgorithmicMedia": "partly generated by an AI model", "algorithmicMedia": "generated by an algorithm", "digitalCapture": "captured by a camera", "digitalArt": "digital art",
    "composite": "a composite of several sources",
}
DIGESTS = ("sha256", "sha384", "sha512")
BMFF_UUID = bytes.fromhex("d8fec3d61b0e483c92975828877ec481")


def cbor(data: bytes, at: int = 0, deep: int = 0) -> tuple[object, int]:
    """A value of CBOR and where it ends; tags are left off, and lengths that aren't there are an error."""
    if deep > DEEP or at >= len(data):
        raise ValueError("too deep or cut")
    major, info = data[at] >> 5, data[at] & 31
    at += 1
    n: int | None = info
    if 24 <= info <= 27:
        size = 1 << (info - 24)
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    elif info == 31 and major in (2, 3, 4, 5):
        n = None
    elif info > 27:
        raise ValueError("no such length")
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if n is None:
            parts = []
            while data[at] != 0xFF:
                part, at = cbor(data, at, deep + 1)
                parts.append(part)
            return (b"" if major == 2 else "").join(parts), at + 1
        if at + n > len(data):
            raise ValueError("cut")
        return (data[at : at + n] if major == 2 else data[at : at + n].decode("utf-8", "replace")), at + n
    if major in (4, 5):
        out: list | dict = [] if major == 4 else {}
        count = 0
        while (n is None and data[at] != 0xFF) or (n is not None and count < n):
            count += 1
            if count > ITEMS:
                raise ValueError("too many items")
            value, at = cbor(data, at, deep + 1)
            if major == 4:
                out.append(value)
            else:
                key = value if isinstance(value, (str, int, bytes)) else repr(value)
                out[key], at = cbor(data, at, deep + 1)
        return out, at + (n is None)
    if major == 6:
        return cbor(data, at, deep + 1)
    simple = {20: False, 21: True, 22: None, 23: None}
    if info in (25, 26, 27):
        return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[info], n.to_bytes(1 << (info - 24), "big"))[0], at
    return simple.get(info), at


def store(data: bytes) -> tuple[bytes, str]:
    """The manifest store of a file and what holds it."""
    if data[:2] == b"\xff\xd8":
        parts: dict[int, list[tuple[int, bytes]]] = {}
        for marker, body in segments(data):
            if marker == 0xEB and body[:2] == b"JP" and len(body) > 16:
                number, place = struct.unpack_from(">HI", body, 2)
                head = 8 if place == 1 else 16  # later pieces repeat the head of the box
                parts.setdefault(number, []).append((place, body[head:]))
        for pieces in parts.values():
            joined = b"".join(p for _, p in sorted(pieces, key=lambda x: x[0]))
            if b"jumd" in joined[:64]:
                return joined, "JPEG APP11"
    elif data[:4] == b"\x89PNG":
        return next((body for name, body in png_chunks(data) if name == b"caBX"), b""), "PNG caBX"
    elif data[:4] == b"RIFF":
        return next((body for name, body in chunks(data, 12, len(data), "<") if name == b"C2PA"), b""), "RIFF C2PA"
    elif data[4:8] == b"ftyp":
        for name, body in boxes(data):
            if name == b"uuid" and body[:16] == BMFF_UUID:
                at = body.find(b"jumb", 16)
                return (body[at - 4 :] if at >= 4 else b""), "ISO uuid box"
    elif data[:4] in (b"II*\0", b"MM\0*"):
        at = data.find(b"jumb")
        return (data[at - 4 :] if at >= 4 and b"jumd" in data[at : at + 16] else b""), "TIFF tag"
    elif b"<svg" in data[:4096] and (m := re.search(rb"<(?:\w+:)?manifest[^>]*>([A-Za-z0-9+/=\s]+)<", data)):
        return base64.b64decode(re.sub(rb"\s", b"", m[1]) + b"==", validate=False), "SVG metadata"
    return b"", ""


def leaves(data: bytes, deep: int = 0, manifest: int = -1, count: list[int] | None = None) -> Iterator[tuple[int, str, dict]]:
    """(manifest, label, content) of each CBOR leaf."""
    count = [0] if count is None else count
    for name, body in boxes(data):
        if name != b"jumb" or deep > DEEP:
            continue
        inner = list(boxes(body))
        head = next((b for n, b in inner if n == b"jumd"), b"")
        label = head[17:].partition(b"\0")[0].decode("utf-8", "replace") if len(head) > 17 and head[16] & 2 else ""
        own = manifest
        if label.startswith("urn:"):
            own, count[0] = count[0], count[0] + 1
        for n, b in inner:
            if n == b"cbor":
                try:
                    value, _ = cbor(b)
                except (ValueError, IndexError, TypeError, OverflowError, struct.error):
                    continue
                if isinstance(value, dict):
                    yield max(own, 0), label, value
        yield from leaves(body, deep + 1, own, count)


def bound(data: bytes, assertion: dict, inherited: object) -> str | None:
    """Whether the digest of the file without the excluded ranges is the one that the manifest says."""
    name, want, spans = assertion.get("alg") or inherited or "sha256", assertion.get("hash"), assertion.get("exclusions") or []
    if name not in DIGESTS or not isinstance(want, bytes) or not isinstance(spans, list):
        return None
    digest, at = hashlib.new(str(name)), 0
    for span in sorted(spans, key=lambda s: s.get("start", 0)):
        start, size = span.get("start"), span.get("length")
        if not isinstance(start, int) or not isinstance(size, int) or start < at or size < 0:
            return None
        digest.update(data[at:start])
        at = start + size
    digest.update(data[at:])
    return "binding matches the file" if digest.digest() == want else "binding does not match the file"


def _named(value: object) -> str | None:
    value = value[0] if isinstance(value, list) and value else value
    if isinstance(value, dict):
        return " ".join(str(value[k]) for k in ("name", "version") if value.get(k)) or None
    return value.strip() or None if isinstance(value, str) else None


def c2pa(data: bytes) -> list[Record]:
    jumbf, where = store(data)
    found = list(leaves(jumbf))
    if not found:
        return []
    last = max(m for m, _, _ in found)
    active = [(label, value) for m, label, value in found if m == last]
    claims = [v for label, v in active if label.startswith("c2pa.claim")]
    generator = next((g for v in claims if (g := _named(v.get("claim_generator_info")) or _named(v.get("claim_generator")))), None)
    steps = [s for _, v in active for s in (v.get("actions") or []) if isinstance(s, dict)]
    first = lambda key, read=_named: next((x for s in steps if (x := read(s.get(key)))), None)
    agent, uri = first("softwareAgent"), first("digitalSourceType")
    meaning = SOURCES.get((uri or "").rstrip("/").rpartition("/")[2])
    binding = next((bound(data, v, next((c.get("alg") for c in claims), None)) for label, v in active if label == "c2pa.hash.data"), None)
    fields = {"claim_generator": generator, "softwareAgent": agent, "digitalSourceType": uri if meaning else None, "actions": ", ".join(x for s in steps[:32] if (x := _named(s.get("action")))), "manifests": str(last + 1) if last else None}
    made_of = [v for label, v in active if label.split("__")[0].startswith("c2pa.ingredient")][:16]
    if made_of:
        fields["ingredients"] = str(len(made_of))
    for k, v in enumerate(made_of, 1):
        for key, name in (("title", "title"), ("dc:title", "title"), ("format", "format"), ("relationship", "relationship"), ("documentID", "documentID"), ("document_id", "documentID"), ("instanceID", "instanceID"), ("instance_id", "instanceID")):
            if isinstance(v.get(key), str):
                fields.setdefault(f"Ingredient[{k}]:{name}", v[key])
        if any(x in v for x in ("c2pa_manifest", "activeManifest", "claim_signature")):
            fields[f"Ingredient[{k}]:manifest"] = "own manifest"
    parent = next((v.get("title") or "an ingredient" for v in made_of if v.get("relationship") == "parentOf"), None)
    tool = f"{generator} ({agent})" if generator and agent and agent not in generator else generator or agent
    notes = [meaning, parent and f"derived from {parent}", f"{last + 1} manifests" if last else None, binding, "signature not verified"]
    return record("c2pa", fields, "c2pa", tool=tool, at=first("when"), note="; ".join(n for n in notes if n), location=None) if tool or made_of or meaning else []
