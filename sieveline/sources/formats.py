"""Identification of formats by a registry of signatures, in the way of PRONOM.

The registry is a parameter: the public signature file (XML), or rows of (puid, name, version, mime, extensions,
signatures, over). A signature is a list of byte sequences, each anchored at the beginning (B), at the end (E) or anywhere
(V); all must match. Sequences are hex, with ?? for any byte, {n} or {n-m} for gaps, * for any gap, (a|b) for alternatives and [a:b] or
[!a] for ranges. Formats that another match takes precedence over are left out; without any match the suffix may tell.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .readers import tree

#: Bytes of each end of a file that are looked at.
WINDOW = 64 << 10


@dataclass(frozen=True)
class Format:
    puid: str
    name: str
    version: str = ""
    mime: str = ""
    extensions: tuple[str, ...] = ()
    #: alternatives; each is a tuple of (anchor, least offset, largest offset, sequence)
    signatures: tuple[tuple[tuple[str, int, int, str], ...], ...] = ()
    over: tuple[str, ...] = ()


_TOKEN = re.compile(r"\s+|\?\?|\*|\{(\d+)(?:-(\d+|\*))?\}|\[(!?)([0-9A-Fa-f]+)(?::([0-9A-Fa-f]+))?\]|\(|\)|\||([0-9A-Fa-f]{2})|'([^']*)'")


def pattern(sequence: str) -> bytes:
    """A sequence as a regular expression over bytes; gaps are lazy, so matches end as early as they can."""
    out, at = [], 0
    while at < len(sequence):
        m = _TOKEN.match(sequence, at)
        if not m:
            raise ValueError(f"no sequence: {sequence[at:]}")
        token, at = m[0], m.end()
        if token == "??":
            out.append(b"[\\s\\S]")
        elif token == "*":
            out.append(b"[\\s\\S]*?")
        elif token[0] == "{":
            out.append(b"[\\s\\S]{%s%s}?" % (m[1].encode(), b"" if m[2] is None else b"," if m[2] == "*" else b"," + m[2].encode()))
        elif token[0] == "[":
            low, high = bytes.fromhex(m[4]), bytes.fromhex(m[5] or m[4])
            if len(low) == 1:
                out.append(b"[%s\\x%02x-\\x%02x]" % (b"^" if m[3] else b"", low[0], high[0]))
            elif m[3]:
                out.append(b"(?!%s)[\\s\\S]{%d}" % (re.escape(low), len(low)))
            else:  # of longer ranges the first byte tells
                out.append(b"[\\x%02x-\\x%02x][\\s\\S]{%d}" % (low[0], high[0], len(low) - 1))
        elif token in "()|":
            out.append({"(": b"(?:", ")": b")", "|": b"|"}[token])
        elif m[6]:
            out.append(re.escape(bytes([int(m[6], 16)])))
        elif m[7] is not None:
            out.append(re.escape(m[7].encode("latin-1")))
    return b"".join(out)


@functools.lru_cache(4096)
def _compiled(anchor: str, least: int, most: int, sequence: str) -> re.Pattern[bytes]:
    own, gap = pattern(sequence), b"[\\s\\S]{%d,%d}?" % (least, max(least, most))
    return re.compile({"B": b"\\A" + gap + b"(?:" + own + b")", "E": b"(?:" + own + b")" + gap + b"\\Z", "V": b"(?:" + own + b")"}[anchor])


def matches(signature: Sequence[tuple[str, int, int, str]], head: bytes, tail: bytes) -> bool:
    return all(_compiled(*part).search(tail if part[0] == "E" else head) is not None for part in signature)


def identify(data: bytes, suffix: str, registry: Sequence[Format]) -> list[tuple[Format, str]]:
    """(format, basis) of all formats that a file is of; basis is signature or extension."""
    head, tail = data[:WINDOW], data[-WINDOW:]
    found = {f.puid: f for f in registry if any(matches(s, head, tail) for s in f.signatures)}
    beaten = {p for f in found.values() for p in f.over}
    if found:
        return [(f, "signature") for p, f in found.items() if p not in beaten]
    return [(f, "extension") for f in registry if suffix.lower() in f.extensions and not f.signatures]


def registry(xml: bytes) -> tuple[Format, ...]:
    """The formats of a public signature file: byte sequences by reference, and priorities by internal number."""
    root = tree(xml)
    if root is None:
        raise ValueError("no signature file")
    name = lambda e: e.tag.rpartition("}")[2]
    signatures: dict[str, list[tuple[str, int, int, str]]] = {}
    for s in root.iter():
        if name(s) == "InternalSignature":
            for b in s:
                if name(b) == "ByteSequence":
                    anchor = {"BOFoffset": "B", "EOFoffset": "E"}.get(b.get("Reference", ""), "V")
                    for sub in b:
                        text = next((c.text or "" for c in sub if name(c) == "Sequence"), b.get("Sequence", ""))
                        signatures.setdefault(s.get("ID", ""), []).append((anchor, int(sub.get("SubSeqMinOffset") or 0), int(sub.get("SubSeqMaxOffset") or 0), text))
    rows = [e for e in root.iter() if name(e) == "FileFormat"]
    puids = {e.get("ID"): e.get("PUID", "") for e in rows}
    texts = lambda e, kind: tuple((c.text or "").strip() for c in e if name(c) == kind)
    return tuple(
        Format(e.get("PUID", ""), e.get("Name", ""), e.get("Version", ""), e.get("MIMEType", ""), tuple(x.lower() for x in texts(e, "Extension")), tuple(tuple(signatures[i]) for i in texts(e, "InternalSignatureID") if i in signatures), tuple(puids.get(i, "") for i in texts(e, "HasPriorityOverFileFormatID")))
        for e in rows
    )


def _identify(known: Sequence[Format], batches):
    for b in batches:
        rows = []
        for path, data in zip(b.column("path").to_pylist(), b.column("content")):  # a file at a time
            rows += [(path, f.puid, f.name, f.version, f.mime, basis) for f, basis in identify(data.as_py() or b"", path.rpartition(".")[2], known)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(6)], ["path", "puid", "name", "version", "mime", "basis"])


def formats(files: DataFrame, known: Sequence[Format]) -> DataFrame:
    """path, puid, name, version, mime and basis of the formats of every file (path, content)."""
    return files.select("path", "content").mapInArrow(functools.partial(_identify, tuple(known)), "path string, puid string, name string, version string, mime string, basis string")
