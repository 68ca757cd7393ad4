"""Trace stores: what browsers, shells, desktops, trash cans, sync clients, mails, archives and torrents know of files.

Each parser takes the bytes of one store and gives records with the file that they are about (`target`: a path or a
name). Databases are read from memory, so a store is never opened where it lies and nothing is written beside it.
"""

from __future__ import annotations

import bz2
import configparser
import datetime
import email
import email.utils
import functools
import gzip
import hashlib
import io
import json
import lzma
import plistlib
import re
import shlex
import sqlite3
import struct
import tarfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import documents
from .readers import UTC, cfb_streams, local, package, since, tree

Record = dict


def _record(target: str | None, source: str, **more) -> Record:
    return {"target": target, "source": source} | {k: v for k, v in more.items() if v not in (None, "", {})}


def _rows(data: bytes, sql: str) -> list[tuple]:
    """Rows of a query over a database in memory; none if it has other tables or is broken."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(data)
        return db.execute(sql).fetchall()
    except (sqlite3.Error, OverflowError, ValueError):
        return []
    finally:
        db.close()


# Schemas of browser stores; browsers by the folder of their profile.
BROWSERS = (("brave", "brave"), ("vivaldi", "vivaldi"), ("opera", "opera"), ("edge", "edge"), ("chromium", "chromium"), ("chrome", "chrome"), ("firefox", "firefox"))


def browser(path: str) -> str:
    low = path.lower()
    return next((name for part, name in BROWSERS if part in low), "chromium")


def chromium(data: bytes, path: str = "") -> Iterator[Record]:
    """Downloads with the last address of their chain; times are microseconds since 1601."""
    chains = dict(_rows(data, "SELECT id, url FROM downloads_url_chains ORDER BY chain_index"))
    for key, target, tab, referrer, start, size, state in _rows(data, "SELECT id, target_path, tab_url, referrer, start_time, total_bytes, state FROM downloads"):
        if target:
            yield _record(target, "browser-download", url=chains.get(key) or tab, referrer=referrer, tool=browser(path), at=since((start or 0) / 1e6, 1601), bytes=size, note=None if state == 1 else f"download state {state}")


def firefox(data: bytes, path: str = "") -> Iterator[Record]:
    """Downloads are annotations of places: a file address, and a JSON text with the size."""
    sql = """SELECT a.place_id, n.name, a.content, p.url, a.dateAdded FROM moz_annos a JOIN moz_anno_attributes n ON n.id = a.anno_attribute_id JOIN moz_places p ON p.id = a.place_id
      WHERE n.name IN ('downloads/destinationFileURI', 'downloads/metaData')"""
    rows = _rows(data, sql)
    sizes = {}
    for place, name, content, _, _ in rows:
        if name.endswith("metaData"):
            try:
                sizes[place] = json.loads(content).get("fileSize")
            except (ValueError, AttributeError, TypeError):
                continue
    for place, name, content, url, added in rows:
        if name.endswith("URI") and (content or "").startswith("file://") and (target := unquote(urlsplit(content).path)):
            yield _record(target, "browser-download", url=url, tool="firefox", at=since((added or 0) / 1e6, 1970), bytes=sizes.get(place))


def quarantine(data: bytes, path: str = "") -> Iterator[Record]:
    """Events of the quarantine store: id, agent, addresses; seconds since 2001. The name is the last part of the address."""
    for key, when, agent, url, origin in _rows(data, "SELECT LSQuarantineEventIdentifier, LSQuarantineTimeStamp, LSQuarantineAgentName, LSQuarantineDataURLString, LSQuarantineOriginURLString FROM LSQuarantineEvent"):
        yield _record(unquote(urlsplit(url or "").path.rpartition("/")[2]) or None, "macos-quarantine", url=url, referrer=origin, tool=agent, at=since(when or 0, 2001), fields={"id": key or ""})


def shell(data: bytes, path: str = "") -> Iterator[Record]:
    """Commands of bash (#stamp before a line), zsh (: stamp:seconds;command) and fish (- cmd: and when:)."""
    text, found, stamp = data.decode("utf-8", "replace"), [], None
    for line in text.splitlines():
        if path.endswith("fish_history"):
            if line.startswith("- cmd: "):
                found.append([None, line[7:].strip()])
            elif (m := re.match(r"\s*when: (\d+)", line)) and found:
                found[-1][0] = int(m[1])
        elif m := re.match(r": (\d{9,11}):\d+;(.*)", line):
            found.append([int(m[1]), m[2].strip()])
        elif m := re.fullmatch(r"#(\d{9,11})", line.strip()):
            stamp = int(m[1])
        elif line.strip():
            found.append([stamp, line.strip()])
            stamp = None
    for when, command in found:
        tool, words = command_words(command)
        yield _record(None, "shell-history", command=command, tool=tool, at=since(when or 0, 1970), url=next((w for w in words if "://" in w), None), fields={"words": "\n".join(words)})


def command_words(command: str) -> tuple[str, list[str]]:
    """The program of a command (behind sudo and settings), and its words."""
    try:
        words = shlex.split(command)
    except ValueError:
        words = command.split()
    rest = [w for w in words if w not in ("sudo", "env", "nohup", "time") and not re.match(r"[A-Za-z_]\w*=", w)]
    return (rest[0].rpartition("/")[2] if rest else ""), words


def recent(data: bytes, path: str = "") -> Iterator[Record]:
    """Bookmarks of recently used files: address, last visit, the application that opened them."""
    root = tree(data)
    for e in root.iter() if root is not None else ():
        href = e.get("href") or ""
        if local(e.tag) == "bookmark" and href.startswith("file://"):
            apps = [a.get("name") for a in e.iter() if local(a.tag) == "application" and a.get("name")]
            when = e.get("visited") or e.get("modified") or e.get("added") or ""
            yield _record(unquote(urlsplit(href).path), "recent-documents", tool=apps[-1] if apps else None, at=when[:19] + "Z" if re.match(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", when) else None)


def trash(data: bytes, path: str = "") -> Iterator[Record]:
    """Where a file in the trash was, and when it was thrown away; the file is beside the info folder."""
    said = dict(x.partition("=")[::2] for x in data.decode("utf-8", "replace").splitlines() if "=" in x)
    base, _, name = path.rpartition("/info/")
    original = unquote(said.get("Path", ""))
    if original and not original.startswith("/"):
        top = re.sub(r"/\.Trash(?:-\d+|/\d+)$", "", base)
        original = f"{top}/{original}"
    when = said.get("DeletionDate", "")
    if original or when:
        yield _record(f"{base}/files/{name.removesuffix('.trashinfo')}", "freedesktop-trash", at=when + "Z" if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", when) else None, fields={"Path": original, "DeletionDate": when})


def zone(data: bytes, path: str = "") -> Iterator[Record]:
    """The zone stream that Windows keeps beside a downloaded file."""
    said = dict(x.strip().partition("=")[::2] for x in documents.decoded(data).splitlines() if "=" in x)
    if said.get("HostUrl") or said.get("ReferrerUrl") or said.get("ZoneId"):
        yield _record(re.sub(r":Zone\.Identifier$", "", path), "windows-zone-identifier", url=said.get("HostUrl"), referrer=said.get("ReferrerUrl"), fields={"ZoneId": said.get("ZoneId", "")})


def where_froms(data: bytes, path: str = "") -> Iterator[Record]:
    """The addresses that macOS keeps with a file, as a property list."""
    try:
        said = [x for x in plistlib.loads(data) if isinstance(x, str)]
    except (ValueError, TypeError, plistlib.InvalidFileException, OverflowError, struct.error):
        return
    if said:
        yield _record(path, "macos-wherefroms", url=said[0], referrer=said[1] if len(said) > 1 else None)


def quarantine_attribute(value: str) -> dict[str, str]:
    """flags;hex seconds;agent;id of a quarantine attribute."""
    parts = (value.split(";") + [""] * 4)[:4]
    return {"flags": parts[0], "at": since(int(parts[1], 16), 1970) or "" if re.fullmatch(r"[0-9a-fA-F]{1,8}", parts[1]) else "", "agent": parts[2], "id": parts[3]}


def sidecar(data: bytes, path: str = "") -> Iterator[Record]:
    """What a video downloader wrote beside the video: <stem>.info.json."""
    try:
        said = json.loads(data)
    except (ValueError, RecursionError):
        return
    if isinstance(said, dict) and (url := next((said[k] for k in ("webpage_url", "original_url", "url") if isinstance(said.get(k), str)), None)):
        epoch = said.get("epoch")
        yield _record(path.removesuffix(".info.json"), "ytdlp-sidecar", url=url, tool="yt-dlp", at=since(epoch, 1970) if isinstance(epoch, (int, float)) else None, fields={k: str(said[k]) for k in ("title", "uploader", "extractor", "id", "upload_date") if said.get(k)})


def sync_roots(data: bytes, path: str = "") -> Iterator[Record]:
    """Folders of Nextcloud (INI), Dropbox (JSON) and Syncthing (XML)."""
    text = documents.decoded(data)
    roots: list[tuple[str, str]] = []
    if path.endswith("nextcloud.cfg"):
        ini = configparser.ConfigParser(interpolation=None, strict=False)
        try:
            ini.read_string(text)
            roots = [("Nextcloud", v) for s in ini.sections() for k, v in ini.items(s) if k.endswith("localpath")]
        except configparser.Error:
            return
    elif path.endswith("info.json"):
        try:
            roots = [("Dropbox", v["path"]) for v in json.loads(text).values() if isinstance(v, dict) and v.get("path")]
        except (ValueError, AttributeError):
            return
    else:
        root = tree(data)
        roots = [("Syncthing", e.get("path")) for e in (root.iter() if root is not None else ()) if local(e.tag) == "folder" and e.get("path")]
    yield from (_record(where.rstrip("/"), "sync-folder", tool=tool) for tool, where in roots)


# torrents


def bdecode(data: bytes, at: int = 0, deep: int = 0) -> tuple[object, int]:
    """A value of bencode and where it ends. Dictionaries also keep the span of each value under (key,)."""
    kind = data[at : at + 1]
    if deep > 64:
        raise ValueError("too deep")
    if kind == b"i":
        end = data.index(b"e", at)
        return int(data[at + 1 : end]), end + 1
    if kind in (b"l", b"d"):
        out: dict | list = {} if kind == b"d" else []
        at += 1
        while data[at : at + 1] != b"e":
            if at >= len(data):
                raise ValueError("no end")
            value, end = bdecode(data, at, deep + 1)
            if kind == b"d":
                begin = end
                key = value
                value, end = bdecode(data, begin, deep + 1)
                out[key], out[(key,)] = value, (begin, end)
            else:
                out.append(value)
            at = end
        return out, at + 1
    colon = data.index(b":", at)
    n = int(data[at:colon])
    if n < 0 or colon + 1 + n > len(data):
        raise ValueError("no such length")
    return data[colon + 1 : colon + 1 + n], colon + 1 + n


def torrent(data: bytes, path: str = "") -> Iterator[Record]:
    """One record for each file that a torrent lists, with its size, the trackers and the magnet address."""
    try:
        top, _ = bdecode(data)
        info = top[b"info"]
        begin, end = top[(b"info",)]
    except (ValueError, KeyError, TypeError, IndexError, RecursionError):
        return
    text = lambda x: x.decode("utf-8", "replace") if isinstance(x, bytes) else ""
    trackers = [text(top.get(b"announce"))] + [text(t) for tier in top.get(b"announce-list") or () if isinstance(tier, list) for t in tier]
    magnet = f"magnet:?xt=urn:btih:{hashlib.sha1(data[begin:end]).hexdigest()}"
    made = top.get(b"creation date")
    files = [("/".join(map(text, f.get(b"path") or ())), f.get(b"length")) for f in info.get(b"files") or () if isinstance(f, dict)] or [(text(info.get(b"name")), info.get(b"length"))]
    for name, size in files:
        yield _record(name.rpartition("/")[2], "torrent", url=magnet, tool=text(top.get(b"created by")), at=since(made, 1970) if isinstance(made, int) else None, bytes=size if isinstance(size, int) else None, fields={"container": path, "trackers": " ".join(dict.fromkeys(t for t in trackers if t))})


# shortcuts


def shortcut(data: bytes, path: str = "") -> Iterator[Record]:
    """A Windows shell link: local path, size and times of its target, volume and machine."""
    if len(data) < 76 or struct.unpack_from("<I", data)[0] != 76:
        return
    flags = struct.unpack_from("<I", data, 20)[0]
    written, size = struct.unpack_from("<Q", data, 44)[0], struct.unpack_from("<I", data, 52)[0]
    at, fields = 76, {}
    try:
        if flags & 1:
            at += 2 + struct.unpack_from("<H", data, at)[0]
        if flags & 2:
            whole, _, kind, volume, base = struct.unpack_from("<5I", data, at)
            if kind & 1:
                fields["OpenedFrom"] = data[at + base : data.index(b"\0", at + base)].decode("cp1252", "replace")
                fields["VolumeSerial"] = f"{struct.unpack_from('<I', data, at + volume + 8)[0]:08X}"
            at += whole
        if (m := data.find(b"\x60\0\0\0\x03\0\0\xa0")) >= 0:
            fields["MachineID"] = data[m + 16 : m + 32].partition(b"\0")[0].decode("latin-1")
    except (struct.error, ValueError):
        pass
    name = re.split(r"[\\/]", fields.get("OpenedFrom", ""))[-1] or re.split(r"[\\/]", path)[-1].removesuffix(".lnk")
    yield _record(name, "windows-recent", at=since(written / 1e7, 1601), bytes=size, fields=fields)


# mail

# Headers by which a message describes itself, and the parts of a hop.
HEADERS = ("From", "To", "Cc", "Subject", "Date", "Message-ID", "In-Reply-To", "References", "Reply-To", "Sender", "User-Agent", "X-Mailer", "X-Originating-IP")
HOP = (("From", r"\bfrom\s+(\S+)"), ("By", r"\bby\s+(\S+)"), ("With", r"\bwith\s+(\S+)"), ("Id", r"\bid\s+([^\s;]+)"), ("For", r"\bfor\s+<?([^\s;>]+)"), ("ConnectingAddress", r"\[(?:IPv6:)?([0-9A-Fa-f.:]+)\]"))


def _date(text: str) -> str | None:
    try:
        when = email.utils.parsedate_to_datetime(text.strip())
    except (TypeError, ValueError, IndexError, OverflowError):
        return None
    return (when if when.tzinfo else when.replace(tzinfo=UTC)).astimezone(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def mail(data: bytes, path: str = "") -> Iterator[Record]:
    """The hops of a message, the last one as its delivery, and what it says of itself."""
    message = email.message_from_bytes(data)
    for k, hop in enumerate((message.get_all("Received") or [])[:40]):
        said = " ".join(str(hop).split())
        fields = {name: m[1] for name, pattern in HOP if (m := re.search(pattern, said))}
        if fields:
            yield _record(path, "email-relay" if k else "email-delivery", tool=fields.get("By"), at=_date(said.rpartition(";")[2]), fields=fields)
    own = {h: " ".join(str(message[h]).split()) for h in HEADERS if message[h]}
    if own:
        yield _record(path, "email-header", tool=own.get("User-Agent") or own.get("X-Mailer"), at=_date(own.get("Date", "")), fields=own)


# archives

#: Members of an archive that are listed, that are read, and bytes of one.
LISTED, READ, MEMBER = 50_000, 25, 64 << 20


def members(data: bytes, path: str = "") -> Iterator[tuple[str, int, str | None, bytes | None]]:
    """(name, size, time, content) of the files in a zip, tar or compressed file; content of the first ones up to a size."""
    n = 0
    if (archive := package(data)) is not None:
        for i in archive.infolist()[:LISTED]:
            if not i.is_dir():
                n += 1
                try:
                    body = archive.read(i) if n <= READ and i.file_size <= MEMBER else None
                except (RuntimeError, NotImplementedError, ValueError, OSError, zlib.error, EOFError):
                    body = None
                yield i.filename, i.file_size, "{:04d}-{:02d}-{:02d}T{:02d}:{:02d}:{:02d}Z".format(*i.date_time), body
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            for i in tar:
                if i.isfile() and n < LISTED:
                    n += 1
                    yield i.name, i.size, since(i.mtime, 1970), (tar.extractfile(i).read() if n <= READ and i.size <= MEMBER else None)
            return
    except (tarfile.TarError, OSError, EOFError, ValueError, zlib.error, lzma.LZMAError):
        if n:
            return
    for mark, opened in ((b"\x1f\x8b", gzip.open), (b"BZh", bz2.open), (b"\xfd7zXZ", lzma.open)):
        if data.startswith(mark):
            try:
                body = opened(io.BytesIO(data)).read(MEMBER)
            except (OSError, EOFError, zlib.error, lzma.LZMAError):
                return
            yield re.sub(r"\.(?:gz|bz2|xz)$", "", path.rpartition("/")[2]), len(body), None, body


def packager(raw: bytes) -> tuple[str, bytes] | None:
    """Name and content of an object that was packed into a document: sizes, a label, two paths, the bytes."""
    label, _, rest = raw[6:].partition(b"\0")
    _, _, rest = rest.partition(b"\0")
    if len(rest) < 8:
        return None
    skip = 8 + int.from_bytes(rest[4:8], "little")
    size = int.from_bytes(rest[skip : skip + 4], "little")
    body = rest[skip + 4 : skip + 4 + size]
    return (re.split(r"[\\/]", label.decode("cp1252", "replace"))[-1], body) if len(body) == size else None


def children(data: bytes, path: str = "") -> Iterator[tuple[str, bytes]]:
    """(name, content) of the files that a mail, a compound message or a package carries; names that repeat are numbered."""
    low, found = path.lower(), []
    if low.endswith(".eml"):
        found = [(p.get_filename(), p.get_payload(decode=True) or b"") for p in email.message_from_bytes(data).walk() if p.get_filename()]
    elif low.endswith(".msg"):
        streams = cfb_streams(data)
        for base in sorted({k.rpartition("/")[0] for k in streams if k.startswith("__attach_version1.0_")}):
            name = next((streams[f"{base}/{s}"].decode("utf-16-le", "replace").strip("\0") for s in ("__substg1.0_3707001F", "__substg1.0_3704001F") if f"{base}/{s}" in streams), None)
            found.append((name, streams.get(f"{base}/__substg1.0_37010102", b"")))
    elif low.endswith(".pdf"):
        found = list(documents.pdf_attachments(data))
    elif low.endswith((".doc", ".xls", ".ppt")):
        found = [packed for k, raw in sorted(cfb_streams(data).items()) if k.endswith("\x01Ole10Native") and (packed := packager(raw))]
    elif low.endswith((".docx", ".xlsx", ".pptx", ".docm", ".xlsm", ".pptm")):
        found = [(n, b) for n, _, _, b in members(data, path) if "/embeddings/" in n or "/media/" in n]
    taken: set[str] = set()
    for name, body in found:
        own = base = re.split(r"[\\/]", name or "attachment")[-1]
        k = 1
        while own in taken:
            k += 1
            stem, dot, ending = base.rpartition(".")
            own = f"{stem} ({k}){dot}{ending}" if dot else f"{base} ({k})"
        taken.add(own)
        yield own, body or b""


# names


def messenger(name: Column) -> Column:
    """STRUCT<tool, kind, dated> of the names that messengers give to what they save; null for others and for no real day."""
    whatsapp, telegram = r"(?i)^(IMG|VID|AUD|PTT|DOC|STK)-(\d{8})-WA\d{4}", r"(?i)^(photo|video|audio|file|document|sticker)_(\d{4}-\d{2}-\d{2})_(\d{2}-\d{2}-\d{2})"
    day = F.when(name.rlike(whatsapp), F.regexp_extract(name, whatsapp, 2)).otherwise(F.regexp_replace(F.regexp_extract(name, telegram, 2), "-", ""))
    dated = F.date_format(F.try_to_timestamp(day, F.lit("yyyyMMdd")), "yyyy-MM-dd")
    kind = F.lower(F.coalesce(F.nullif(F.regexp_extract(name, whatsapp, 1), F.lit("")), F.regexp_extract(name, telegram, 1)))
    return F.when(dated.isNotNull(), F.struct(F.when(name.rlike(whatsapp), "WhatsApp").otherwise("Telegram").alias("tool"), kind.alias("kind"), dated.alias("dated")))


def history_matches(files: DataFrame, commands: DataFrame, least: int = 6) -> DataFrame:
    """path and command: files (path, name) whose name a command (command, fields.words) has as a word, as the last part of
    one, or anywhere, if the name is long enough and has a dot.

    Words and their last parts meet names by an equi-join. The rest meets by the trigram that each name has first of all its
    trigrams in order of rarity among names, and is compared as a whole.
    """
    word = commands.select("command", F.explode(F.split(F.col("fields")["words"], "\n")).alias("w"))
    exact = word.select("command", F.explode(F.array_distinct(F.array("w", F.regexp_extract("w", r"([^/]*)/*$", 1)))).alias("name"))
    own = files.select("path", "name")
    met = own.join(exact, "name").select("path", "command")
    long_ = own.where((F.length("name") >= least) & F.col("name").contains("."))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    named = long_.select("name").distinct().select("name", F.explode(grams(F.col("name"))).alias("g"))
    rare = named.join(named.groupBy("g").agg(F.count("*").alias("n")), "g").groupBy("name").agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    said = commands.where(F.length("command") >= least).select("command").distinct().select("command", F.explode(grams(F.col("command"))).alias("g"))
    inside = said.join(rare, "g").where(F.col("command").contains(F.col("name"))).select("name", "command")
    return met.unionByName(long_.join(inside, "name").select("path", "command")).distinct()


# Stores by the ends of their paths.
STORES = (
    (r"(?i)/History$", chromium), (r"(?i)/places\.sqlite$", firefox), (r"(?i)QuarantineEventsV2$", quarantine), (r"(?i)(?:\.(?:bash|zsh)_history|/\.?(?:histfile|zhistory)|fish_history)$", shell), (r"(?i)recently-used\.xbel$", recent),
    (r"(?i)\.trashinfo$", trash), (r"(?i):Zone\.Identifier$", zone), (r"(?i)\.info\.json$", sidecar), (r"(?i)(?:nextcloud\.cfg|[.]?dropbox/info\.json|syncthing/config\.xml)$", sync_roots), (r"(?i)\.torrent$", torrent), (r"(?i)\.lnk$", shortcut),
    (r"(?i)\.eml$", mail),
)

_TEXTS = ("target", "source", "url", "referrer", "tool", "at", "command", "note")
_SCHEMA = "store string, seq long, target string, source string, url string, referrer string, tool string, at string, command string, note string, bytes long, fields map<string,string>"


def parse(path: str, data: bytes) -> list[Record]:
    """Records of one store by its path; a broken one gives none."""
    for pattern, parser in reversed(STORES) if path.endswith("dropbox/info.json") else STORES:
        if re.search(pattern, path):
            try:
                return list(parser(data, path))
            except (struct.error, ValueError, LookupError, AttributeError, TypeError, RecursionError, OverflowError):
                return []
    return []


def _parse(batches):
    for b in batches:
        for path, data in zip(b.column("path").to_pylist(), b.column("content")):  # a store at a time
            found = parse(path, data.as_py() or b"")
            if found:
                maps = pa.array([[(k, str(v)) for k, v in (r.get("fields") or {}).items() if v] for r in found], pa.map_(pa.string(), pa.string()))
                sizes = pa.array([r.get("bytes") if isinstance(r.get("bytes"), int) and abs(r["bytes"]) < 1 << 62 else None for r in found], pa.int64())
                texts = [pa.array([None if r.get(k) is None else str(r[k]) for r in found], pa.string()) for k in _TEXTS]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(range(len(found)), pa.int64()), *texts, sizes, maps], ["store", "seq", *_TEXTS, "bytes", "fields"])


def traces(files: DataFrame) -> DataFrame:
    """store, seq and record of every known store among files (path, content)."""
    known = functools.reduce(lambda a, b: a | b, [F.col("path").rlike(p) for p, _ in STORES])
    return files.where(known).select("path", "content").mapInArrow(_parse, _SCHEMA)


def _members(carried: bool, batches):
    for b in batches:
        for path, data in zip(b.column("path").to_pylist(), b.column("content")):
            rows = [(n, len(c), None, c) for n, c in children(data.as_py() or b"", path)] if carried else list(members(data.as_py() or b"", path))
            for n, size, at, body in rows:  # a member at a time
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([n.rpartition("/")[2]]), pa.array([size], pa.int64()), pa.array([at], pa.string()), pa.array([body], pa.binary())], ["container", "member", "name", "size", "at", "content"])


_MEMBERS = "container string, member string, name string, size long, at string, content binary"


def archive_members(files: DataFrame) -> DataFrame:
    """container, member, name, size, at and content of the files in every archive (path, content)."""
    return files.where(F.col("path").rlike(r"(?i)\.(?:zip|jar|tar|tgz|gz|bz2|xz)$")).select("path", "content").mapInArrow(functools.partial(_members, False), _MEMBERS)


def carried_files(files: DataFrame) -> DataFrame:
    """The same of what mails, messages and packages carry."""
    return files.where(F.col("path").rlike(r"(?i)\.(?:eml|msg|pdf|doc|xls|ppt|docx|xlsx|pptx|docm|xlsm|pptm)$")).select("path", "content").mapInArrow(functools.partial(_members, True), _MEMBERS)
