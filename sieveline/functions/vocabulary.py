"""Vocabularies of evidence records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category, presentation priority of each evidence source.
SOURCES = {
    "browser-download": ("origin", 90), "windows-zone-identifier": ("origin", 85), "macos-wherefroms": ("origin", 85), "macos-quarantine": ("origin", 85), "xdg-xattr": ("origin", 80),
    "email-delivery": ("origin", 78), "ytdlp-sidecar": ("origin", 75), "archive-member": ("origin", 70), "embedded-file": ("origin", 70), "torrent": ("origin", 70), "c2pa": ("metadata", 60),
    "device-metadata": ("metadata", 55), "xmp": ("metadata", 52), "xmp-history": ("metadata", 52), "iptc": ("metadata", 51), "document-metadata": ("metadata", 50), "email-relay": ("metadata", 45),
    "freedesktop-trash": ("activity", 45), "shell-history": ("origin", 40), "sync-folder": ("activity", 38), "windows-recent": ("activity", 36), "recent-documents": ("activity", 35),
    "email-header": ("metadata", 30), "messenger-name": ("origin", 25), "file-signature": ("metadata", 20), "filesystem": ("activity", 10),
}
# How a record of each source is tied to its file, unless it says so itself.
MATCHES = {
    "browser-download": "recorded-path", "windows-zone-identifier": "file-attribute", "macos-wherefroms": "file-attribute", "macos-quarantine": "filename", "xdg-xattr": "file-attribute", "ytdlp-sidecar": "sidecar",
    "email-delivery": "embedded", "email-relay": "embedded", "email-header": "embedded", "archive-member": "container-member", "embedded-file": "container-member", "torrent": "name+size", "messenger-name": "filename",
    "shell-history": "filename", "c2pa": "embedded", "device-metadata": "embedded", "xmp": "embedded", "xmp-history": "embedded", "iptc": "embedded", "document-metadata": "embedded", "file-signature": "embedded",
    "recent-documents": "recorded-path", "windows-recent": "name+size", "sync-folder": "sync-root", "freedesktop-trash": "sidecar", "filesystem": "file-attribute",
}
# Tools of a shell that fetch a file; a shell record of another tool is activity.
FETCH_TOOLS = ("curl", "wget", "aria2c", "scp", "rsync", "git", "yt-dlp", "youtube-dl")
# Suffixes of the file families that tables of documents and pages need, in order of precedence.
FAMILIES = {
    "image": tuple("jpg jpeg jpe jfif png gif tif tiff dng nef cr2 arw webp heic heif avif svg psd psb bmp".split()), "video": tuple("mp4 m4v mov 3gp 3g2 mkv mks avi webm ogv".split()), "audio": tuple("mp3 wav bwf flac ogg oga opus aif aiff aifc ape wv mpc m4a m4b mka".split()),
    "mail": ("eml", "msg", "mbox"), "document": tuple("pdf doc docx docm dotx xls xlsx xlsm ppt pptx pptm odt ods odp odg epub rtf ipynb msg".split()), "archive": tuple("zip tar gz tgz bz2 tbz2 xz txz zst 7z rar jar".split()),
    "text": tuple("txt md csv tsv html htm xhtml xml json yaml yml log gpx kml geojson ini toml".split()), "executable": tuple("exe dll sys scr ocx cpl".split()), "font": tuple("ttf otf ttc woff".split()),
}
ALIASES = {"jpg": "jpeg", "jpe": "jpeg", "tif": "tiff", "yml": "yaml", "htm": "html"}


def _lookup(key: Column, table: dict, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), key), F.lit(default))


def category(source: Column, tool: Column | None = None) -> Column:
    """origin, metadata or activity; shell history is an origin only for tools that fetch."""
    found = _lookup(source, {k: v[0] for k, v in SOURCES.items()}, None)
    return found if tool is None else F.when((source == "shell-history") & ~F.coalesce(tool.isin(*FETCH_TOOLS), F.lit(False)), "activity").otherwise(found)


def priority(source: Column) -> Column:
    return _lookup(source, {k: v[1] for k, v in SOURCES.items()}, 0)


def default_match(source: Column) -> Column:
    return _lookup(source, MATCHES, "recorded-path")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([A-Za-z0-9]+)$", 1))


def format_name(path: Column) -> Column:
    """Upper-case name of the format: compound suffixes whole, spellings folded."""
    compound = F.upper(F.regexp_extract(F.lower(path), r"\.(tar\.(?:gz|bz2|xz|zst))$", 1))
    own = suffix(path)
    return F.when(compound != "", compound).when(own == "", "(none)").otherwise(F.upper(F.coalesce(_lookup(own, ALIASES, None), own)))


def family(path: Column) -> Column:
    """The first family, by precedence, that has the suffix; else other."""
    own, out = suffix(path), None
    for name, members in FAMILIES.items():
        out = F.when(own.isin(*members), name) if out is None else out.when(own.isin(*members), name)
    return out.otherwise("other")


def selection(families: list[str] | None, extensions: list[str] | None) -> set[str] | None:
    """Suffixes of families and extensions together; None selects everything; an unknown family is an error."""
    if not families and not extensions:
        return None
    if unknown := [f for f in families or [] if f not in FAMILIES]:
        raise ValueError(f"unknown family: {', '.join(unknown)}")
    return {s for f in families or [] for s in FAMILIES[f]} | {e.lower().lstrip(".") for e in extensions or []}
