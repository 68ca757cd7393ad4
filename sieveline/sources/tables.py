"""The driver's tables as files, evidence and passages; other folders of files by the binaryFile source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import markup

#: The source that each type of event stands for.
EVENTS = {"purchase": "browser-download", "signup": "document-metadata", "click": "shell-history", "view": "recent-documents", "error": "filesystem"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, name, suffix, size and sha256 of every document and page."""
    part = lambda name, key, text, suffix: table(spark, sf_dir, name).select(
        F.concat(F.lit(f"{name}/"), F.col(key).cast("string"), F.lit(suffix)).alias("path"), F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("name"), F.lit(suffix[1:]).alias("suffix"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"), F.sha2(F.col(text).cast("binary"), 256).alias("sha256"),
    )
    return part("documents", "doc_id", "text", ".txt").unionByName(part("pages", "page_id", "html", ".html"))


def passages(spark: SparkSession, sf_dir: str, cut: bool = False) -> DataFrame:
    """path, seq and text of every line of every document, of url, texts and links of every page, and of every turn of a conversation. cut: as markup.passages() says."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.posexplode(F.concat(F.array("url"), markup.passages(F.col("html"), cut))).alias("seq", "text"))
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conversations/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").cast("int").alias("seq"), "text")
    return docs.unionByName(pages).unionByName(turns).where("text <> ''")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, seq, source and at of every event: what happened to the file of a user."""
    source = F.element_at(F.create_map(*[x for k, v in EVENTS.items() for x in (F.lit(k), F.lit(v))]), F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("seq"), source.alias("source"), F.col("ts").alias("at"), "value")


# Folders that hold tools' own files, which nobody brought there.
SKIPPED = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "target", "dist", "build", ".cache")


def folder(spark: SparkSession, path: str, suffixes: set[str] | None = None, content: bool = True, skip: bool = True) -> DataFrame:
    """path, size, mtime (and content, sha256) of the files of a folder; suffixes are pruned before a file is opened, files that vanish are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    if suffixes:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(sorted(suffixes)) + "}")
    own = reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content", F.sha2("content", 256).alias("sha256")] if content else []))
    return own.where(~skipped(F.col("path"))) if skip else own


def skipped(path: Column) -> Column:
    """Whether a file is in a folder of SKIPPED, or in one whose name ends with .repro."""
    return path.rlike("/(?:" + "|".join(n.replace(".", r"\.") for n in SKIPPED) + r"|[^/]*\.repro)/")


# First bytes of formats (offset and hex, all of which must be there) and the suffixes that carry them.
MARKS = (
    ("JPEG", ((0, "ffd8ff"),)), ("PNG", ((0, "89504e470d0a1a0a"),)), ("GIF", ((0, "47494638"),)), ("TIFF", ((0, "49492a00"),)), ("TIFF", ((0, "4d4d002a"),)), ("WebP", ((0, "52494646"), (8, "57454250"))), ("WAV", ((0, "52494646"), (8, "57415645"))),
    ("AVI", ((0, "52494646"), (8, "41564920"))), ("PDF", ((0, "255044462d"),)), ("RTF", ((0, "7b5c727466"),)), ("ZIP", ((0, "504b0304"),)), ("ZIP", ((0, "504b0506"),)), ("ZIP", ((0, "504b0708"),)), ("gzip", ((0, "1f8b"),)), ("bzip2", ((0, "425a68"),)),
    ("XZ", ((0, "fd377a585a00"),)), ("Zstandard", ((0, "28b52ffd"),)), ("7-Zip", ((0, "377abcaf271c"),)), ("RAR", ((0, "526172211a07"),)), ("OLE compound file", ((0, "d0cf11e0a1b11ae1"),)), ("ISO base media (MP4, MOV, HEIC)", ((4, "66747970"),)),
    ("Matroska (MKV, WebM)", ((0, "1a45dfa3"),)), ("Ogg", ((0, "4f676753"),)), ("FLAC", ((0, "664c6143"),)), ("MP3", ((0, "494433"),)), ("SQLite database", ((0, "53514c69746520666f726d6174203300"),)), ("ELF binary", ((0, "7f454c46"),)),
    ("Windows executable", ((0, "4d5a"),)), ("Mach-O binary", ((0, "cffaedfe"),)), ("Mach-O binary", ((0, "cefaedfe"),)), ("Mach-O binary", ((0, "feedfacf"),)), ("Mach-O binary", ((0, "feedface"),)), ("tar", ((257, "7573746172"),)),
)
CARRIED_BY = {
    "JPEG": "jpg jpeg jpe jfif", "PNG": "png", "GIF": "gif", "TIFF": "tif tiff", "WebP": "webp", "PDF": "pdf", "RTF": "rtf", "ZIP": "zip docx docm xlsx xlsm pptx pptm odt ods odp odg epub jar apk kmz xpi", "gzip": "gz tgz svgz", "bzip2": "bz2 tbz2",
    "XZ": "xz txz", "Zstandard": "zst tzst", "7-Zip": "7z", "RAR": "rar", "tar": "tar", "OLE compound file": "doc xls ppt msg msi", "ISO base media (MP4, MOV, HEIC)": "mp4 m4a m4b m4v mov 3gp 3g2 heic heif avif", "Matroska (MKV, WebM)": "mkv mka mks webm",
    "Ogg": "ogg oga ogv opus", "FLAC": "flac", "MP3": "mp3", "WAV": "wav", "AVI": "avi", "SQLite database": "sqlite sqlite3", "ELF binary": "so elf ko", "Windows executable": "exe dll sys scr ocx cpl", "Mach-O binary": "dylib bundle",
    "HTML": "html htm xhtml", "SVG": "svg", "XML": "xml svg xhtml html htm rss atom plist",
}


def signature(head: Column) -> Column:
    """The format that the first 512 bytes of a file show, null if none does."""
    hexed = F.lower(F.hex(head))
    out = F.lit(None).cast("string")
    for name, marks in reversed(MARKS):
        hit = F.lit(True)
        for at, mark in marks:
            hit = hit & (F.substring(hexed, 2 * at + 1, len(mark)) == mark)
        out = F.when(hit, name).otherwise(out)
    text = F.lower(F.ltrim(F.decode(F.regexp_replace(F.decode(head, "ISO-8859-1"), "^\u00ef\u00bb\u00bf", "").cast("binary"), "UTF-8")))
    written = F.when(text.rlike(r"^(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*)*<svg[\s>]"), "SVG").when(text.rlike(r"^<(?:!doctype html|html[\s>])"), "HTML").when(text.startswith("<?xml"), "XML")
    return F.coalesce(out, written)


def misnamed(found: DataFrame) -> DataFrame:
    """path, suffix and format of files whose first bytes say another format than their name."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    shown = found.select("path", suffix.alias("suffix"), signature(F.substring("content", 1, 512)).alias("format"))
    known = sorted({s for v in CARRIED_BY.values() for s in v.split()})
    fits = F.element_at(F.create_map(*[x for k, v in CARRIED_BY.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))]), F.col("format"))
    return shown.where(F.col("format").isNotNull() & F.col("suffix").isin(*known) & ~F.array_contains(fits, F.col("suffix")))
