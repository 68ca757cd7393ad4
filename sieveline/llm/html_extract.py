"""Main text of web pages by consensus host paths.

First pass: each page's containers are scored by the text they hold, without that of links, and the page votes for
the generalised tag-class path of its best one (numbers and positions left out). Votes are counted per host in Spark,
and so is the evidence on containers that look like boxes around a text: on how many pages they stand, how much of
their text is in links, how often they repeat one text, what share of the page they hold. Second pass: each page is
extracted again from the containers on its host's winning path, without the boxes; a page without such a container
uses its own best one.

A box is what the evidence says: a class or an id made of nothing but box words counts 1, links and repetition over the host's
pages half each; text of its own on all pages, much of it and without links, counts against it. A box word next to any other
word says nothing, and no word alone removes a container that holds most of a page.

Defined results: null and empty pages, and pages without text, give an empty text; a url without a host shares
the empty host; pages of any length and depth and broken markup are read to their end; repeated rows get equal results and
vote once for each row; equal votes go to one path by its hash; other columns never matter.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_MB, cut, frees, unit_hash

# Element names of HTML and words that sites use for what is around a text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
AROUND = frozenset("nav header footer aside form menu button select dialog svg canvas object audio video head datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of boxes around a text, and words that may stand next to them in the name of a box.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense advertising sponsor sponsored promo promotion promoted nav navbar navigation menu menus submenu breadcrumb breadcrumbs footer header masthead "
    "sidebar sidebars rail widget widgets cookie cookies consent gdpr notice notices notification banner alert popup modal overlay newsletter subscribe signup login comment comments disqus respond replies reply "
    "share sharing social related recommended pagination pager toolbar copyright skip hidden".split()
)
BESIDE = frozenset("list box wrap wrapper section block area container item items top bottom left right main page site reader readers user users post posts article articles inline bar links link text content inner outer first last small large".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """Blocks of clean text of a page and the tree of its containers."""

    def __init__(self, source: str, around: frozenset[str] = AROUND):
        self.parent, self.path, self.tag, self.named = [-1], [_path(0, "", "")], [""], [False]
        self.blocks: list[tuple[int, str]] = []
        self.linked = [0]
        self._read(source or "", around)

    def _read(self, source: str, around: frozenset[str]) -> None:
        low = None
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # name, container, left out, in a link
        open_: dict[str, int] = {}
        text: list[str] = []
        at = 0

        def flush() -> None:
            if text:
                block = " ".join(html.unescape("".join(text)).split())
                if block:
                    self.blocks.append((stack[-1][1], block))
                text.clear()

        def pop() -> None:
            name = stack.pop()[0]
            open_[name] -= 1

        def close(name: str) -> None:
            while stack[-1][0] != name:
                leave()
            leave()

        def leave() -> None:
            if stack[-1][0] not in INLINE or stack[-1][1] != stack[-2][1]:  # a named box may be an inline element
                flush()
            pop()

        find = _TAG.search
        while (m := find(source, at)) is not None:
            if m.start() > at and not stack[-1][2]:
                text.append(source[at : m.start()])
                if stack[-1][3]:
                    self.linked[stack[-1][1]] += m.start() - at
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, attrs = name.lower(), m[3] or m[6] or ""
            if m[1] or m[4]:
                if open_.get(name):
                    close(name)
                elif name == "p":
                    flush()
                continue
            if name in RAW:
                low = source.lower() if low is None else low
                end = low.find(f"</{name}", at)
                at = len(source) if end < 0 else end
                if end >= 0 and (m := find(source, at)) is not None:
                    at = m.end()
                continue
            if name == "br" or name == "hr":
                text.append(" ")
            if name in VOID:
                continue
            if name in CLOSES_P and open_.get("p"):
                close("p")
            for other in SAME.get(name, ()):
                if open_.get(other) and self._nearest(stack, name, other):
                    close(other)
            if name not in INLINE:
                flush()
            out, label, named = stack[-1][2], "", False
            if attrs and ("=" in attrs or "hidden" in attrs):
                out, label, named = self._attributes(attrs, out, name)
            out = out or name in around
            here = stack[-1][1]
            if (name not in INLINE or named) and not out:
                if name in INLINE:
                    flush()
                self.parent.append(here)
                self.path.append(_path(self.path[here], name, label))
                self.tag.append(name)
                self.named.append(named)
                self.linked.append(0)
                here = len(self.parent) - 1
            stack.append((name, here, out, stack[-1][3] or name == "a"))
            open_[name] = open_.get(name, 0) + 1
        if at < len(source) and not stack[-1][2]:
            text.append(source[at:])
        flush()

    @staticmethod
    def _nearest(stack, name: str, other: str) -> bool:
        """Whether an open element of the other name is to be closed here: no list or table is between."""
        for have, *_ in reversed(stack):
            if have == other:
                return True
            if have in ("ul", "ol", "dl", "table", "menu", "select"):
                return False
        return False

    @staticmethod
    def _attributes(attrs: str, out: bool, name: str) -> tuple[bool, str, bool]:
        """Left out, the words of the classes, and whether a class or the id names a box."""
        label, named = "", False
        for m in _ATTR.finditer(attrs):
            kind, value = m[1].lower(), (m[2] or "").strip("\"'")
            if kind == "hidden":
                out = out or attrs[m.start() - 1 : m.start()].isspace() or m.start() == 0
            elif kind == "role":
                out = out or value.lower() in ROLES
            elif kind in ("class", "id"):
                for word in value.split():
                    parts = _PART.findall(_CAMEL.sub("-", word).lower())
                    named = named or (name not in ("body", "html", "main", "article") and not WORDS.isdisjoint(parts) and all(p in WORDS or p in BESIDE for p in parts))
                    if parts and kind == "class":
                        label += "." + "-".join(parts)
        return out, label, named

    def masses(self, boxes: bool = False) -> list[int]:
        """Characters of text in each container, less those of links; of named boxes none, unless asked for."""
        own = [0] * len(self.parent)
        for c, block in self.blocks:
            own[c] += len(block)
        own = [max(0, a - b) for a, b in zip(own, self.linked)]
        for i in range(len(own) - 1, 0, -1):
            if self.named[i] and not boxes:
                own[i] = 0
            own[self.parent[i]] += own[i]
        return own

    def best(self) -> tuple[int, float]:
        """Path of the best container and its share of the page's text: an article, or else the innermost container
        that still holds most of the text. Where all text is in named boxes, they count like others."""
        mass = self.masses()
        if not mass[0]:
            mass = self.masses(True)
        if not mass[0]:
            return NOWHERE, 0.0
        for tags in (("article",), ("main",)):
            found = [i for i, t in enumerate(self.tag) if t in tags and mass[i] * 3 >= mass[0]]
            if found:
                i = max(found, key=lambda i: (mass[i], -i))
                return self.path[i], mass[i] / mass[0]
        at, children = 0, [[] for _ in self.parent]
        for i in range(1, len(self.parent)):
            children[self.parent[i]].append(i)
        while children[at]:
            top = max(children[at], key=lambda i: (mass[i], -i))
            if mass[top] * 5 < mass[at] * 4 or self.tag[top] in ("p", "li", "td", "pre", "blockquote"):
                break
            at = top
        return self.path[at], mass[at] / mass[0]

    def boxes(self) -> list[tuple[int, float, float, int]]:
        """(path, share of the page's text, share of links, digest of the text) of each named box that is in no other."""
        if not any(self.named):
            return []
        n = len(self.parent)
        size, links, outer, text = [0] * n, list(self.linked), [-1] * n, {}
        for i in range(1, n):
            outer[i] = outer[self.parent[i]] if outer[self.parent[i]] >= 0 else i if self.named[i] else -1
        for c, block in self.blocks:
            size[c] += len(block)
            if outer[c] >= 0:
                text.setdefault(outer[c], []).append(block)
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
            links[self.parent[i]] += links[i]
        return [(self.path[i], size[i] / size[0], min(1.0, links[i] / size[i]), _hash(" ".join(own))) for i, own in text.items()]

    def text(self, path: int | None, kept: frozenset[int] = frozenset()) -> str:
        """Blocks inside of the containers on a path, in page order, without boxes; without such text, those of the page's best container.

        kept: paths of named containers that the host's pages show to be no boxes. A box that holds nine tenths of the page stays too.
        """
        heavy = {p for p, share, _, _ in self.boxes() if share >= 0.9}
        for p in (path, self.best()[0]):
            if p is not None:
                inside, out = [False] * len(self.parent), [False] * len(self.parent)
                for i, own in enumerate(self.path):
                    inside[i] = own == p or (i > 0 and inside[self.parent[i]])
                    out[i] = own != p and ((self.named[i] and own not in kept and own not in heavy) or (i > 0 and out[self.parent[i]]))
                if found := [b for c, b in self.blocks if inside[c] and not out[c]]:
                    return " ".join(found)
        return ""


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(1 << 14)
def _path(parent: int, name: str, label: str) -> int:
    """The path of a container is a hash of its parent's and of its own tag and classes, so any depth has one size."""
    return _hash(f"{parent}>{name}{label}")


#: The path of pages without text, which no container has.
NOWHERE = 0


def read(source: str | None) -> Page:
    """A page; where all text is inside of a form, the form isn't left out."""
    page = Page(source or "")
    if not page.blocks and source and "<form" in source.lower():
        page = Page(source, AROUND - {"form"})
    return page


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


_SEEN = "host string, path long, vote double, share double, links double, digest long"


@frees
def _vote(batches):
    for b in batches:
        rows = []
        for h, x in zip(b.column("host").to_pylist(), b.column("html")):
            page = read(x.as_py())
            path, share = page.best()
            if path != NOWHERE:
                rows.append((h, path, share, 0.0, 0.0, None))
            rows += [(h, p, 0.0, s, k, d) for p, s, k, d in page.boxes()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()))], ["host", "path", "vote", "share", "links", "digest"])


def votes(pages: DataFrame) -> DataFrame:
    """host, path, votes (one for each page, weighed by the share of its text that the container holds), and whether
    the host's pages show a named container on the path to be no box (shown)."""
    seen = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_vote, _SEEN)
    # one row for each text of a box first, so that a box that repeats on all pages costs its host no more than others
    seen = seen.groupBy("host", "path", "digest").agg(F.sum("vote").alias("votes"), F.count("digest").alias("n"), F.sum("share").alias("share"), F.sum("links").alias("links"))
    own = seen.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("n").alias("n"), F.count("digest").alias("texts"), F.sum("share").alias("share"), F.sum("links").alias("links"))
    n = F.greatest("n", F.lit(1))
    unlike = F.when((F.col("n") >= 3) & (F.col("texts") >= 0.9 * n) & (F.col("share") >= 0.3 * n) & (F.col("links") < 0.2 * n), 1.0).otherwise(0.0)
    score = 1 + 0.5 * F.when(F.col("links") > 0.5 * n, 1).otherwise(0) + 0.5 * F.when(F.col("texts") < 0.5 * n, 1).otherwise(0) - unlike
    return own.select("host", "path", "votes", ((F.col("n") > 0) & (score < 1)).alias("shown"))


def winners(pages: DataFrame) -> DataFrame:
    """host, its winning path, and the paths of its named containers that are no boxes."""
    return votes(pages).groupBy("host").agg(
        F.max_by(F.when(F.col("votes") > 0, F.col("path")), F.struct("votes", "path")).alias("path"), F.collect_list(F.when(F.col("shown"), F.col("path"))).alias("kept")
    )


@frees
def _extract(batches):
    for b in batches:
        texts = [read(x.as_py()).text(p, frozenset(k or ())) for x, p, k in zip(b.column("html"), b.column("path").to_pylist(), b.column("kept").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Winners are a short row for each host. Where all of them together are under SMALL_MB, they go to the pages; else pages meet
    them by host and part, in as many parts as the host has pages for, so that a hot host is dealt out.
    """
    best = cut(winners(pages))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    mb = (best.agg(F.sum(F.octet_length("host") + 8 * F.size("kept") + 64)).first()[0] or 0) / 1e6
    if mb <= SMALL_MB:
        met = own.join(F.broadcast(best), "host", "left")
    else:
        parts = cut(own.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / PAGES).cast("int").alias("parts")).where("parts > 1"))
        best = best.join(parts, "host", "left").select("host", "path", "kept", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        part = F.floor(unit_hash("page_id", "url") * F.coalesce("parts", F.lit(1))).cast("int")  # hot hosts are few: at most one for each PAGES pages
        met = own.join(parts, "host", "left").withColumn("part", part).join(best, ["host", "part"], "left")
    return met.select("page_id", "url", "html", "path", "kept").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


#: Pages of a host that meet its winner in one part, where winners are too many to be sent to all pages.
PAGES = 20_000
