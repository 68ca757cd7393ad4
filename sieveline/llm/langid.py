"""Language identification: scripts narrow the candidates, then Viterbi labels the words of mixed text.

A model holds, for each language, log probabilities of byte 4-grams (hashed) of words in lower case, and the
scripts that the language is written in. A word scores the sum of its grams for each candidate language; a
candidate must be written in the script of the word, if any language is. Viterbi over these scores, with a
penalty for each switch, labels every word; neighbours of one label are a span. The language with the most letters
wins, and its score is its share of all letters.

Letters are those of Unicode in any script, with the marks that belong to them.

Defined results: a null text, and a text without a letter, is `und` with score 0 and no span; without any learned language
everything is `und`; ties go to the language that is first by code point; repeated rows get equal results; any number of
languages is learned; spans go from the first to the last letter of neighbouring words of one label, in code points with
exclusive ends; ids, sources and other columns never matter.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import frees, unit_hash

#: Bound, for each language, on the expected number of labelled documents that the model is fitted on.
SAMPLE = 1500
#: Cost of a switch between two words, in nats; most score that a word can have against another language.
SWITCH, MOST = 12.0, 8.0
BUCKETS = 1 << 16
#: Scores (words times languages) of mixed texts that are labelled together, so that any number of languages fits into memory.
CELLS = 1 << 22
#: Scripts by Unicode ranges, as (name, first, last) of code points; fixed values.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("latin", 0x2C60, 0x2C7F), ("latin", 0xA720, 0xA7FF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("cyrillic", 0x2DE0, 0x2DFF), ("cyrillic", 0xA640, 0xA69F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("syriac", 0x700, 0x74F), ("arabic", 0x750, 0x77F), ("thaana", 0x780, 0x7BF),
    ("nko", 0x7C0, 0x7FF), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("oriya", 0xB00, 0xB7F), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F),
    ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("tibetan", 0xF00, 0xFFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F), ("cherokee", 0x13A0, 0x13FF), ("canadian", 0x1400, 0x167F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("glagolitic", 0x2C00, 0x2C5F),
    ("coptic", 0x2C80, 0x2CFF), ("georgian", 0x2D00, 0x2D2F), ("tifinagh", 0x2D30, 0x2D7F), ("ethiopic", 0x2D80, 0x2DDF), ("kana", 0x3040, 0x30FF), ("bopomofo", 0x3100, 0x312F), ("han", 0x3400, 0x9FFF), ("yi", 0xA000, 0xA4CF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFC), ("latin", 0xFF21, 0xFF5A), ("kana", 0xFF66, 0xFF9D), ("han", 0x20000, 0x3FFFF),
)
NAMES = tuple(dict.fromkeys(s[0] for s in SCRIPTS))
NONE = 255

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter or a mark that goes with letters."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


@functools.lru_cache(1)
def _scripts() -> np.ndarray:
    """Script number of a code point, NONE if it has none here."""
    out = np.full(0x110000, NONE, np.uint8)
    for name, first, last in SCRIPTS:
        out[first : last + 1] = NAMES.index(name)
    return out


def points(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the UTF-8 characters that begin at some bytes."""
    b = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int32)
    one, two, three, four = b[at], b[at + 1] & 0x3F, b[at + 2] & 0x3F, b[at + 3] & 0x3F
    wide = np.where(one < 0xF0, ((one & 0x0F) << 12) | (two << 6) | three, ((one & 0x07) << 18) | (two << 12) | (three << 6) | four)
    return np.minimum(np.where(one < 0x80, one, np.where(one < 0xE0, ((one & 0x1F) << 6) | two, wide)), 0x10FFFF)


def tokens(buf: np.ndarray, offs: np.ndarray):
    """Runs of letters: starts, ends and rows."""
    inside = _LETTER[buf]
    at = np.flatnonzero(buf >= 0xC0)
    if len(at):
        at = at[_letters()[points(buf, at)]]
        size = 1 + (buf[at] >= 0xC0).astype(np.int64) + (buf[at] >= 0xE0) + (buf[at] >= 0xF0)
        for k in range(4):
            inside[at[size > k] + k] = True
    return W.runs(inside, offs)


def scripts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of the first letter of each word, NONE for an unknown one."""
    return _scripts()[points(buf, starts)]


def gram_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 4-grams of " word " and, for each word, where its grams begin. A word of n bytes has n - 1 of them, at least one."""
    size = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(size)])
    own = np.full(at[-1] + 4, 32, np.uint32)
    from_ = np.repeat(starts - at[:-1] - 1, size)
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = False
    inner[at[1:] - 1] = False
    place = np.flatnonzero(inner)
    own[place] = _LOWER[buf[place + from_[place]]]
    n = at[-1]
    code = own[:n] | (own[1 : n + 1] << np.uint32(8)) | (own[2 : n + 2] << np.uint32(16)) | (own[3 : n + 3] << np.uint32(24))
    keep = np.ones(n, bool)
    keep[at[1:] - 1] = False
    keep[at[1:] - 2] = False
    keep[at[1:] - 3] = False
    keep[at[:-1]] = True  # a short word has one gram, which may go on into the next word
    short = np.flatnonzero(size == 3)
    code[at[short]] = code[at[short]] & np.uint32(0x00FFFFFF)
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    count = np.concatenate([[0], np.cumsum(keep)])
    return code[keep].astype(np.int64), count[at[:-1]]


class Model:
    """langs by code point, score[bucket, lang] in nats below the best language, allowed[script, lang]."""

    def __init__(self, langs: list[str], grams: np.ndarray, in_script: np.ndarray):
        self.langs = langs
        with np.errstate(divide="ignore"):
            p = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS))
        self.score = np.ascontiguousarray(p - p.max(1, keepdims=True), dtype=np.float32) if langs else np.zeros((BUCKETS, 0), np.float32)
        share = in_script / np.maximum(in_script.sum(0), 1)
        self.allowed = share >= 0.01
        self.allowed[~self.allowed.any(1)] = True
        self.allowed = np.vstack([self.allowed, np.ones((1, len(langs)), bool)])

    def word_scores(self, buf, starts, ends) -> np.ndarray:
        ids, first = gram_ids(buf, starts, ends)
        out = np.add.reduceat(self.score[ids], first, axis=0)
        np.maximum(out, -MOST, out=out)
        may = self.allowed[np.minimum(scripts(buf, starts), len(NAMES))]
        out[~may] = -1e4
        return out


def viterbi(score: np.ndarray, row: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label for each word. score: words x labels, words of a row stand together. All rows advance in step, the
    longest first, so that each numpy call moves many rows on by one word."""
    n, k = score.shape
    if not n:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    label = np.zeros(n, np.int64)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # rows with at least so many words
    total = score[first].astype(np.float64)
    kind = np.int8 if k <= 127 else np.int32
    back = np.zeros((n, k), kind)
    own = np.arange(k, dtype=kind)
    for t in range(1, int(size[0])):
        m = live[t]
        now = total[:m]
        top = now.argmax(1)
        jump = now[np.arange(m), top][:, None] - switch
        stay = now >= jump
        back[first[:m] + t] = np.where(stay, own, top[:, None].astype(kind))
        total[:m] = np.where(stay, now, jump) + score[first[:m] + t]
    at = total.argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        m = live[t]
        place = first[:m] + t
        label[place] = at[:m]
        if t:
            at[:m] = back[place, at[:m]]
    return label


def constant(score: np.ndarray, row: np.ndarray, rows: int, switch: float = SWITCH) -> np.ndarray:
    """For each row the one label of all its words, if that is what viterbi() finds for sure, else -1 (also without words).

    The best constant label is best of all if no stretch of words gains more than half a switch by another label:
    a path of m stretches with other labels has at least m - 1 switches, and m of them if it uses the constant one.
    """
    out = np.full(rows, -1)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    which = row[first]
    best = np.add.reduceat(score, first, axis=0).argmax(1)
    size = np.diff(np.concatenate([first, [len(row)]]))
    gain = score - np.take_along_axis(score, np.repeat(best, size)[:, None], 1)
    fine = np.ones(len(first), bool)
    drop = np.repeat(np.arange(len(first)) * -1e7, size)  # starts the running minimum anew in each row
    for k in range(score.shape[1]):
        g = np.maximum(gain[:, k].astype(np.float64), -100.0)
        total = np.cumsum(g)
        total -= np.repeat(total[first] - g[first], size)
        before = np.minimum.accumulate(total - g + drop) - drop
        fine &= np.maximum.reduceat(total - before, first) <= switch / 2
    out[which[fine]] = best[fine]
    return out


class _Labels:
    """Words of a batch and their labels: rows that have one label for sure at once, the others by Viterbi, some at a time."""

    def __init__(self, rows: int, langs: list[str]):
        self.langs, self.k = langs, len(langs)
        self.weight = np.zeros((rows, self.k))
        self.spans: list[str | None] = [None] * rows
        self.waiting: list[tuple] = []
        self.cells = 0

    def add(self, score, row, of, first, last) -> None:
        """Words by row: scores, the sure labels of their rows or -1, and the code points where they begin and end."""
        sure = of >= 0
        self.put(row[sure], of[sure], first[sure], last[sure])
        if not sure.all():
            self.waiting.append(tuple(x[~sure] for x in (score, row, first, last)))
            self.cells += (~sure).sum() * self.k
            if self.cells >= CELLS:
                self.flush()

    def flush(self) -> None:
        if self.waiting:
            score, row, first, last = (np.concatenate(x) for x in zip(*self.waiting))
            self.waiting, self.cells = [], 0
            self.put(row, viterbi(score, row), first, last)

    def put(self, row, label, first, last) -> None:
        if not len(row):
            return
        np.add.at(self.weight, (row, label), last - first)
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (label[1:] != label[:-1])]))
        end = np.concatenate([new[1:], [len(row)]]) - 1
        for r, of, a, b in zip(row[new].tolist(), label[new].tolist(), first[new].tolist(), last[end].tolist()):
            span = f"{self.langs[of]}:{a}:{b}"
            self.spans[r] = span if self.spans[r] is None else f"{self.spans[r]},{span}"


@frees
def _predict(model: Model, batches):
    k, names = len(model.langs), np.array([*model.langs, "und"], object)
    for b in batches:
        rows = b.num_rows
        found = _Labels(rows, model.langs)
        odd: list[int] = []  # rows of which only a look at the code points tells whether there is a letter
        for i, buf, offs in W.each_slice(b.column("text")):
            n = len(offs) - 1
            start, end, row = tokens(buf, offs)
            ascii_ = np.zeros(n, bool)
            if k and len(start):
                score = model.word_scores(buf, start, end)
                chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                begin = chars[offs[row]]
                found.add(score, i + row, constant(score, row, n)[row], chars[start] - begin, chars[end] - begin)
            ascii_[row[_LETTER[buf[start]]]] = True  # an ASCII letter begins a word
            odd += (i + np.flatnonzero(~ascii_ & (np.diff(offs) > 0))).tolist()
        found.flush()
        weight = found.weight
        total = weight.sum(1)
        pred = np.where(total > 0, weight.argmax(1) if k else -1, -1)
        top = np.where(total > 0, weight.max(1, initial=0) / np.maximum(total, 1), 0.0)
        for j in odd:
            if not any(c.isalpha() for c in b.column("text")[j].as_py()):  # marks alone are no letters
                pred[j], top[j], found.spans[j] = -1, 0.0, None
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("held_out"), pa.array(names[pred], pa.string()), pa.array(top, pa.float64()), pa.array([s or "" for s in found.spans], pa.string())], ["doc_id", "held_out", "lang_pred", "score", "spans"]
        )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans (language:start:end, comma-joined) of every document; only the text decides on the last three."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return own.mapInArrow(functools.partial(_predict, model), "doc_id long, held_out boolean, lang_pred string, score double, spans string")


def held_out():
    """Documents that are never learned from; a null id counts as 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("0"))) % 4 == 2


@frees
def _counts(langs: list[str], batches):
    """Partial counts: kind 0 has 4-grams by bucket, kind 1 words by script."""
    number = {x: i for i, x in enumerate(langs)}
    k = len(langs)
    grams, kinds = np.zeros((BUCKETS, k), np.int64), np.zeros((len(NAMES) + 1, k), np.int64)
    for b in batches:
        lang = np.array([number[x] for x in b.column("lang").to_pylist()])
        for i, buf, offs in W.each_slice(b.column("text")):
            start, end, row = tokens(buf, offs)
            if len(start):
                ids, first = gram_ids(buf, start, end)
                of = lang[i + row]
                grams += np.bincount(ids * k + np.repeat(of, np.diff(np.concatenate([first, [len(ids)]]))), minlength=BUCKETS * k).reshape(BUCKETS, k)
                kinds += np.bincount(np.minimum(scripts(buf, start), len(NAMES)).astype(int) * k + of, minlength=len(kinds) * k).reshape(kinds.shape)
    for kind, table in ((0, grams), (1, kinds)):
        at, of = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(of.astype(np.int32)), pa.array(table[at, of])], ["kind", "bucket", "lang", "n"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about `sample` documents of each language, picked by a hash of their ids. The model has at most
    BUCKETS numbers a language, whatever the input; what the driver gets is in proportion to the number of languages only."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(NAMES), 0)))
    rate = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang])))])
    some = known.where(unit_hash("doc_id") < F.element_at(rate, F.col("lang")))
    found = some.select("lang", "text").mapInArrow(functools.partial(_counts, langs), "kind int, bucket int, lang int, n long").groupBy("kind", "bucket", "lang").agg(F.sum("n").alias("n")).toPandas()
    grams, kinds = np.zeros((BUCKETS, len(langs))), np.zeros((len(NAMES) + 1, len(langs)))
    for kind, table in ((0, grams), (1, kinds)):
        own = found[found["kind"] == kind]
        table[own["bucket"], own["lang"]] = own["n"]
    return Model(langs, grams, kinds[:-1])
