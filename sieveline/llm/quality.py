"""Quality rules: an isolation forest on rule statistics.

Every document gets rule statistics (word, symbol, repetition and letter-case rates). A forest of random splits
is grown on a bounded sample of labelled documents; a document that random splits isolate after few steps is
anomalous. The threshold on the anomaly score is calibrated on labelled rows that no tree has grown on.

Defined results: a null or empty text has no words and fails the base rules; repeated rows get equal verdicts; of
several texts of one labelled id the first by code point counts, and of several labels the best; equal scores get
equal verdicts, as only a score above the threshold rejects; without any labelled row of good quality there is no forest
and every document that passes the base rules is kept; other columns of the input never matter.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import frees, unit_hash

#: Bound on the labelled rows that the forest and its threshold are fitted on.
SAMPLE = 6000
TREES, PSI = 100, 256
#: Share of labelled good documents that the calibrated threshold must keep.
KEEP = 0.995
#: A false alarm on a good document weighs this much more than a missed bad one.
CARE = 20.0
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_lower", "n_digits", "n_distinct", "n_odd_words")


def _flag(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _MARK, _DIGIT = _flag("#*$%&|<>"), _flag("!?~^=_@"), _flag("0123456789")
_UPPER, _LOWER = _flag("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flag("abcdefghijklmnopqrstuvwxyz")
_ODD = _SYMBOL | _MARK
#: The first one: bytes that begin a code point and aren't separators.
_CLASSES = (~W.SPACE & ((np.arange(256) & 0xC0) != 0x80), _SYMBOL, _UPPER, _LOWER, _DIGIT)


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts COUNTS and EXTRA of each text of a column."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in (*COUNTS, *EXTRA)}
    for _, buf, offs in W.each_slice(column):
        n = len(offs) - 1
        start, end, row = W.words(buf, offs)
        word = W.hashes(buf, start, end)
        gram, at = W.grams(word, row, WINDOW)
        hit = np.zeros(len(word) + WINDOW, bool)
        twice = at[W.repeated(gram, row[at])]
        for j in range(WINDOW):
            hit[twice + j] = True
        l_start, l_end, l_row = W.lines(buf, offs)
        full = np.searchsorted(start, l_end) > np.searchsorted(start, l_start)
        l_start, l_end, l_row = l_start[full], l_end[full], l_row[full]
        n_lines = np.bincount(l_row, minlength=n)
        odd = np.flatnonzero(_ODD[buf])
        tally = W.per_row_all(buf, offs, _CLASSES)
        found = {
            "n_words": np.bincount(row, minlength=n),
            "word_chars": tally[0],
            "n_symbols": tally[1],
            "n_dup_lines": n_lines - W.distinct(W.hashes(buf, l_start, l_end), l_row, n),
            "n_repeat_words": np.bincount(row[hit[: len(word)]], minlength=n),
            "n_lines": n_lines,
            "n_upper": tally[2],
            "n_lower": tally[3],
            "n_digits": tally[4],
            "n_distinct": W.distinct(word, row, n),
            "n_odd_words": np.bincount(row[np.searchsorted(odd, end) > np.searchsorted(odd, start)], minlength=n),
        }
        for k, v in found.items():
            out[k].append(v.astype(np.int64))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT * s["n_words"])


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rates that the forest splits on, one row per document."""
    n = np.maximum(s["n_words"], 1).astype(float)
    letters = np.maximum(s["n_upper"] + s["n_lower"], 1)
    rates = np.column_stack([
        s["n_symbols"] / n, s["n_odd_words"] / n, s["n_upper"] / letters, s["n_digits"] / np.maximum(s["word_chars"], 1),
        s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / n, 1 - s["n_distinct"] / n ** 0.9,
    ])
    return np.sqrt(np.clip(rates, 0, 1))


def _c(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Forest:
    """Isolation trees as flat arrays: feature (-1: leaf), threshold, left child (right is left + 1), path length.

    Rows are the documents that the trees grow on. Splits are uniform over a node's part of the box that holds
    every labelled row, good or bad, so that regions without good documents are cut off after few steps.
    """

    def __init__(self, rows: np.ndarray, box: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        psi = min(psi, len(rows))
        self.depth = int(np.ceil(np.log2(max(psi, 2)))) + 6
        self.norm = _c(psi) or 1.0
        self.trees = [self._grow(rows[rng.choice(len(rows), psi, replace=False)], box.min(0), box.max(0), rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, threshold, left, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, low, high, 0)]
        while todo:
            at, rows, low, high, depth = todo.pop()
            wide = np.flatnonzero(high > low)
            if len(rows) <= 1 or depth == self.depth or not len(wide):
                path[at] = depth + _c(len(rows))
                continue
            f = int(rng.choice(wide))
            feature[at], threshold[at], left[at] = f, float(rng.uniform(low[f], high[f])), len(feature)
            below, top, bottom = rows[:, f] < threshold[at], high.copy(), low.copy()
            top[f] = bottom[f] = threshold[at]
            todo.append((len(feature), rows[below], low, top, depth + 1))
            todo.append((len(feature) + 1, rows[~below], bottom, high, depth + 1))
            for _ in range(2):
                feature.append(-1), threshold.append(0.0), left.append(0), path.append(0.0)
        return np.array(feature), np.array(threshold), np.array(left), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1]; higher is more anomalous."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, left[at] + (x[rows, f] >= threshold[at]))
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


class Model:
    """A forest grown on labelled good rows, and the score above which a document is rejected."""

    def __init__(self, x: np.ndarray, good: np.ndarray, grows: np.ndarray | None = None):
        """grows: the rows that trees may grow on; the threshold is set on all others. By default, and where
        either part would have no good row, all rows serve both."""
        self.forest, self.limit = None, np.inf
        if not good.any():
            return
        if grows is None or not (good & grows).any() or not (good & ~grows).any():
            grows = np.ones(len(x), bool)
        self.forest = Forest(x[good & grows], x)
        held = ~grows if not grows.all() else grows
        x, good = x[held], good[held]
        score = self.forest.score(x)
        keep, drop = np.sort(score[good]), np.sort(score[~good])
        floor = keep[min(len(keep) - 1, int(np.ceil(KEEP * len(keep))))]
        tries = np.unique(np.concatenate([[floor], drop[drop >= floor], keep[keep >= floor]]))
        lost = 1 - np.searchsorted(keep, tries, "right") / len(keep)
        caught = 1 - np.searchsorted(drop, tries, "right") / max(1, len(drop))
        worth = caught - CARE * lost
        self.limit = float(tries[np.flatnonzero(worth >= worth.max() - 1e-12)[-1]])  # of equal ones, the mildest

    def kept(self, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(kept, score) of each document."""
        failed = base_failed(s)
        score = self.forest.score(features(s)) if self.forest and len(failed) else np.zeros(len(failed))
        return ~failed & (score <= self.limit), score


@frees
def _sample_stats(batches):
    for b in batches:
        s = statistics(b.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(s[k]) for k in (*COUNTS, *EXTRA)] + [b.column("quality"), b.column("grows")], [*COUNTS, *EXTRA, "quality", "grows"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows, those with the smallest hashes of doc_id; the rest of the corpus isn't read twice by Python."""
    chosen = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(unit_hash("doc_id"), "doc_id").limit(sample)
    )
    # a row for each chosen id, so the driver gets `sample` short rows at most
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").cast("long").alias("quality"))
    own = own.select("text", "quality", (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)) == 0).cast("long").alias("grows"))
    got = own.mapInArrow(_sample_stats, ", ".join(f"{k} long" for k in (*COUNTS, *EXTRA, "quality", "grows"))).toPandas()
    got = got.sort_values(list(got.columns)).reset_index(drop=True)  # the fit doesn't depend on partitions
    s = {k: got[k].to_numpy() for k in (*COUNTS, *EXTRA)}
    fine = ~base_failed(s)
    return Model(features(s)[fine], (got["quality"].to_numpy() > 0)[fine], (got["grows"].to_numpy() > 0)[fine])


@frees
def _judge(model: Model, batches):
    for b in batches:
        s = statistics(b.column("text"))
        kept, score = model.kept(s)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(s[k]) for k in COUNTS), pa.array(base_failed(s)), pa.array(kept), pa.array(score)],
            ["doc_id", *COUNTS, "base_failed", "kept", "score"],
        )


def verdicts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and the anomaly score of every document."""
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(functools.partial(_judge, model), schema)


@frees
def _filter(model: Model, batches):
    for b in batches:
        kept, _ = model.kept(statistics(b.column("text")))
        yield b.filter(pa.array(kept))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that pass, with all their columns."""
    return docs.mapInArrow(functools.partial(_filter, model), docs.schema)
