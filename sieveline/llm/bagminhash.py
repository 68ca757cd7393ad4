"""MinHash near-dedup with BagMinHash signatures of weighted Jaccard similarity.

A text is the multiset of its windows of five words. Each window owns Poisson processes over time, one for each
dyadic block of its weight (levels 1, 2, 3-4, 5-8, ...); a point has a level within its block and counts only for
texts that have the window at least as often, and it has one of the registers, which keeps its earliest point.
So two texts agree on a register with the probability sum(min) / sum(max) of their weights, and a window that is
repeated n times costs log n processes. Points come in order of time and stop where all registers are filled.

Registers are banded. Exact copies count as one text. Within a bucket the member that is in the fullest buckets is
the centre, and all others are verified against it, by their whole multisets. Where components of a bucket stay
apart, all pairs between them are verified in small buckets; in larger ones those that an exact prefix filter
over the windows lets through, so no link within a bucket is lost and no bucket is expanded into all its pairs.
Links then give connected components, each with its smallest id as class.

Defined results: a text of one to four words is one window; texts without words have no window, and only exact
copies of them share a class; a null text counts as empty; rows of one id are one document; a row without an id gets a
null class; an empty table gives an empty one; other columns never matter.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import cut, frees, named, numbered
from .components import components

#: Words of a window, least similarity of a link.
K, SIMILAR = 5, 0.8
#: Bands and registers in each. A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** 4) ** 16 = 0.9998.
BANDS, ROWS = 16, 4
#: Buckets of at most so many texts have all pairs of different components compared; larger ones are filtered by prefixes.
SMALL = 24
#: Texts that meet by one window and size step in one part; more of them are dealt out to several.
HOT = 1000

_G, _LEVEL, _REG = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def multiset(buf: np.ndarray, offs: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, row, count) of all rows, by row."""
    start, end, row = W.words(buf, offs)
    word = W.hashes(buf, start, end)
    gram, at = W.grams(word, row, k)
    grams, rows = [gram], [row[at]]
    n = np.bincount(row, minlength=len(offs) - 1)
    for short in range(1, k):
        own = n[row] == short
        if own.any():
            g, a = W.grams(word[own], row[own], short)
            grams.append(W.mix(g + np.uint64(short)))
            rows.append(row[own][a])
    g, r = np.concatenate(grams), np.concatenate(rows)
    if not len(g):
        return g, r, np.zeros(0, np.int64)
    order = np.lexsort((g, r)) if len(grams) > 1 else np.argsort(g ^ (r.astype(np.uint64) * _G))
    g, r = g[order], r[order]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])]))
    g, r, c = g[first], r[first], np.diff(np.concatenate([first, [len(r)]]))
    order = np.argsort(r, kind="stable")
    return g[order], r[order], c[order]


def signatures(g: np.ndarray, r: np.ndarray, c: np.ndarray, rows: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Registers (rows x m): the times of the earliest points; infinite for rows without windows."""
    out = np.full(rows * m, np.inf)
    weight = np.bincount(r, c, rows)
    until = np.where(weight > 0, m * (np.log(m) + 4) / np.maximum(weight, 1e-9), 0.0)
    todo = weight > 0
    with np.errstate(over="ignore", divide="ignore"):
        while todo.any():
            on = todo[r]
            gg, rr, cc = g[on], r[on], c[on]
            block = 0
            while len(gg):  # block 0 is level 1, block j has the levels over 2 ** (j - 1) up to 2 ** j
                low, width = (0, 1) if block == 0 else (1 << (block - 1), 1 << (block - 1))
                seed, row, count = W.mix(gg + np.uint64(block) * _LEVEL), rr, cc
                time, i = np.zeros(len(seed)), 0
                while len(seed):
                    i += 1
                    u = ((W.mix(seed + np.uint64(i) * _G) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
                    time = time - np.log(u) / width
                    live = time <= until[row]
                    seed, row, count, time = seed[live], row[live], count[live], time[live]
                    h = W.mix(seed ^ (np.uint64(i) * _REG))
                    at, t = row * m + (h % np.uint64(m)).astype(np.int64), time
                    if width > 1 or low:
                        fine = low + 1 + ((h >> np.uint64(20)) % np.uint64(width)).astype(np.int64) <= count
                        at, t = at[fine], t[fine]
                    np.minimum.at(out, at, t)
                more = cc > low + width
                gg, rr, cc, block = gg[more], rr[more], cc[more], block + 1
            open_ = ~np.isfinite(out.reshape(rows, m)).all(1) & (weight > 0)
            until[open_] *= 2  # the process is the same, only longer
            todo = open_
    return out.reshape(rows, m)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """64 bits for each band of each row."""
    with np.errstate(over="ignore"):
        bits = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), BANDS, ROWS)
        key = np.broadcast_to(W.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(99)), bits.shape[:2])
        for j in range(ROWS):
            key = W.mix(key * _G + bits[:, :, j])
    return key.view(np.int64)


@frees
def _signed(batches):
    for b in batches:
        keys, full = np.zeros((b.num_rows, BANDS), np.int64), np.zeros(b.num_rows, bool)
        few: list[tuple] = []

        def put(g, r, c, keys=keys, full=full):
            own, at = np.unique(r, return_inverse=True)
            if len(own):
                keys[own] = band_keys(signatures(g, at, c, len(own)))
                full[own] = True

        for i, buf, offs in W.each_slice(b.column("text"), 1 << 18):
            g, r, c = multiset(buf, offs)
            small = np.bincount(r, c, len(offs) - 1)[r] < 128  # they take long, so all of a batch go together
            few.append((g[small], i + r[small], c[small]))
            put(g[~small], i + r[~small], c[~small])
        if few:
            put(*(np.concatenate(x) for x in zip(*few)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (b.num_rows + 1), BANDS, dtype=np.int32)), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("copy"), pa.array(full), lists], ["id", "copy", "full", "bands"])


def _one(g, c):
    order = np.argsort(g)
    return g[order], c[order]


def _overlap(a, b) -> float:
    (ga, ca), (gb, cb) = a, b
    if not len(ga) or not len(gb):
        return 0.0
    total = int(ca.sum() + cb.sum())
    if min(ca.sum(), cb.sum()) < SIMILAR * max(ca.sum(), cb.sum()):
        return 0.0
    at = np.searchsorted(ga, gb)
    at[at == len(ga)] = 0
    same = ga[at] == gb
    low = int(np.minimum(ca[at[same]], cb[same]).sum())
    return low / (total - low)


@frees
def _verify(similar: float, batches):
    last: dict[tuple[int, bytes], tuple] = {}  # by id and text, as an id can have several
    for b in batches:
        centres = b.column("b").to_numpy(zero_copy_only=False)
        keep = np.zeros(len(centres), bool)
        texts = b.column("text_b")
        for i, buf, offs in W.each_slice(b.column("text_a"), 1 << 18):
            g, r, c = multiset(buf, offs)
            first = np.searchsorted(r, np.arange(len(offs)))
            for j in range(len(offs) - 1):
                centre = int(centres[i + j]), hashlib.md5(texts[i + j].as_buffer()).digest()
                if centre not in last:
                    if len(last) >= 64:
                        last.clear()
                    g2, _, c2 = multiset(*W.utf8(texts.slice(i + j, 1)))
                    last[centre] = _one(g2, c2)
                own = slice(first[j], first[j + 1])
                keep[i + j] = _overlap(last[centre], _one(g[own], c[own])) >= similar
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))


def verified(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) of ids whose texts are similar enough. Only texts that a pair asks for are moved."""
    asked = pairs.select(F.col("a").alias("of")).unionByName(pairs.select(F.col("b").alias("of"))).distinct()
    own = texts.join(asked, F.col("id") == F.col("of"), "left_semi")
    left = pairs.join(own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(functools.partial(_verify, similar), "a long, b long")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    own = roots.select(F.col("id").alias("of"), "root")
    return rows.join(own, F.col("id") == F.col("of"), "left").withColumn("root", F.coalesce("root", "id")).drop("of")


def _split(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets with several components: key, id, n, root."""
    rows = _rooted(shared, roots)
    split = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("key").alias("k"))
    return cut(rows.join(split, F.col("key") == F.col("k")).select("key", "id", "n", "root"))


@frees
def _windows(batches):
    for b in batches:
        ids = b.column("id").to_numpy(zero_copy_only=False)
        for i, buf, offs in W.each_slice(b.column("text"), 1 << 18):
            g, r, c = multiset(buf, offs)
            total = np.bincount(r, c, len(offs) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i + r]), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64)), pa.array(total[r])], ["id", "gram", "weight", "total"])


def _prefix_pairs(members: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """All pairs of members (id, root) of different components that can be similar enough, by their rarest windows.

    Windows have one order, by the number of members that have them, then by hash. In both texts of a pair the first
    window that they share has little weight before it: what is before it is not shared. So the pair meets by that
    window, in rows that say what is before it, and is kept if sizes and rest allow an overlap that is large enough.
    """
    grams = texts.join(members.select(F.col("id").alias("of")), F.col("id") == F.col("of"), "left_semi").mapInArrow(_windows, "id long, gram long, weight long, total long")
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often")).where("often > 1").select(F.col("gram").alias("g"), "often")
    order = Window.partitionBy("id").orderBy("often", "g")
    # windows of one member alone come first in the order: they are what the others leave of the total
    upto, known = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("weight").over(Window.partitionBy("id"))
    rows = grams.join(often, F.col("gram") == F.col("g")).withColumn("rest", known - upto + F.col("weight")).where(F.col("rest") >= similar * F.col("total") - 1e-6)
    rows = cut(rows.select("g", "rest", "total", F.col("id").alias("i")).join(members, F.col("i") == F.col("id")).select("g", "rest", "total", "id", "root"))
    met = rows.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("g").alias("of"))
    rows = rows.join(met, F.col("g") == F.col("of"), "left_semi")
    log = F.log("total") / float(np.log(1 / similar))  # sizes of a pair differ by at most one step
    small = rows.where(F.col("rest") >= 2 * similar / (1 + similar) * F.col("total") - 1e-6)
    small = small.select("g", F.explode(F.sequence(F.floor(log - 1e-9), F.floor(log + 1 + 1e-9))).alias("step"), *[F.col(c).alias(f"{c}_a") for c in ("id", "root", "total", "rest")])
    large = rows.select("g", F.floor(log).alias("step"), *[F.col(c).alias(f"{c}_b") for c in ("id", "root", "total", "rest")])
    possible = (F.col("root_a") != F.col("root_b")) & (F.struct("total_a", "id_a") < F.struct("total_b", "id_b")) & (F.col("total_a") >= similar * F.col("total_b") - 1e-6)
    # a window that many texts start with is dealt out: each part has some of the larger texts and all of the smaller ones
    hot = cut(large.groupBy(F.col("g").alias("hot_g"), F.col("step").alias("hot_step")).agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts")).where("parts > 1"))
    dealt = lambda side: side.join(hot, (F.col("g") == F.col("hot_g")) & (F.col("step") == F.col("hot_step")), "left").drop("hot_g", "hot_step").withColumn("parts", F.coalesce("parts", F.lit(1)))
    large = dealt(large).withColumn("part", F.pmod(F.xxhash64("id_b"), F.col("parts")).cast("int")).drop("parts")
    small = dealt(small).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    enough = F.least("rest_a", "rest_b") >= similar / (1 + similar) * (F.col("total_a") + F.col("total_b")) - 1e-6
    return small.join(large, ["g", "step", "part"]).where(possible & enough).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def _apart(shared: DataFrame, texts: DataFrame, roots: DataFrame, tried: DataFrame, similar: float) -> DataFrame:
    """All pairs (a, b) of different components that share a bucket and can be similar enough, but those tried."""
    rows = _split(shared, roots)
    few = rows.where(F.col("n") <= SMALL)
    pairs = few.select("key", F.col("id").alias("a"), F.col("root").alias("ra")).join(few.select("key", F.col("id").alias("b"), F.col("root").alias("rb")), "key").where("ra < rb")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    many = cut(rows.where(F.col("n") > SMALL).select("id", "root").distinct())
    return pairs.unionByName(_prefix_pairs(many, texts, similar)).distinct().join(tried, ["a", "b"], "left_anti")


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """id and class_id of every row of docs (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = own.where("id is not null").withColumn("copy", F.md5("text")).mapInArrow(_signed, "id long, copy string, full boolean, bands array<long>")
    signed = cut(signed)
    reps = cut(signed.groupBy("copy").agg(F.min("id").alias("id"), F.first("full").alias("full"), F.first("bands").alias("bands")))
    # an id of several texts, and the texts of several ids
    same = signed.select(F.col("id").alias("a"), "copy").join(reps.select("copy", F.col("id").alias("b")), "copy").select("a", "b").where("a <> b")
    rows = reps.where("full").select("id", F.posexplode("bands").alias("band", "key"))
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k"), "n")
    shared = cut(rows.join(often, F.col("key") == F.col("k")).select("key", "band", "id", "n"))
    involved = cut(shared.groupBy("id").agg(F.sum("n").alias("fame")))
    named = reps.select(F.col("id").alias("of"), "copy").join(involved, F.col("of") == F.col("id"), "left_semi")
    texts = cut(own.withColumn("c", F.md5("text")).join(named, (F.col("id") == F.col("of")) & (F.col("c") == F.col("copy")), "left_semi").select("id", "text"))
    centre = shared.join(involved.select(F.col("id").alias("of"), "fame"), F.col("id") == F.col("of")).groupBy("key").agg(F.max_by("id", F.struct("fame", -F.col("id"))).alias("b")).select(F.col("key").alias("k"), "b")
    pairs = shared.join(centre, F.col("key") == F.col("k")).where("id <> b").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    tried = cut(pairs)
    links = cut(verified(tried, texts, similar))
    roots = components(links)
    new = cut(verified(cut(_apart(shared, texts, roots, tried, similar)), texts, similar))
    links = roots.select(F.col("id").alias("a"), F.col("root").alias("b"))
    if new.limit(1).count():
        links = links.unionByName(new)
        roots = components(links)
        links = roots.select(F.col("id").alias("a"), F.col("root").alias("b"))
    # roots of texts; then rows of one text, and texts of one id, which repeated ids alone can bind further
    roots = components(links.unionByName(same)) if _repeats(signed) else _by_copy(signed, reps, roots)
    return _rooted(own.select("id"), roots).select("id", F.col("root").alias("class_id"))


def _repeats(signed: DataFrame) -> bool:
    return bool(signed.select("id", "copy").distinct().groupBy("id").count().where("count > 1").limit(1).count())


def _by_copy(signed: DataFrame, reps: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots of all rows from those of the first row of each text."""
    own = _rooted(reps.select("copy", "id"), roots).select("copy", "root")
    return signed.select("id", "copy").distinct().join(own, "copy").where("id <> root").select("id", "root")


def near_dedup(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each class stays: the one with the smallest id (one row of it, that of the smallest text hash); rows without an id stay."""
    gone = cut(classes(docs, similar).where("id <> class_id").select(F.col("id").alias("gone")).distinct())
    stay = docs.select(*numbered(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash")).join(gone, F.col("id") == F.col("gone"), "left_anti")
    twice = cut(stay.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("twice")))
    if twice.limit(1).count():
        w = Window.partitionBy("id").orderBy("hash")
        once = stay.join(twice, F.col("id") == F.col("twice"), "left_semi").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
        stay = stay.join(twice, F.col("id") == F.col("twice"), "left_anti").unionByName(once)
    return stay.select(*named(docs))
