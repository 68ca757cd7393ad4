"""Exact top-k search by branch and bound over columns.

Vectors are kept in vertical layout, a block of candidates at a time: dimensions first, the heaviest ones in
front. For a query, scores grow dimension block by dimension block; what the remaining dimensions can add is
bounded by the product of the remaining masses (norms) of both vectors. Candidates whose upper bound is below
the k-th best lower bound are dropped, and the survivors are compacted before the next block.

The query set meets all rows in blocks: a block of queries and a run of candidate blocks form one task of bounded
size, whatever keys or repeated vectors the table has. The candidate blocks of a task follow each other, and the k-th
best score of each query so far bounds the next one. Each task returns at most k rows for each query.

Defined results: components become floor(64 * x); vectors that are null or hold a null or non-finite component take no
part; shorter vectors count as filled with zeros; a query is a row, and meets every row but itself, rows that repeat its
id included; it gets fewer than k results if there are fewer; of equal scores the smaller id comes first, a null id last; repeated
rows are candidates of their own, and a repeated query row repeats its results; scores are exact integers and
saturate at the limits of 64 bits; an empty table gives an empty one; other columns never matter.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a block of candidates, of queries, and of queries that are compared at once.
BLOCK, QUERIES, ONCE = 16384, 8192, 512
#: Candidate blocks of one task at most.
RUN = 8
#: Dimensions that are accumulated between two rounds of pruning.
STEP = 16

#: Stands for a null id, as it comes last among equal scores.
_LAST = (1 << 63) - 1


def integers(vectors: DataFrame, query: Column) -> DataFrame:
    """row, vec_id, is_query and the components as floor(64 * x), of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    own = vectors.where(fine).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_LAST)).alias("vec_id"), F.coalesce(query, F.lit(False)).alias("is_query"), F.transform(x, lambda v: F.floor(v * 64).cast("double")).alias("x"))
    return cut(own.withColumn("row", F.monotonically_increasing_id()))  # written, as row numbers hold for one run only


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them exactly."""
    top = np.abs(x).max(initial=0)
    return x.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.float64)


def _pack(batches):
    """One row for each partition: its rows, ids, lengths and components."""
    frames = [b for b in batches if len(b)]
    if frames:
        all_ = pd.concat(frames, ignore_index=True)
        size = all_["x"].map(len).to_numpy(np.int32)
        x = _small(np.concatenate(list(all_["x"])) if size.sum() else np.zeros(0))
        yield pd.DataFrame({
            "block": [TaskContext.get().partitionId()], "rows": [all_["row"].to_numpy(np.int64).tobytes()], "ids": [all_["vec_id"].to_numpy(np.int64).tobytes()],
            "size": [size.tobytes()], "type": [x.dtype.char], "x": [x.tobytes()],
        })


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n).mapInPandas(_pack, "block int, rows binary, ids binary, size binary, type string, x binary")


def _dense(row: pd.Series, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows, ids and components, one column for each dimension."""
    size, x = np.frombuffer(row["size"], np.int32), np.frombuffer(row["x"], row["type"])
    out = np.zeros((len(size), dims))
    out[np.arange(dims) < size[:, None]] = x
    return np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64), out


def search(q: np.ndarray, c: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the k best candidates of each query: rows of q against rows of c, except equal row numbers.

    floor: for each query, a score below which nothing is asked for.
    """
    dims = c.shape[1]
    most = max(float(np.abs(q).max(initial=0)), 1.0) * max(float(np.abs(c).max(initial=0)), 1.0) * max(dims, 1)
    if most >= 2.0**52:  # doubles aren't exact for such numbers
        big = np.array([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in c] for x in q], object).reshape(len(q), len(c))
        best = [sorted((-s, ids[j], j) for j, s in enumerate(row) if rows[j] != own[i])[:k] for i, row in enumerate(big)]
        flat = [(i, j, max(-(2**63), min(2**63 - 1, -s))) for i, found in enumerate(best) for s, _, j in found]
        return tuple(np.array([f[i] for f in flat], np.int64) for i in range(3))
    order = np.argsort(-(c * c).sum(0), kind="stable")
    vertical, q = np.ascontiguousarray(c.T[order]), q[:, order]
    cuts = list(range(0, dims, STEP))
    # what is left from each cut on, of candidates and queries
    left_c = [np.sqrt((vertical[d:] ** 2).sum(0)) for d in [*cuts[1:], dims]]
    left_q = [np.sqrt((q[:, d:] ** 2).sum(1)) for d in [*cuts[1:], dims]]
    by_row = np.argsort(rows, kind="stable")
    place = np.minimum(np.searchsorted(rows[by_row], own), max(0, len(rows) - 1))
    found = []
    for first in range(0, len(q), ONCE):
        part = q[first : first + ONCE, :STEP] @ vertical[:STEP] if dims else np.zeros((len(q[first : first + ONCE]), len(ids)))
        for i in range(first, min(first + ONCE, len(q))):
            score, alive = part[i - first], None
            if len(rows) and rows[by_row[place[i]]] == own[i]:
                score[by_row[place[i]]] = -np.inf
            for b, d in enumerate(cuts or [0]):
                if b:
                    cols = vertical[d : d + STEP] if alive is None else vertical[d : d + STEP, alive]
                    score = score + q[i, d : d + STEP] @ cols
                if cuts:
                    more = left_q[b][i] * (left_c[b] if alive is None else left_c[b][alive]) * (1 + 1e-12) + 1e-6
                    least = np.partition(score - more, len(score) - k)[len(score) - k] if len(score) > k else -np.inf
                    stay = np.flatnonzero(score + more >= (least if floor is None else max(least, floor[i])))
                    if len(stay) < len(score):
                        alive = stay if alive is None else alive[stay]
                        score = score[stay]
            at = np.arange(len(ids)) if alive is None else alive
            real = np.isfinite(score)
            at, score = at[real], score[real]
            if len(at) > k:
                edge = -np.partition(-score, k - 1)[k - 1]
                top = score >= edge
                at, score = at[top], score[top]
            best = np.lexsort((ids[at], -score))[:k]
            found.append((np.full(len(best), i), at[best], np.rint(score[best]).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query i."""
    order = np.lexsort((ids, -score.astype(object) if (score == -(2**63)).any() else -score, i))
    i, ids, score = i[order], ids[order], score[order]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < k
    return i[keep], ids[keep], score[keep]


def _meet(k: int, key, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    out = []
    sizes = lambda rows: max((int(np.frombuffer(x, np.int32).max(initial=0)) for x in rows["size"]), default=0)
    dims = max(sizes(queries), sizes(candidates))
    for _, qs in queries.iterrows():
        own, query_ids, q = _dense(qs, dims)
        i, vec, score = (np.zeros(0, np.int64),) * 3
        floor = np.full(len(q), -np.inf)
        for _, cs in candidates.sort_values("block").iterrows():
            rows, ids, c = _dense(cs, dims)
            a, j, s = search(q, c, own, rows, ids, k, floor)
            i, vec, score = _best(np.concatenate([i, a]), np.concatenate([vec, ids[j]]), np.concatenate([score, s]), k)
            full = np.flatnonzero(np.bincount(i, minlength=len(q)) >= k)
            floor[full] = score[np.searchsorted(i, full, "right") - 1]
        out.append(pd.DataFrame({"query_row": own[i], "query_id": query_ids[i], "vec_id": vec, "score": score}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_row", "query_id", "vec_id", "score")})


def top_k(vectors: DataFrame, query: Column, k: int, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows (vec_id, embedding) of each row that is a query."""
    rows = integers(vectors, query)
    q, c = rows.where("is_query").select("row", "vec_id", "x"), rows.select("row", "vec_id", "x")
    n_q, n_c = max(1, math.ceil(q.count() / query_block)), max(1, math.ceil(c.count() / block))
    # runs are shorter where that would leave cores without work
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_runs = max(math.ceil(n_c / RUN), min(n_c, math.ceil(cores / n_q)))
    ids = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ("rows", "ids", "size", "type", "x")
    left = _blocks(q, n_q).withColumn("other", ids(n_runs)).select(F.col("block").alias("qb"), F.col("other").alias("cb"), "block", *columns)
    right = _blocks(c, n_c).withColumn("other", ids(n_q)).select(F.col("other").alias("qb"), F.pmod("block", F.lit(n_runs)).alias("cb"), "block", *columns)
    met = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(functools.partial(_meet, k), "query_row long, query_id long, vec_id long, score long")
    # a task has sent k rows of a query at most
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    real = lambda c: F.nullif(F.col(c), F.lit(_LAST)).alias(c)
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(real("query_id"), "rank", real("vec_id"), "score")
