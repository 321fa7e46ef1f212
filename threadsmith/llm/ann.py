"""Approximate nearest neighbours by collision counting.

Every vector is projected on ``m`` random directions; the values of each
direction are kept in one sorted array per block of vectors.  A query opens
a window around its own value in every array and widens all of them step by
step (virtual rehashing: the wider window is the coarser bucket); a vector
that lies in at least ``hits`` windows is verified by its exact distance.
Windows widen until enough vectors are verified.

Blocks bound what a task holds: every block of vectors meets every block of
queries, so a query meets all vectors, and a task holds one block of each.

Defined cases: vectors that are null, empty, zero, or have null or non-finite
components take no part; vectors of another dimension than the query are no
candidates; repeated rows of one id are one candidate each (all of them can be
in the result); fewer candidates than ``k`` give them all; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

DIRECTIONS = 48              # sorted arrays of a block
HIT_SHARE = 0.72             # windows a vector must lie in to be verified
STEPS = tuple(0.35 * 1.12 ** i for i in range(40))  # half widths, by the vectors' spread
VERIFY_SHARE = 0.25          # part of a block that is verified at least
BLOCK = 8192                 # vectors of a block
QUERY_BLOCK = 2048           # queries of a block
SEED = 20240229


def directions(dim: int, m: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((m, dim))


def candidates(vectors: np.ndarray, query: np.ndarray, proj: np.ndarray, order: np.ndarray, value: np.ndarray,
               at: np.ndarray, spread: float, need: int, hits: int) -> np.ndarray:
    """Places of the vectors that collide often enough.  ``order`` and
    ``value``: the sorted arrays; ``at``: the query's values."""
    n = len(vectors)
    count = np.zeros(n, dtype=np.int32)
    lo = hi = np.array([np.searchsorted(v, a) for v, a in zip(value, at, strict=True)])
    for step in STEPS:
        width = step * spread
        new_lo = np.array([np.searchsorted(v, a - width, "left") for v, a in zip(value, at, strict=True)])
        new_hi = np.array([np.searchsorted(v, a + width, "right") for v, a in zip(value, at, strict=True)])
        added = [o[a:b] for o, a, b in zip(order, new_lo, lo, strict=True)] \
            + [o[a:b] for o, a, b in zip(order, hi, new_hi, strict=True)]
        count += np.bincount(np.concatenate(added), minlength=n).astype(np.int32)
        lo, hi = new_lo, new_hi
        found = np.flatnonzero(count >= hits)
        if len(found) >= need:
            return found
    return np.arange(n)


def _search(k: int, m: int, share: float, verify: float):
    hits = max(1, int(round(share * m)))

    def run(key, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        by_dim = {d: g for d, g in data.groupby(data["embedding"].map(len))} if len(data) else {}
        for dim, q in (asked.groupby(asked["embedding"].map(len)) if len(asked) else ()):
            if dim not in by_dim:
                continue
            ids = by_dim[dim]["vec_id"].to_numpy(np.int64)
            v = np.stack(by_dim[dim]["embedding"].to_list()).astype(np.float64)
            a = directions(dim, m)
            proj = v @ a.T
            order = np.argsort(proj, axis=0, kind="stable").T.copy()
            value = np.take_along_axis(proj, order.T, axis=0).T.copy()
            spread = float(np.median(np.abs(proj - np.median(proj, axis=0)))) or 1.0
            need = min(len(ids), 4 * (k + 1) + int(verify * len(ids)))
            for qid, x in zip(q["vec_id"].to_numpy(np.int64), q["embedding"], strict=True):
                x = np.asarray(x, dtype=np.float64)
                c = candidates(v, x, proj, order, value, a @ x, spread, need, hits)
                c = c[ids[c] != qid]
                d = np.sqrt(((v[c] - x) ** 2).sum(axis=1))
                if len(c) > k:  # ties at the k-th place stay, the smaller id is chosen later
                    near = d <= np.partition(d, k - 1)[k - 1]
                    c, d = c[near], d[near]
                    if len(c) > k:
                        first = np.lexsort((ids[c], d))[:k]
                        c, d = c[first], d[first]
                out["query_id"] += [qid] * len(c)
                out["vec_id"] += ids[c].tolist()
                out["score"] += d.tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, zero, or with null or non-finite parts."""
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull())


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, m: int = DIRECTIONS, share: float = HIT_SHARE,
           verify: float = VERIFY_SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each query (both
    tables: vec_id, embedding)."""
    spark = vectors.sparkSession
    v, q = (usable(x.select("vec_id", "embedding")) for x in (vectors, queries))
    nb = max(1, -(-v.count() // BLOCK))
    nq = max(1, -(-q.count() // QUERY_BLOCK))
    split = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = v.withColumn("vb", split(nb, 1)).withColumn("qb", every(nq))
    right = q.withColumn("qb", split(nq, 2)).withColumn("vb", every(nb))
    near = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(
        _search(k, m, share, verify), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.repartition(shuffle_partitions(spark), "query_id").withColumn("rank", F.row_number().over(w)) \
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
