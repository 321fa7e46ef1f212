"""Centroid clustering with Ns-bounds.

Lloyd's rounds over integer vectors.  Every vector keeps, for each centroid,
the distance it last measured and the round of that measurement.  The driver
keeps the centroids of all rounds, so a stored distance is loosened by the norm
of the centroid's *total* displacement since that round: at most
``rounds x k`` numbers, looked up by (round, centroid).  (Summing the norms of
each round's drift would loosen it more, as a centroid that moves back and
forth ends up near its old place.)  A vector whose loosened own distance lies
below every other loosened distance keeps its centroid without a measurement;
the others measure their own centroid anew and then, exactly and in integers,
the centroids whose bound still fails.

A round is one map over the written state, without a shuffle of vectors: a
task gives the new state and, for each centroid, the sum of the vectors that
came and went.  Spark adds those up (decimals), and only ``k`` sums reach the
driver.  The state of a round is written to the shared folder and the one
before it is deleted.

Defined cases: a vector that is null, has another number of components than
``dim``, or a null or non-finite one takes no part (no row); nor does one whose
integers' squared norm is 2^60 or more, as its distance doesn't fit a long;
zero vectors take part.  Repeated rows are clustered each; vectors alike in
hash (one id) are ordered by their components; a null id is the text
``null`` there.  Fewer than ``k`` vectors give as many centroids; a tie goes to
the smaller number; a centroid without vectors stays where it is; inertias
beyond a long are null.  An empty table gives no rows; further columns are not
read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import prepare, remove_path

DIM = 64
K = 8
ROUNDS = 10
SCALE = 1024
SEED = "3"
MAX_NORM = 1 << 60           # squared norms from here on would not fit
SLACK = 1e-9                 # relative rounding error that a bound allows for
PAIRS = 1 << 15              # distances measured at once

_NAMES = ["vec_id", "at", "cluster", "far", "seen", "kind"]
_STATE = "vec_id long, at array<long>, cluster int, far array<double>, seen array<int>, kind int"


def integer_vectors(vectors: DataFrame, vec: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, at array<long>): the vectors that take part, as integers."""
    x = F.transform(F.col(vec), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    fine = (F.size(F.col(vec)) == dim) & F.forall(
        F.col(vec), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    norm = F.aggregate(F.col(vec), F.lit(0.0), lambda a, v: a + F.pow(F.lit(float(scale)) * v.cast("double"), F.lit(2.0)))
    return vectors.where(F.coalesce(fine & (norm < float(MAX_NORM)), F.lit(False))) \
        .select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("at"))


def first_centroids(rows: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The ``k`` vectors of smallest sha256 of ``seed:<vec_id>``, in that order."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    first = rows.select(F.sha2(name.cast("binary"), 256).alias("h"), "at").orderBy("h", "at").limit(k).collect()
    return np.array([r["at"] for r in first], dtype=np.int64)


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """[round, centroid]: how far the newest centroid lies from where it was
    in that round."""
    now = history[-1].astype(np.float64)
    return np.sqrt(np.array([((now - c) ** 2).sum(axis=1) for c in history]))


def _measure(at: np.ndarray, centroids: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (row, col)."""
    out = np.empty(len(row), dtype=np.int64)
    for i in range(0, len(row), PAIRS):
        d = at[row[i:i + PAIRS]] - centroids[col[i:i + PAIRS]]
        out[i:i + PAIRS] = np.einsum("ij,ij->i", d, d)
    return out


def assign(at: np.ndarray, cluster: np.ndarray | None, far: np.ndarray, seen: np.ndarray, now: int,
           centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, int]:
    """Nearest centroid of every vector in round ``now`` and the number of
    distances measured; ``far`` (distance last measured) and ``seen`` (its
    round) are brought up to date in place."""
    n, k = far.shape
    every = np.arange(n)
    if cluster is None:
        row, col = np.divmod(np.arange(n * k), k)
        d = _measure(at, centroids, row, col).reshape(n, k)
        far[:], seen[:] = np.sqrt(d), now
        return d.argmin(axis=1).astype(np.int32), n * k
    drift = moved[seen, np.arange(k)]
    low = (far - drift) * (1 - SLACK) - SLACK
    own = (far[every, cluster] + drift[every, cluster]) * (1 + SLACK) + SLACK
    low[every, cluster] = np.inf
    work = np.flatnonzero(low.min(axis=1) <= own)
    if not len(work):
        return cluster, 0
    # the own distance first: it may settle the rest
    exact = np.full((len(work), k), np.iinfo(np.int64).max, dtype=np.int64)
    own2 = _measure(at, centroids, work, cluster[work])
    exact[np.arange(len(work)), cluster[work]] = own2
    far[work, cluster[work]], seen[work, cluster[work]] = np.sqrt(own2), now
    row, col = np.nonzero(low[work] <= (np.sqrt(own2) * (1 + SLACK) + SLACK)[:, None])
    d = _measure(at, centroids, work[row], col)
    exact[row, col] = d
    far[work[row], col], seen[work[row], col] = np.sqrt(d), now
    cluster = cluster.copy()
    cluster[work] = exact.argmin(axis=1)  # the first of equal ones: the smaller number
    return cluster, len(work) + len(d)


def _matrix(col: pa.ListArray, n: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _lists(a: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(a).ravel()))


def _round(now: int, centroids: np.ndarray, moved: np.ndarray):
    """State rows -> new state rows (kind 0) and, per task, one row for each
    centroid that gained or lost vectors (kind 1: ``at`` is the change of its
    sum and ``vec_id`` that of its count)."""
    k, dim = centroids.shape

    def run(batches):
        total = np.zeros((k, dim), dtype=object)
        count = np.zeros(k, dtype=np.int64)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            at = _matrix(b.column(1), n).astype(np.int64)
            if now:
                was = b.column(2).to_numpy(zero_copy_only=False).astype(np.int32)
                far, seen = _matrix(b.column(3), n).copy(), _matrix(b.column(4), n).copy()
            else:
                was, far, seen = None, np.empty((n, k)), np.empty((n, k), dtype=np.int32)
            new, _ = assign(at, was, far, seen, now, centroids, moved)
            gone = np.arange(n) if was is None else np.flatnonzero(was != new)
            for j in np.unique(np.r_[new[gone], was[gone] if was is not None else new[:0]]).tolist():
                came = gone[new[gone] == j]
                left = gone[was[gone] == j] if was is not None else gone[:0]
                # object sums stay exact; a batch's own sum fits (norms are below 2^30, batches below 2^32 rows)
                total[j] += at[came].sum(axis=0).astype(object) - at[left].sum(axis=0).astype(object)
                count[j] += len(came) - len(left)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), _lists(at), pa.array(new, type=pa.int32()), _lists(far), _lists(seen),
                 pa.array(np.zeros(n, dtype=np.int32))], names=_NAMES)
        some = [j for j in range(k) if count[j] or any(total[j])]
        if some:
            none = [None] * len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(count[some]), pa.array([[int(x) for x in total[j]] for j in some], type=pa.list_(pa.int64())),
                 pa.array(np.array(some, dtype=np.int32)), pa.array(none, type=pa.list_(pa.float64())),
                 pa.array(none, type=pa.list_(pa.int32())), pa.array(np.ones(len(some), dtype=np.int32))], names=_NAMES)

    return run


def _changes(state: DataFrame) -> list:
    """(centroid, place, change of the sum, change of the count): k x dim rows."""
    part = state.where("kind = 1")
    return part.select("cluster", F.col("vec_id").alias("n"), F.posexplode("at").alias("j", "s")) \
        .groupBy("cluster", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"),
                                     F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()


def moved_centroids(centroids: np.ndarray, sums: list[list[int]], counts: list[int]) -> np.ndarray:
    """Componentwise floor(sum / count); a centroid without vectors stays."""
    return np.array([[s // n for s in row] if n else list(c) for c, row, n in zip(centroids, sums, counts, strict=True)],
                    dtype=np.int64)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: str = SEED,
            vec: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of
    every vector that takes part."""
    spark = prepare(vectors.sparkSession)
    rows = integer_vectors(vectors, vec, dim, scale)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string")
    k = len(centroids)
    state = rows.select("vec_id", "at", F.lit(None).cast("int").alias("cluster"),
                        F.lit(None).cast("array<double>").alias("far"), F.lit(None).cast("array<int>").alias("seen"))
    sums, counts = [[0] * dim for _ in range(k)], [0] * k
    history, before = [centroids], None
    for now in range(rounds + 1):
        path = scratch_path(spark, f"centroids-{now}")
        state.mapInArrow(_round(now, history[-1], displacements(history)), _STATE) \
            .write.partitionBy("kind").parquet(path)
        if before:
            remove_path(spark, before)
        before = path
        new = spark.read.schema(_STATE).parquet(path)
        state = new.where("kind = 0").select("vec_id", "at", "cluster", "far", "seen")
        if now == rounds:
            break
        for r in _changes(new):
            sums[r["cluster"]][r["j"]] += int(r["s"])
            if r["j"] == 0:
                counts[r["cluster"]] += int(r["n"])
        history.append(moved_centroids(history[-1], sums, counts))
    return _result(state, history[-1])


def _result(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    spark = state.sparkSession
    places = spark.createDataFrame(
        [(j, [int(x) for x in c], hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
         for j, c in enumerate(centroids)], "cluster int, centre array<long>, centroid_sha256 string")
    gap = F.aggregate(F.zip_with("at", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"),
                      lambda a, b: a + b)
    near = state.join(F.broadcast(places), "cluster").select("vec_id", "cluster", gap.alias("distance"),
                                                             "centroid_sha256")  # k rows
    per = near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    whole = sum((r["s"] for r in per), Decimal(0))
    fits = lambda x: int(x) if x < 1 << 63 else None
    sizes = spark.createDataFrame([(r["cluster"], fits(r["s"])) for r in per], "cluster int, cluster_inertia long")
    return near.join(F.broadcast(sizes), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(fits(whole)).cast("long").alias("inertia"),
        "centroid_sha256")
