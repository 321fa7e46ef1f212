"""Centroid clustering against plain rounds in Python integers."""

import hashlib
import math

import numpy as np

from threadsmith.llm import centroids as C


def plain(rows, k=8, rounds=10):
    """[(vec_id, cluster, distance)], centroids by the contract."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [list(v) for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, *nearest(v)[::-1]) for i, v in kept], c


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((5, 64)) * 2
    v = (base[rng.integers(0, 5, 300)] + rng.standard_normal((300, 64))).astype(np.float32)
    v[7] = v[8]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)]
    rows += [(300, [0.0] * 64), (5, rows[5][1]), (5, rows[6][1]), (None, rows[9][1]), (301, None), (302, [1.0]),
             (303, [None] * 64), (304, [float("nan")] * 64), (305, [float("inf")] * 64), (306, []), (307, [0.0] * 65)]
    d = spark.createDataFrame([(i, x, 3, 4) for i, x in rows],
                              "vec_id long, embedding array<float>, cluster int, at int")
    want, cent = plain(rows)
    got = C.cluster(d).collect()
    assert sorted(map(str, [(r.vec_id, r.cluster, r.distance) for r in got])) == sorted(map(str, want))
    sums = [sum(w[2] for w in want if w[1] == j) for j in range(8)]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    assert all(r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums)
               and r.centroid_sha256 == names[r.cluster] for r in got)


def test_few_and_no_vectors(spark):
    few = [(i, [float(i % 2)] * 64) for i in range(5)]  # ties: equal vectors are several centroids
    d = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    want, _ = plain(few)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in C.cluster(d).collect()) == sorted(want)
    assert C.cluster(d.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [1e30] * 64), (2, [1.5] * 64)], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.distance) for r in C.cluster(huge).collect()] == [(2, 0)]


def test_bounds_save_measurements_and_keep_the_nearest():
    """A centroid that moves away and comes back costs nothing again: its
    total displacement is small, though the sum of its drifts isn't."""
    rng = np.random.default_rng(2)
    c = rng.integers(-4000, 4000, (6, 64))
    at = c[rng.integers(0, 6, 500)] + rng.integers(-300, 300, (500, 64))
    far, seen = np.empty((500, 6)), np.empty((500, 6), dtype=np.int32)
    history, cluster = [c], None
    for now in range(6):
        cluster, work = C.assign(at, cluster, far, seen, now, history[-1], C.displacements(history))
        d = ((at[:, None, :] - history[-1][None]) ** 2).sum(axis=2)
        assert (cluster == d.argmin(axis=1)).all()
        assert work == 3000 if now == 0 else work < 3000
        if now == 2:
            assert work < 100
        history.append(history[0] + (rng.integers(-2000, 2000, c.shape) if now == 0 else rng.integers(-9, 9, c.shape)))
