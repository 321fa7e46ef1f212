"""Groups whose members are not near copies of their first class: what they
give, how it travels, and that no link is lost whatever is kept of it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadsmith.llm import jaccard


def _variants(n_groups=12, words=90, copies=9, seed=3):
    """Groups of texts with one block in common: some pairs link, some don't."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n_groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice((1, 2, 3, 4))):
                t[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    return rows


def _brute(rows):
    sets = [frozenset(s.tolist()) for s in jaccard.shingle_sets([t for _, t in rows])]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: root(i) for i in range(len(rows))}


@pytest.mark.parametrize("listed", (0, 8))
def test_components_equal_brute_force(spark, monkeypatch, listed):
    monkeypatch.setattr(jaccard, "LISTED_PAIRS", listed)
    rows = _variants()
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == _brute(rows)


def test_folded_sketch_is_a_quarter_and_bounds_the_difference(spark):
    rng = np.random.default_rng(2)
    sets = []
    for n in (3, 60, 130, 700, 3000):
        a = np.unique(rng.integers(1, 1 << 63, n).astype(np.uint64))
        sets += [a, np.unique(np.r_[a[:-max(1, n // 20)], rng.integers(1, 1 << 63, 2).astype(np.uint64)])]
    rows = [(i, jaccard.sketch(s).tolist()) for i, s in enumerate(sets)]
    short = jaccard._folded(spark.createDataFrame(rows, "i int, sk array<long>"))
    a, b = short.select(F.col("i").alias("ia"), F.col("short").alias("sa")), short.select("i", "short")
    for i, w in short.select("i", F.size("short")).collect():
        assert w == max(min(len(rows[i][1]), jaccard.WHOLE_WORDS), len(rows[i][1]) // 4)
    for i, j, d in a.join(b, F.col("i") == F.col("ia") + 1).where("ia % 2 = 0") \
            .select("ia", "i", jaccard._hamming(F.col("sa"), F.col("short"))).collect():
        assert d <= len(np.setxor1d(sets[i], sets[j]))


def test_other_close_pairs_are_given_once():
    row = lambda n, c, sk: (n, c, c, 0, sk, 64)
    first, others = jaccard._close_pairs([row(40, c, c % 2) for c in range(4)], False, True)
    assert len(first) == 3 and len(others) == 3 and not first & others
    assert jaccard._close_pairs([row(40, 0, 0), row(40, 1, 1), row(40, 2, (1 << 40) - 1)], False, True) == ({(0, 1)}, set())


def test_found_links_join_components(spark):
    comp = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, label long")
    found = spark.createDataFrame([(2, 6), (3, 9), (1, 2), (11, 12)], "a long, b long")
    got = {r.node: r.label for r in jaccard._joined(comp, found).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 3, 9: 3, 3: 3, 11: 11, 12: 11}
