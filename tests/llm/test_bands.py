"""Sets whose partner lies in the next size band still share a chosen part."""

import numpy as np

from threadsmith.llm import jaccard


def test_d_covers_every_partner():
    for n in range(3, 800):
        for m in range(n, n * 100 // jaccard.SHARE + 1):
            need = jaccard.most_apart(n, m)
            small, large = dict(jaccard.bands_of(n)), dict(jaccard.bands_of(m))
            both = small.keys() & large.keys()
            assert any(small[b] >= need and large[b] >= need for b in both), (n, m)


def test_subsets_across_bands_share_a_part():
    """A set wholly inside a larger one that is exactly 75 % apart, with the
    parts of the larger one hot."""
    rng = np.random.default_rng(5)
    for n, m, tries in ((9, 12, 6000), (11, 14, 2000), (36, 48, 1000), (47, 62, 1000), (144, 192, 200), (191, 254, 200)):
        for _ in range(tries):
            b = np.unique(rng.integers(1, 1 << 63, m).astype(np.uint64))
            a = np.sort(rng.choice(b, n, replace=False))
            keys = [{bd: jaccard.part_keys(s, *bd) for bd in jaccard.bands_of(len(s))} for s in (a, b)]
            shared = np.intersect1d(*[np.concatenate([k for k, _ in ks.values()]) for ks in keys])
            for r in (jaccard.Rarity((np.zeros(0, np.uint64), np.zeros(0, np.int64))),
                      jaccard.Rarity((shared, np.full(len(shared), 99)))):
                chosen = [set(np.concatenate([r.rarest(*k) for k in ks.values()]).tolist()) for ks in keys]
                assert chosen[0] & chosen[1], (n, m)
