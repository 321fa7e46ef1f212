"""Subword-embedding classifier: scores against the plain average, learning
against held-out rows, and the defined cases."""

import random
import zlib

import numpy as np

from threadsmith.llm import quality_model as Q

RND = random.Random(3)
GOOD = "river stone meadow quiet lantern window harbour winter garden letter".split()


def _text(good):
    w = RND.choices(GOOD, k=RND.randint(5, 60))
    if not good:
        kind = RND.randrange(3)
        if kind == 0:
            w = [x + "$$%" for x in w]
        elif kind == 1:
            w = [x for x in w[:5] for _ in range(12)]
        else:
            w = [x.upper() + "!!" for x in w]
    return " ".join(w)


def test_held_out_rows_and_defined_cases(spark):
    rows = [(i, _text(i % 4 != 0), int(i % 4 != 0)) for i in range(600)]
    docs = [(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, " \n\t"), (None, "no id"), (5, rows[5][1]),
                                           (1003, "x" * 20_000), (1004, "river " + "stone meadow " * 9000)]
    d = spark.createDataFrame([(*r, "a", 1) for r in docs], "doc_id long, text string, quality string, k int")
    lab = spark.createDataFrame([(i, q, "x") for i, _, q in rows] + [(0, 1, "x"), (None, 1, "x"), (7, None, "x"), (8, 5, "x")],
                                "doc_id long, quality int, text string")
    got = Q.train_and_score(d, lab).collect()
    assert len(got) == len(docs)
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(r.held_out is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
               for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    empties = {r.score for r in got if r.doc_id in (1000, 1001, 1002)}
    assert len(empties) == 1 and len({r.score for r in got if r.doc_id == 5}) == 1
    assert {r.doc_id: r.predicted for r in got}[1004] == 1
    for none in (lab.limit(0), lab.where("quality = 1")):
        assert {r.score for r in Q.train_and_score(d, none).collect()} == {0.5}
    assert Q.train_and_score(d.limit(0), lab).count() == 0
    assert Q.train_and_score(d, lab).collect() == got  # reruns agree


def test_scorer_is_the_softmax_of_the_average(monkeypatch):
    docs = [_text(i % 2) for i in range(60)]
    feats = [Q.document_features(t) for t in docs]
    model = Q.descend(feats, np.arange(60) % 2, (1, 1), epochs=1)
    table, layer, bias = (x.astype(np.float64) for x in model)
    monkeypatch.setattr(Q, "CACHE_WORDS", 20)
    s = Q.Scorer(model)
    for t, (ids, n) in zip(docs + ["", "word"], feats + [Q.document_features(""), Q.document_features("word")], strict=True):
        h = (n / max(1, n.sum())) @ table[ids] if len(ids) else np.zeros(Q.WIDTH)
        z = h @ layer + bias
        assert abs(s.score([t])[0] - np.exp(z[1]) / np.exp(z).sum()) < 1e-5


def test_features_of_words():
    ids, at = Q.word_features(["ab", "a", "ab", "漢字"])
    assert at.tolist() == [0, 7, 11, 18, 25]  # <ab>: the word, 3 pairs, 2 triples, 1 of four
    assert ids[:7].tolist() == ids[11:18].tolist() and ids.max() < Q.BUCKETS
    # a word alone has the features it has among others
    assert Q.word_features(["漢字"])[0].tolist() == ids[18:].tolist()
    u, n = Q.document_features("so so so  what")
    assert u[-1] == Q.BUCKETS and n[-1] == 2


def test_step_lowers_the_loss():
    docs = [Q.document_features("alpha beta"), Q.document_features("gamma delta")]
    y = np.array([0, 1])

    def loss(m):
        table, layer, bias = m
        out = 0.0
        for (ids, n), k in zip(docs, y, strict=True):
            z = (n / n.sum()) @ table[ids] @ layer + bias
            out -= z[k] - np.log(np.exp(z).sum())
        return out

    assert loss(Q.descend(docs, y, (1, 1), epochs=20)) < 0.2 < loss(Q.descend(docs, y, (1, 1), epochs=0))
