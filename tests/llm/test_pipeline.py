"""The pipeline: what each stage must drop or keep on the test table, and run()
against plain Python on a small corpus."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers as P

import corpus_pipeline as C
from tests.llm.test_operators import _repeats
from threadsmith.llm import byte_bpe, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in C.STAGES[:-1]:
        out = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name == "jaccard_join":
            assert docs.select("doc_id").distinct().count() == docs.count() < n
    assert C.STAGES[-1][1](spark, docs, sf).count() == docs.count() > 0


def _linked(a, b):
    return bool(a) and 100 * len(a & b) >= 75 * len(a | b)


def _survivors(rows):
    """One row of each component of near copies (the smallest id)."""
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if _linked(sets[i], sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        k = find(i) if sets[i] else ("alone", i)
        best[k] = min(best.get(k, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    return list(best.values())


def _mixed(rows):
    """How often the mix takes each row."""
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    per = Counter()
    for r, s in zip(rows, size, strict=True):
        per[r[3]] += s
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * per[s]}
        for s in over or open_:
            target[s] = 2.0 * per[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    out = []
    for r in rows:
        rate = target[r[3]] / per[r[3]] if per[r[3]] else 0.0
        name = "null" if r[0] is None else str(r[0])
        coin = int(hashlib.md5(f"mix:{name}".encode()).hexdigest()[:8], 16) / 4294967296.0
        out += [r] * (int(rate) + (coin < rate - int(rate)))
    return out


def test_run_equals_plain_python(spark, tmp_path):
    import tiktoken
    rnd = random.Random(21)
    vocab = ["".join(rnd.choices("abcdeéfgh", k=rnd.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choices(vocab, k=n))
    passage, base = text(60), text(150)
    texts = [None, "", " \n", "one", base, base + " " + text(4), base, text(80) + " " + passage + " " + text(30),
             passage + " " + text(90), text(40), text(200) + "\n" + passage, "I will kill you. " * 30,
             *[text(rnd.randint(1, 120)) for _ in range(25)], passage]
    rows = [(i, t, "en", [None, "s0", "s1", "s2"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows.append((None, text(50), "en", "s1", 1))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = C.run(spark, str(tmp_path)).collect()

    score = toxicity.Scorer(([], [], toxicity.PLAIN)).score([r[1] for r in rows])
    left = [r for r, s in zip(rows, score, strict=True) if s < toxicity.THRESHOLD]
    assert len(left) < len(rows)
    left = _survivors(left)
    assert len(left) < sum(s < toxicity.THRESHOLD for s in score)
    raw = [(r[1] or "").encode() for r in left]
    kept = []
    for r, t, (n, gone, _, _) in zip(left, raw, _repeats(raw, C.PASSAGE_BYTES), strict=True):
        if gone == 0:
            kept.append(r)
        elif gone < n:
            cut = _without(t, raw, C.PASSAGE_BYTES)
            kept.append((r[0], cut.decode("utf-8", "ignore"), *r[2:]))
    assert any(k[1] != r[1] for k in kept for r in left if k[0] == r[0])
    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    want = Counter()
    for r in _mixed(kept):
        ids = b"".join(x.to_bytes(4, "little") for x in lib.encode_ordinary(r[1] or ""))
        want[r[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), ids] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in got) == want


def _without(t, texts, n):
    """``t`` without the bytes of its strings of ``n`` bytes that also start
    elsewhere."""
    seen = Counter(x[s:s + n] for x in texts for s in range(len(x) - n + 1))
    on = bytearray(len(t))
    for s in range(len(t) - n + 1):
        if seen[t[s:s + n]] > 1:
            on[s:s + n] = b"\x01" * n
    return bytes(b for b, x in zip(t, on, strict=True) if not x)
