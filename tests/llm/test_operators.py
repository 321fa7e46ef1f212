"""Each operator against brute force or the library it must equal, and on
nulls, empty and long texts, ties, repeated rows, empty tables and further
columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from threadsmith.llm import (ann, byte_bpe, jaccard, language, line_quality, mixing, suffixes, token_files, toxicity,
                             wordpiece)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RND = random.Random(7)
VOCAB = ["alpha", "beta", "gamma", "delta", "éta", "the", "of", "and", "漢字", "x1", "don't", "end."]


def _text(n):
    return " ".join(RND.choice(VOCAB) for _ in range(n))


BASE = _text(400)
TEXTS = [None, "", "   \n", "one", "ONE", "a b c d", "A b C d", BASE, BASE, BASE.replace("alpha", "omega", 3),
         _text(120) + "\n" + BASE[:900], BASE[200:1500], "z" * 5000, ("same words again " * 60).strip(),
         "\n".join(["line one here."] * 5 + [_text(30)])] + [_text(RND.randint(1, 80)) for _ in range(12)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "s1", "s2", "s0"][i % 4], 7) for i, t in enumerate(TEXTS)]
    rows.append(rows[8])  # a repeated row
    rows.append((None, "no id here", "en", "s1", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def _rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_jaccard_join(docs, empty):
    sets = {}
    rows = _rows(docs)
    for k, (_, t) in enumerate(rows):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in sets:
        groups[find(i)].append(rows[i][0])
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    want = sorted(((rows[i][0], len(sets[i]), least(groups[find(i)]) if sets[i] else rows[i][0]) for i in sets), key=str)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == want
    assert jaccard.near_duplicates(empty).count() == 0


def test_part_keys_keep_every_link():
    """Sets at the threshold share a chosen part, whatever parts are hot."""
    rng = np.random.default_rng(3)
    for n in (3, 7, 13, 40, 97, 260, 700):
        for _ in range(20):
            a = np.unique(rng.integers(1, 1 << 63, n).astype(np.uint64))
            gone = jaccard.most_apart(len(a), len(a)) // 2
            b = np.unique(np.r_[a[gone:], rng.integers(1, 1 << 63, gone).astype(np.uint64)])
            keys = {x: jaccard.bands_of(len(x_)) for x, x_ in (("a", a), ("b", b))}
            hot = np.unique(np.concatenate([jaccard.part_keys(a, *bd)[0][::2] for bd in keys["a"]]))
            r = jaccard.Rarity((hot, np.full(len(hot), 99)))
            chosen = [set(np.concatenate([r.rarest(*jaccard.part_keys(s, *bd)) for bd in keys[k]]).tolist())
                      for k, s in (("a", a), ("b", b))]
            assert chosen[0] & chosen[1]


def test_token_files(docs, empty):
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = token_files.read_token_files(token_files.write_token_files(docs, path, parts=3)).collect()
    got = sorted(got, key=lambda r: r.start)
    want = sorted(_rows(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for r, (_, t) in zip(got, want, strict=True):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(empty, path)).count() == 0


def test_chunks_encode_as_whole_texts():
    from tokenizers import Tokenizer
    js = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    tok, enc = Tokenizer.from_str(js), token_files.ChunkEncoder(js, 2)
    al = "aaAbeEéÉßİΣσſ  \n\t'\x85\xa0\x1c漢ǅ's!.,<|12½ªµ"
    texts = ["".join(RND.choice(al) for _ in range(60)) for _ in range(300)]
    texts += ["a<|endoftext|>b <|ENDOFTEXT|> c's'S'LL!'s"]
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((900, 16)).astype(np.float32)
    v[1] = v[0]
    rows = [(i, [float(x) for x in v[i]]) for i in range(900)]
    rows += [(901, None), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (1000, [1.0, 2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.search(d, d.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 900, 100):
        dist = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(900), dist)) if i != q][:10]
        hits += len(set(best) & {i for i, _ in got[q]})
        assert all(abs(dist[i] - s) < 1e-12 for i, s in got[q]) and len(got[q]) == 10
    assert hits >= 0.9 * 90 and got[0][0][0] == 1 and 1000 not in got
    assert ann.search(d.limit(0), d.limit(0)).count() == 0


def test_mixing(docs, empty):
    p = mixing.mix_plan(docs).collect()
    assert [r.size for r in sorted(p, key=lambda r: (r.doc_id is None, r.doc_id or 0))][:4] == [0, 0, 0, 1]
    total, seen = sum(r.size for r in p), {}
    for r in p:
        seen[r.source_size, r.target] = 1
        assert r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-9
    assert abs(sum(t for _, t in seen) - 1.5 * total) < 1e-6
    assert Counter(map(str, p)) == Counter(map(str, mixing.mix_plan(docs).collect()))
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_plan(empty).count() == 0


def test_wordpiece(docs, empty):
    begin, inner = wordpiece.read_pieces(P.path("piece_bpe_32k.model"))
    b, i = set(begin), set(inner)

    def greedy(w):
        n, at = 0, 0
        while at < len(w):
            pool = i if at else b
            k = next((k for k in range(len(w), at, -1) if w[at:k] in pool), None)
            if k is None:
                return 1, 1
            n, at = n + 1, k
        return n, 0

    c = wordpiece.Counter(wordpiece.build_automaton(begin, inner))
    for w in ["unbelievable", "don't", "ßx", "漢字", "xqzj", "a" * 300] + ["".join(RND.choices("aeinrstx'é", k=9)) for _ in range(300)]:
        assert (c[w] & 0xFFFFFFFF, c[w] >> 32) == greedy(w), w
    got = wordpiece.token_counts(docs, P.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(TEXTS) + 2 and {r.n_words for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert wordpiece.token_counts(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_language(docs, empty, spark):
    words = {"en": "the house and water with from there", "de": "das haus und wasser mit nicht dort über",
             "fr": "la maison et eau avec très là où", "es": "la casa y agua con desde allí señor"}
    rows = [(i, " ".join(RND.choices(words[x].split(), k=20)), x) for i in range(240) for x in [list(words)[i % 4]]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.train_and_identify(d).collect()
    want = {i: x for i, _, x in rows}
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    odd = {r.doc_id: r for r in language.train_and_identify(docs).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == "und"
    assert language.train_and_identify(empty).count() == 0


def test_toxicity(docs, empty, spark):
    clean = "the river and hills were quiet in that long summer".split()
    rows, labels = [], []
    for i in range(300):
        w = RND.choices(clean, k=30)
        if i % 3 == 0:
            w.insert(RND.randrange(30), RND.choice(["grobnak", "zzidiot", "vexulo", "vexula"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0), "x"))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + labels[:5] + [(None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, n string")
    got = toxicity.train_and_score(d, lab).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 3 == 0) for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert toxicity.train_and_score(docs, lab.limit(0)).count() == len(TEXTS) + 2
    assert toxicity.train_and_score(empty, lab).count() == 0
    assert toxicity.clause_weights(b"..I|N.I|YI|..|T.Y") == pytest.approx([1.0, 0.6, 1.3, 1.0])


def _repeats(texts, n):
    seen = Counter(t[s:s + n] for t in texts for s in range(len(t) - n + 1))
    out = []
    for t in texts:
        on = np.zeros(len(t) + 1, dtype=int)
        for s in range(len(t) - n + 1):
            if seen[t[s:s + n]] > 1:
                on[s] += 1
                on[s + n] -= 1
        on = np.cumsum(on)[:-1] > 0
        out.append((len(t), int(on.sum()), int((np.diff(np.r_[0, on.astype(int)]) == 1).sum()),
                    hashlib.sha256(bytes(b for b, x in zip(t, on, strict=True) if not x)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [20_000, 1])
def test_repeated_strings(docs, empty, group):
    rows = _rows(docs)
    want = _repeats([(t or "").encode() for _, t in rows], 60)
    got = suffixes.remove_repeats(docs, length=60, window=16, group=group) \
        .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *w)) for (i, _), w in zip(rows, want, strict=True))
    assert suffixes.remove_repeats(empty).count() == 0


def test_byte_bpe(docs, empty):
    import tiktoken
    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    want = Counter()
    for i, t in _rows(docs):
        ids = np.array(lib.encode_ordinary(t or ""), dtype="<u4").tobytes()
        want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, byte_bpe.encode(docs, path, P.PATTERN).collect())) == want
    assert byte_bpe.encode(empty, path, P.PATTERN).count() == 0


def test_byte_bpe_any_vocabulary():
    """Also where a merged pair may merge again at a lower rank."""
    import regex
    import tiktoken
    for _ in range(60):
        ranks = {bytes([i]): i for i in range(256)}
        for p in {bytes(RND.choices(b"abc", k=RND.randint(2, 6))) for _ in range(40)}:
            ranks[p] = len(ranks)
        lib = tiktoken.Encoding("o", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        bpe = byte_bpe.ByteBpe(byte_bpe.merge_table(ranks))
        texts = ["".join(RND.choices("abc", k=RND.randint(1, 60))) for _ in range(20)]
        for t, ids in zip(texts, bpe.encode(texts, regex.compile(r"\S+")), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t)


def test_line_quality(docs, empty):
    got = Counter()
    for r in line_quality.quality(docs).collect():
        got[r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] += 1
    want = Counter()
    for i, t in _rows(docs):
        w = WORD.findall(t or "")
        grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        rep = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)),
             len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)] += 1
    assert got == want
    assert line_quality.quality(empty).count() == 0 and line_quality.clean(docs).columns == docs.columns
