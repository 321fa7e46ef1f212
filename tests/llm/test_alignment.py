"""Alignment against the two tokenizers run on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from threadsmith.llm import alignment as A

JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
RND = random.Random(5)
ODD = "ab cé  漢字\n\t😀'sZ.,  ö‍<0x0A>­ \xa0　 ﬁ1½"


def _texts():
    out = [None, "", " ", "  ", "a", "a ", " a", "  a  b  ", "x\n y", "x \n y ", "a▁b", "▁", "<|endoftext|> <s> </s>",
           "don't stop\nHello", "漢字漢字 漢", "z" * 3000, "the cat " * 300, "é" * 400, "a  b   c    d", "\x00 \x1c a"]
    out += ["".join(RND.choice(ODD) for _ in range(RND.randint(1, 80))) for _ in range(150)]
    return out + [out[13], out[13]]


def brute(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(JSON), SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    alphabet = A.byte_level_alphabet()
    piece = {i: p for p, i in a.get_vocab().items()}
    done, counts = [], Counter()
    for i, t in rows:
        ids_a = a.encode(" " + (t or ""), add_special_tokens=False).ids
        ids_b = b.encode(t or "")
        raw_a = [bytes(alphabet[c] for c in piece[x]) for x in ids_a]
        raw_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode()
                 for x in ids_b]
        want = (" " + (t or "")).encode()
        if not t or b"".join(raw_a) != want or b"".join(raw_b) != want:
            done.append((i, None))
            continue
        ends = []
        for parts in (raw_a, raw_b):
            at = 0
            ends.append([at := at + len(x) for x in parts])
        links = [(x, y) for x, e in zip(ids_a, ends[0]) for y, f in zip(ids_b, ends[1]) if e == f]
        cuts = [0, *sorted(set(ends[0]) & set(ends[1]))]
        groups = ["|".join(",".join(str(x) for x, e in zip(ids, en) if lo < e <= hi)
                           for ids, en in ((ids_a, ends[0]), (ids_b, ends[1]))) for lo, hi in zip(cuts, cuts[1:])]
        counts.update(links)
        done.append((i, (len(ids_a), len(ids_b), groups, links)))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for i, d in done:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        out.append((i, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("listed", [A.LISTED, 40])
def test_alignment_equals_whole_texts(spark, listed):
    rows = [*enumerate(_texts()), (None, "no id"), (3, "twice"), (3, "twice")]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, pair int")
    got = A.align(d, JSON, MODEL, listed=listed).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
    assert A.align(d.limit(0), JSON, MODEL).count() == 0


def test_groups_text(spark):
    d = spark.createDataFrame([(1, "hé 漢")], "doc_id long, text string")
    r = A.align(d, JSON, MODEL, with_groups=True).collect()[0]
    assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and r.groups.count(";") + 1 == r.n_groups


def test_spans_are_refined_by_bytes():
    ends = lambda b, e, n: A.byte_ends(np.array(b), np.array(e), np.array(n)).tolist()
    # three tokens share a character of three bytes; then a plain one
    assert ends([0, 1, 1, 1, 4], [1, 4, 4, 4, 5], [1, 1, 1, 1, 1]) == [1, 2, 3, 4, 5]
    assert ends([0, 1, 1, 1, 4], [1, 1, 1, 4, 5], [1, 1, 1, 1, 1]) == [1, 2, 3, 4, 5]
    assert ends([0], [3], [3]) == [3] and ends([], [], []) == []
    assert A.group([7, 8], [2, 4], [5, 6, 9], [1, 2, 4]) == ("7|5,6;8|9", [(7, 6), (8, 9)])


def test_a_small_memory_gives_the_same(monkeypatch):
    js, model = open(JSON, encoding="utf-8").read(), open(MODEL, "rb").read()
    texts = [t for t in _texts() if t]
    one = [(x[0], x[2]) if x else None for x in A.Aligner(js, model).block(texts)]
    monkeypatch.setattr(A, "CACHE_CHUNKS", 5)
    monkeypatch.setattr(A, "LONG_CHUNK", 3)
    monkeypatch.setattr(A, "JOINED_CHARS", 30)
    small = A.Aligner(js, model)
    assert [(x[0], x[2]) if x else None for t in texts for x in small.block([t])] == one


def test_tokenizers_that_join_across_blanks_get_whole_texts():
    assert not A.Aligner.cuts_at_blanks(["a▁b"]) and A.Aligner.cuts_at_blanks(["▁▁", "▁a"])
