"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that begin a word and pieces
that go on.  Each node has a failure link (where matching goes on when no
child fits) and the number of pieces that are popped on the way there, so a
word's greedy longest-match length comes from one pass over its characters,
without building pieces.  A worker remembers the counts of words it has met.

Defined cases: null and empty texts have no words and no tokens; a word that
the vocabulary can't cover counts as one unknown token; repeated rows give
repeated rows; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, per_worker, rows_to_batch, text_blocks

BLOCK_CHARS = 4_000_000
CACHE_WORDS = 500_000
UNKNOWN = 1 << 32            # added to the count of a word that can't be covered
BEGIN = "▁"             # what pieces that begin a word start with


def read_pieces(model_path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, pieces that go on) of a vocabulary file."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    begin, inner = [], []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        p = sp.id_to_piece(i)
        if p.startswith(BEGIN):
            begin.append(p[len(BEGIN):])
        else:
            inner.append(p)
    return [p for p in begin if p and BEGIN not in p], [p for p in inner if p and BEGIN not in p]


def build_automaton(begin: list[str], inner: list[str]) -> dict:
    """child: one dict per node (0: root of words, 1: root of the rest); fail
    and popped: link and count of each node."""
    child: list[dict] = [{}, {}]
    final = [False, False]
    for root, pieces in ((0, begin), (1, inner)):
        for p in pieces:
            v = root
            for c in p:
                u = child[v].get(c)
                if u is None:
                    u = child[v][c] = len(child)
                    child.append({})
                    final.append(False)
                v = u
            final[v] = True
    fail, popped = [-1] * len(child), [0] * len(child)
    queue = deque((0, 1))
    while queue:
        v = queue.popleft()
        for c, u in child[v].items():
            if final[u]:
                fail[u], popped[u] = 1, 1
            else:
                z, n = fail[v], popped[v]
                while z >= 0 and c not in child[z]:
                    n += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[u], popped[u] = child[z][c], n
            queue.append(u)
    return {"child": child, "fail": fail, "popped": popped}


class Counter(dict):
    """Word -> tokens (plus UNKNOWN if it can't be covered)."""

    def __init__(self, automaton: dict):
        super().__init__()
        self.child, self.fail, self.popped = automaton["child"], automaton["fail"], automaton["popped"]

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = n
        return n

    def count(self, word: str) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        v, n = 0, 0
        for c in word:
            while c not in child[v]:
                if fail[v] < 0:
                    return 1 + UNKNOWN
                n += popped[v]
                v = fail[v]
            v = child[v][c]
        while v != 1:  # the word's end: pop what is left
            if fail[v] < 0:
                return 1 + UNKNOWN
            n += popped[v]
            v = fail[v]
        return n


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every whole text."""
    bc = docs.sparkSession.sparkContext.broadcast({"value": build_automaton(*read_pieces(model_path))})
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()),
                        ("n_unknown", pa.int64())])

    def run(batches):
        counter = per_worker(bc, Counter)
        words = re.compile(WORD)
        for ids, texts in text_blocks(batches, BLOCK_CHARS):
            n_words, total = [], []
            for t in texts:
                ws = words.findall(t) if t else []
                n_words.append(len(ws))
                total.append(sum(map(counter.__getitem__, ws)))
            yield rows_to_batch({"doc_id": ids, "n_words": n_words, "n_tokens": [x & (UNKNOWN - 1) for x in total],
                                 "n_unknown": [x >> 32 for x in total]}, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
