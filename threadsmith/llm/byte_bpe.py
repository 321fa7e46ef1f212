"""Byte-level BPE by a rank queue with a hierarchical bitmap.

All unseen pre-tokens of a block of documents are laid out as one linked list
of symbols with barriers between them.  Every adjacent pair that the
vocabulary can merge lies in the bucket of its rank; a bitmap of three levels
finds the first filled bucket (find-first-set); all pairs of the bucket that
are still valid are merged together, left to right, and the pairs they form
are put into their own buckets.  Entries whose pair has changed meanwhile are
stale and skipped.  Work grows with symbols and merges, not with the square
of a pre-token's length, so a pre-token of a million characters is no
problem.

Documents are cut into chunks (white space and what follows), which the
splitting pattern never joins, and a worker remembers the ids of chunks and
pre-tokens it has met.

Defined cases: null and empty texts have no ids; repeated rows give repeated
rows; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import per_worker, rows_to_batch, text_blocks

BLOCK_CHARS = 3_000_000      # characters encoded at once
CACHE_ENTRIES = 150_000      # chunks and pre-tokens a worker remembers
# Characters with the Unicode property White_Space (fixed values): the
# pattern's \s.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+\\Z")
NONE = 1 << 30               # rank of a pair that can't merge


class RankQueue:
    """Positions by merge rank; ``pop`` gives the lowest filled rank."""

    def __init__(self, n_ranks: int):
        self.bits = [[0] * ((n_ranks >> s) + 1) for s in (6, 12)]
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, at: np.ndarray) -> None:
        if len(ranks) > 1:
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            groups = zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True) if len(cuts) \
                else [(int(ranks[0]), at)]
        else:
            groups = [(int(ranks[0]), at)] if len(ranks) else []
        for r, p in groups:
            if (old := self.buckets.get(r)) is not None:
                old.append(p)
                continue
            self.buckets[r] = [p]
            self.bits[0][r >> 6] |= 1 << (r & 63)
            self.bits[1][r >> 12] |= 1 << (r >> 6 & 63)
            self.top |= 1 << (r >> 12)

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.top:
            return None
        first = lambda x: (x & -x).bit_length() - 1
        a = first(self.top)
        b = a << 6 | first(self.bits[1][a])
        r = b << 6 | first(self.bits[0][b])
        self.bits[0][b] &= ~(1 << (r & 63))
        if not self.bits[0][b]:
            self.bits[1][a] &= ~(1 << (b & 63))
            if not self.bits[1][a]:
                self.top &= ~(1 << a)
        got = self.buckets.pop(r)
        return r, got[0] if len(got) == 1 else np.concatenate(got)


def merge_table(ranks: dict[bytes, int]) -> dict:
    """What an encoder needs from a vocabulary: pair keys (left << 32 | right)
    in order, the rank each pair merges to, and the ids of the 256 bytes.  A
    pair merges if its joined bytes are a token."""
    keys, to = [], []
    for token, r in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                to.append(r)
    k, t = np.array(keys, dtype=np.int64), np.array(to, dtype=np.int64)
    order = np.argsort(k)
    k, t = k[order], t[order]
    # tokens that may merge again at a rank not above their own
    early = np.zeros(max(ranks.values()) + 1, dtype=bool)
    for part in (k >> 32, k & 0xFFFFFFFF):
        early[part[t <= part]] = True
    return {"keys": k, "to": t, "bytes": np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64),
            "early": early, "tokens": ranks}


class ByteBpe:
    def __init__(self, m: dict, cache_entries: int = CACHE_ENTRIES):
        self.cache_entries = cache_entries
        self.keys, self.to, self.byte_ids, self.early = m["keys"], m["to"], m["bytes"], m["early"]
        self.tokens: dict[bytes, int] = m["tokens"]
        self.n = max(self.tokens.values()) + 1
        self.words = {r: t for t, r in self.tokens.items()}
        self.pre: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE, dtype=np.int64)
        k = left << 32 | right
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[i] == k) & (left >= 0) & (right >= 0), self.to[i], NONE)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each non-empty byte string, by the merges alone."""
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        ends = np.cumsum(lengths + 1)
        size = int(ends[-1]) + 1
        sym = np.full(size, -1, dtype=np.int64)  # -1: barrier
        inside = np.ones(size, dtype=bool)
        inside[0] = False
        inside[ends] = False
        sym[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        nxt, prv = np.arange(1, size + 1), np.arange(-1, size - 1)
        piece = np.cumsum(~inside)
        pair = np.full(size, NONE, dtype=np.int64)
        pair[:-1] = self._rank(sym[:-1], sym[1:])
        queue = RankQueue(self.n)
        start = np.flatnonzero(pair < NONE)
        queue.push(pair[start], start)
        while (got := queue.pop()) is not None:
            r, at = got
            at = at[pair[at] == r]  # the rest is stale
            if len(at) > 1:
                at.sort()
                at = at[np.r_[True, at[1:] != at[:-1]]]
                every = at
                # overlapping pairs: from the left, every other one of a run
                linked = np.r_[False, nxt[at[:-1]] == at[1:]]
                if linked.any():
                    k = np.arange(len(at))
                    first = np.maximum.accumulate(np.where(linked, 0, k))
                    at = at[(k - first) % 2 == 0]
                if self.early[r]:
                    at, rest = self._until_early(r, at, every, sym, nxt, prv, piece)
                    if len(rest):
                        queue.push(np.full(len(rest), r), rest)
            elif not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = r
            sym[gone] = -2
            pair[gone] = NONE
            nxt[at] = after
            prv[after] = at
            touched = np.concatenate((at, prv[at]))
            pair[touched] = new = self._rank(sym[touched], sym[nxt[touched]])
            ok = new < NONE
            if ok.any():
                queue.push(new[ok], touched[ok])
        alive = np.flatnonzero(sym >= 0)
        cut = np.searchsorted(alive, ends[:-1]) if len(ends) > 1 else np.zeros(0, dtype=np.int64)
        return np.split(sym[alive].astype("<u4"), cut)

    def _until_early(self, r: int, at: np.ndarray, every: np.ndarray, sym, nxt, prv, piece):
        """The merges that may be done together, and the pairs to put back:
        inside a piece, once a merge forms a pair of rank ``r`` or lower, that
        pair comes before the piece's later pairs of this bucket."""
        left, after = prv[at], nxt[nxt[at]]
        merged_left = np.r_[False, nxt[nxt[at[:-1]]] == at[1:]]
        to_left = self._rank(np.where(merged_left, r, sym[left]), np.full(len(at), r))
        to_right = self._rank(np.full(len(at), r), sym[after])
        stop = np.minimum(to_left, to_right) <= r
        if not stop.any():
            return at, at[:0]
        where = at[stop]
        own = piece[where]
        lead = np.r_[True, own[1:] != own[:-1]]
        own, where = own[lead], where[lead]  # the first such merge of each piece

        def limit(x):
            i = np.minimum(np.searchsorted(own, piece[x]), len(own) - 1)
            return np.where(own[i] == piece[x], where[i], len(sym))

        return at[at <= limit(at)], every[every > limit(every)]

    def _learn(self, unseen: set[str], pattern) -> None:
        cut = {c: pattern.findall(c) for c in unseen}
        new = {p for ps in cut.values() for p in ps}
        new.difference_update(self.pre)
        todo = []
        for p in new:
            b = p.encode()
            if (r := self.tokens.get(b)) is not None:
                self.pre[p] = r.to_bytes(4, "little")
            else:
                todo.append((p, b))
        if todo:
            for (p, _), ids in zip(todo, self.merge([b for _, b in todo]), strict=True):
                self.pre[p] = ids.tobytes()
        get = self.pre.__getitem__
        for c, ps in cut.items():
            self.chunks[c] = self.pre[ps[0]] if len(ps) == 1 else b"".join(map(get, ps))

    def encode(self, texts: list[str | None], pattern) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.chunks) + len(self.pre) > 2 * self.cache_entries:
            self.chunks, self.pre = {}, {}
        split = [CHUNK.findall(t) if t else [] for t in texts]
        unseen: set[str] = set()
        for c in split:
            unseen.update(c)
        unseen.difference_update(self.chunks)
        if unseen:
            self._learn(unseen, pattern)
        get = self.chunks.__getitem__
        return [b"".join(map(get, c)) for c in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one "base64 rank" pair per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}


def broadcast_vocabulary(spark: SparkSession, ranks_path: str):
    """The vocabulary's merge table for all executors (its size is the
    vocabulary's, whatever the corpus)."""
    return spark.sparkContext.broadcast({"value": merge_table(read_ranks(ranks_path))})


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False,
           block_chars: int = BLOCK_CHARS, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids
    (binary, little-endian 32-bit): every text encoded, the ids decoded.
    ``block_chars``: characters of the texts that a task holds at once;
    ``cache_entries``: chunks and pre-tokens that a worker remembers."""
    bc = broadcast_vocabulary(docs.sparkSession, ranks_path)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
              ("decoded_sha256", pa.string())] + ([("ids", pa.binary())] if with_ids else [])
    schema = pa.schema(fields)

    def run(batches):
        import regex
        bpe = per_worker(bc, lambda m: ByteBpe(m, cache_entries))
        pat = regex.compile(pattern)
        for ids, texts in text_blocks(batches, block_chars):
            out = bpe.encode(texts, pat)
            cols = {"doc_id": ids, "n_tokens": [len(x) // 4 for x in out],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in out],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in out]}
            if with_ids:
                cols["ids"] = out
            yield rows_to_batch(cols, schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, ddl)
