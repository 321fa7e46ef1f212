"""Cross-tokenizer alignment: how two tokenizers cut the same texts.

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece
model.  Both report spans: A characters, B the spans of its proto.  Spans are
coarse cuts, as tokens that share a character (a multibyte one that is cut, or
one spelled by byte-fallback pieces) have the same span or an empty one; there
the decoded bytes of the tokens refine the cut (``byte_ends``).  Offsets at
which a token of A and one of B end cut both into groups; tokens whose byte
ranges end together are linked.

A text is encoded in chunks: neither tokenizer joins anything across a
character that is not white space and a blank or line feed after it (A's pattern
has these only at a token's begin, and ``cuts_at_blanks`` looks through B's
pieces), so a chunk's tokens, groups and links are those it has inside any text,
and a worker aligns every distinct chunk once.  Other tokenizers are given whole
texts.

Counts of linked id pairs are added up per task, then by Spark.  Documents meet
the counts of the most frequent pairs (``LISTED``, a bounded broadcast) in a
map; pairs beyond these are joined.

Defined cases: a text that is null or empty, or of which either tokenizer's
bytes are not blank + text, has no tokens: zeros and '' as digest.  Special
tokens' strings are plain text.  Repeated rows are aligned, and count, each; a
null id stays null; an empty table gives no rows; further columns are not read;
a very long text without blanks is one chunk, which is not remembered.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import per_worker, prepare, text_blocks

BLOCK_CHARS = 2_000_000      # characters aligned at once
JOINED_CHARS = 20_000        # characters of unseen chunks that are encoded as one text
CACHE_CHUNKS = 900_000       # chunks a worker remembers, and
CACHE_CHARS = 16_000_000     # their characters
LONG_CHUNK = 256             # longer chunks are not remembered
PAIRS_HELD = 400_000         # id pairs a task counts before it gives them out
LISTED = 1 << 19             # most frequent pairs that are broadcast

MARK = "▁"              # B's sign for a blank
_UNSAFE = re.compile(r"\s[ \n]|▁")
_CUT = re.compile(r"(?<=[^\s▁])(?=[ \n].)", re.S)
LEAD = " a"                  # goes before a chunk that begins with a line feed, as B adds a blank to every text


def byte_level_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each
    byte: itself if it is printable, else the next one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(sorted(set(range(256)) - set(plain))):
        out[chr(256 + i)] = b
    return out


def byte_ends(begin: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte offsets at which tokens end.  A coarse end holds where a span is
    not empty and shares nothing with the next; between two such cuts the
    decoded sizes tell."""
    sure = np.ones(len(size), dtype=bool)
    sure[:-1] = (begin[:-1] < end[:-1]) & (end[:-1] <= begin[1:])
    run = np.cumsum(size)
    # the cut before each token, and how far the sizes are off there
    cut = np.maximum.accumulate(np.where(sure, np.arange(1, len(size) + 1), 0))
    before = np.concatenate([[0], cut[:-1]])
    off = np.concatenate([[0], end - run])
    return np.where(sure, end, run + off[before])


def group(ids_a: list[int], ends_a: list[int], ids_b: list[int], ends_b: list[int]):
    """(groups as text, pairs): tokens between common ends, and the id pairs
    of the tokens that end together."""
    both = sorted(set(ends_a) & set(ends_b))
    parts, pairs, i, j = [], [], 0, 0
    for end in both:
        a, b = i, j
        while i < len(ends_a) and ends_a[i] <= end:
            i += 1
        while j < len(ends_b) and ends_b[j] <= end:
            j += 1
        parts.append(",".join(map(str, ids_a[a:i])) + "|" + ",".join(map(str, ids_b[b:j])))
        pairs += [(x, y) for x, ex in zip(ids_a[a:i], ends_a[a:i], strict=True) if ex == end
                  for y, ey in zip(ids_b[b:j], ends_b[b:j], strict=True) if ey == end]
    return ";".join(parts), pairs


class Aligner:
    """Aligns blocks of texts; remembers chunks.  ``pair`` ids are
    a x (size of B's vocabulary) + b."""

    def __init__(self, tokenizer_json: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(tokenizer_json)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        alphabet = byte_level_alphabet()
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            known = all(c in alphabet for c in piece)
            self.bytes_a[i] = bytes(alphabet[c] for c in piece) if known else piece.encode()
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.text_of = np.array([f"{i}{c}" for i in range(max(len(self.bytes_a), self.n_b)) for c in (",", "|", ";", "")],
                                dtype=object)
        self.in_chunks = self._byte_level(tokenizer_json) and self.cuts_at_blanks(pieces) \
            and self.sizes_a.min() > 0 and self.sizes_b.min() > 0
        # whether B's spans count bytes or characters depends on the library's version
        self.spans_are_bytes = max((p.end for p in self._proto(["é"])[0].pieces), default=2) == 2
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.texts: list[str] = []
        self.numbers = np.zeros((0, 2), dtype=np.int64)  # tokens of A, of B (-1: not aligned)
        self.pairs = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(1, dtype=np.int64)

    @staticmethod
    def _byte_level(tokenizer_json: str) -> bool:
        import json
        spec = json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                and pre.get("use_regex", True) and spec["model"]["type"] == "BPE")

    @staticmethod
    def cuts_at_blanks(pieces: list[str]) -> bool:
        """No piece has a blank after another character, or a line feed."""
        return not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)

    def _proto(self, texts: list[str]) -> list:
        try:
            return self.b.encode(texts, return_type="proto", num_threads=1)
        except TypeError:  # the older library's name for it
            return self.b.encode(texts, out_type="immutable_proto", num_threads=1)

    def _encoded(self, text: str):
        """(raw bytes, ids, byte ends of A, ids, byte ends of B) of a text that
        begins with the blank that B adds; None if the bytes differ."""
        raw = text.encode("utf-8", "surrogatepass")
        e = self.a.encode(text, add_special_tokens=False)
        pieces = self._proto([text[1:]])[0].pieces
        list_a, list_b = e.ids, [p.id for p in pieces]
        if b"".join(map(self.bytes_a.__getitem__, list_a)) != raw or b"".join(map(self.bytes_b.__getitem__, list_b)) != raw:
            return None
        whole = lambda x, n: np.fromiter(x, dtype=np.int64, count=n)
        place = None  # of each character among the bytes
        if len(raw) != len(text):
            cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            wide = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
            place = np.concatenate([[0], np.cumsum(wide)])
        ids_a, ids_b = whole(list_a, len(list_a)), whole(list_b, len(list_b))
        span = whole(chain.from_iterable(e.offsets), 2 * len(list_a))
        if place is not None:
            span = place[span]
        ends_a = byte_ends(span[0::2], span[1::2], self.sizes_a[ids_a])
        begin, end = (whole(x, len(list_b)) + 1 for x in ((p.begin for p in pieces), (p.end for p in pieces)))
        if place is not None and not self.spans_are_bytes:
            begin, end = place[begin], place[end]
        begin[0] = 0  # the blank that B added
        return raw, ids_a, ends_a, ids_b, byte_ends(begin, end, self.sizes_b[ids_b])

    def _joined(self, chunks: list[str]):
        """(tokens of A, of B, groups, pairs, pairs of each) of chunks that are
        encoded as one text; None if they can't be told apart so."""
        if chunks[0][0] != " ":
            got = self._joined([LEAD, *chunks])
            return got and (got[0][1:], got[1][1:], got[2][1:], got[3][int(got[4][0]):], got[4][1:])
        got = self._encoded("".join(chunks))
        if got is None:
            return None
        raw, ids_a, ends_a, ids_b, ends_b = got
        bounds = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in chunks])
        if not ((np.diff(ends_a) > 0).all() and (np.diff(ends_b) > 0).all()):
            return None
        last_b = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
        last_a = np.flatnonzero(ends_b[last_b] == ends_a)
        last_b, both = last_b[last_a], ends_a[last_a]
        at = np.minimum(np.searchsorted(both, bounds), len(both) - 1)
        if not (both[at] == bounds).all():
            return None
        sep_a, sep_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        sep_a[last_a] = 1
        sep_b[last_b] = 2
        sep_b[np.searchsorted(ends_b, bounds)] = 3
        order = np.argsort(np.concatenate([2 * np.searchsorted(both, ends_a), 2 * np.searchsorted(both, ends_b) + 1]),
                           kind="stable")
        words = np.concatenate([self.text_of[ids_a * 4 + sep_a], self.text_of[ids_b * 4 + sep_b]])[order].tolist()
        count = lambda ends: np.diff(np.searchsorted(ends, bounds, side="right"), prepend=0)
        n_a, n_b = count(ends_a), count(ends_b)
        at = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        texts = ["".join(words[i:j]) for i, j in zip(at, at[1:])]
        return n_a, n_b, texts, ids_a[last_a] * self.n_b + ids_b[last_b], count(both)

    def _alone(self, chunk: str):
        """The same of one chunk (-1 tokens: the bytes differ)."""
        one = self._joined([chunk])
        if one is not None:
            return one
        got = self._encoded(chunk) if chunk[0] == " " else None
        if got is None:
            return [-1], [-1], [""], np.zeros(0, np.int64), [0]
        _, ids_a, ends_a, ids_b, ends_b = got  # tokens without bytes
        text, pairs = group(ids_a.tolist(), ends_a.tolist(), ids_b.tolist(), ends_b.tolist())
        return [len(ids_a)], [len(ids_b)], [text], np.array([x * self.n_b + y for x, y in pairs], dtype=np.int64), [len(pairs)]

    def chunks(self, text: str) -> list[str]:
        """``" " + text``, cut before each blank or line feed that follows
        another character (but not before one that ends the text: B adds
        nothing to an empty text)."""
        if not self.in_chunks:
            return [" " + text]
        if text[0] not in " \n" and text[-1] not in " \n" and not _UNSAFE.search(text):
            if "\n" not in text:
                return [" " + x for x in text.split(" ")]
            return [x if x[0] == "\n" else " " + x for x in text.replace("\n", " \n").split(" ")]
        return _CUT.split(" " + text)

    def learn(self, chunks: list[str]) -> None:
        """Align chunks: those that end in no white space are joined to texts of
        some length, as what is true of a text's chunks is true of theirs."""
        groups: list[list[str]] = []
        size = JOINED_CHARS
        for c in chunks:
            if not self.in_chunks or c[-1].isspace() or c[-1] == MARK or MARK in c:
                groups.append([c])
                continue
            if size >= JOINED_CHARS:
                joined: list[str] = []
                groups.append(joined)
                size = 0
            joined.append(c)
            size += len(c)
        found = []
        for g in groups:
            one = self._joined(g) if len(g) > 1 else None
            found += [one] if one is not None else [self._alone(c) for c in g]
        order = [c for g in groups for c in g]
        self.index.update(zip(order, range(len(self.texts), len(self.texts) + len(order)), strict=True))
        self.chars += sum(map(len, order))
        for f in found:
            self.texts += f[2]
        cat = lambda i: np.concatenate([np.asarray(f[i], dtype=np.int64) for f in found])
        self.numbers = np.concatenate([self.numbers, np.stack([cat(0), cat(1)], axis=1)])
        self.pairs = np.concatenate([self.pairs, cat(3)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(cat(4))])

    def block(self, texts: list[str | None]):
        """For each text (n_a, n_b, groups, pairs as an array), or None."""
        if len(self.index) > CACHE_CHUNKS or self.chars > CACHE_CHARS:
            self.forget()
        cut = [self.chunks(t) if t else [] for t in texts]
        unseen: set[str] = set()
        for c in cut:
            unseen.update(c)
        new = list(unseen.difference(self.index))
        if new:
            self.learn(new)
        for c in cut:
            if not c:
                yield None
                continue
            at = np.fromiter(map(self.index.__getitem__, c), dtype=np.int64, count=len(c))
            n_a, n_b = self.numbers[at].T
            if n_a.min() < 0:
                yield None
                continue
            lo, size = self.starts[at], self.starts[at + 1] - self.starts[at]
            where = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
            yield int(n_a.sum()), int(n_b.sum()), ";".join(map(self.texts.__getitem__, at.tolist())), self.pairs[where]
        for c in new:  # what is long stays out of the index
            if len(c) > LONG_CHUNK:
                del self.index[c]


_DOC = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                  ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                  ("groups", pa.string()), ("pair", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
                  ("kind", pa.int32())])
_DOC_SQL = ("doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "groups string, pair array<long>, times array<long>, kind int")


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encoded(bc, keep_groups: bool):
    """kind 0: a document with its distinct pairs and how often it has each;
    kind 1: pairs and their links in many documents of the task."""

    def count_row(keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        row = {f.name: pa.nulls(1, f.type) for f in _DOC}
        row |= {"pair": _lists([keys]), "times": _lists([times]), "kind": pa.array([1], type=pa.int32())}
        return pa.RecordBatch.from_arrays([row[f.name] for f in _DOC], schema=_DOC)

    def run(batches):
        aligner = per_worker(bc, lambda v: Aligner(*v))
        rows: list = []

        def seen():
            for b in batches:
                rows.extend(b.column(2).to_pylist())
                yield b

        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for ids, texts in text_blocks(seen(), BLOCK_CHARS):
            row, rows[:] = rows[:len(ids)], rows[len(ids):]
            out: dict[str, list] = {f.name: [] for f in _DOC}
            for found in aligner.block(texts):
                n_a, n_b, groups, pairs = found or (0, 0, "", keys[:0])
                u, t = np.unique(pairs, return_counts=True)
                for name, v in (("n_a", n_a), ("n_b", n_b), ("n_groups", groups.count(";") + 1 if groups else 0),
                                ("n_links", len(pairs)),
                                ("groups_sha256", hashlib.sha256(groups.encode()).hexdigest() if groups else ""),
                                ("groups", groups if keep_groups else None), ("pair", u), ("times", t)):
                    out[name].append(v)
            cols = {n: pa.array(v, type=_DOC.field(n).type) for n, v in out.items()
                    if n not in ("pair", "times", "doc_id", "row", "kind")}
            cols |= {"doc_id": pa.array(ids, type=pa.int64()), "row": pa.array(row, type=pa.int64()),
                     "pair": _lists(out["pair"]), "times": _lists(out["times"]),
                     "kind": pa.array(np.zeros(len(ids), dtype=np.int32))}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in _DOC], schema=_DOC)
            # a document's pairs are sorted: stable sorting of all is a merge
            keys, times = _added([keys, *out["pair"]], [times, *out["times"]])
            if len(keys) > PAIRS_HELD:
                yield count_row(keys, times)
                keys, times = keys[:0], times[:0]
        if len(keys):
            yield count_row(keys, times)

    return run


def _added(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, t = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(k, kind="stable")
    k, t = k[order], t[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(t, first) if len(k) else t


def _scored(bc):
    """Documents with what the broadcast pairs give them, and the rest."""
    names = [f for f in _DOC if f.name not in ("pair", "times", "kind")]
    schema = pa.schema([*names, ("n_best", pa.int64()), ("count_sum", pa.int64()), ("pair", pa.list_(pa.int64())),
                        ("times", pa.list_(pa.int64()))])

    def run(batches):
        keys, counts, best = bc.value
        for b in batches:
            n = b.num_rows
            pair, times = b.column(len(names)), b.column(len(names) + 1)
            size = pair.value_lengths().to_numpy(zero_copy_only=False)
            p, t = (x.flatten().to_numpy(zero_copy_only=False) for x in (pair, times))
            doc = np.repeat(np.arange(n), size)
            i = np.minimum(np.searchsorted(keys, p), max(0, len(keys) - 1))
            hit = keys[i] == p if len(keys) else np.zeros(len(p), dtype=bool)
            n_best, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            np.add.at(total, doc[hit], t[hit] * counts[i[hit]])
            top = hit.copy()
            top[hit] = best[i[hit]]
            np.add.at(n_best, doc[top], t[top])
            left = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(np.bincount(doc[~hit], minlength=n), out=left[1:])
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~hit])) for x in (p, t)]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(n_best), pa.array(total), *rest],
                                             schema=schema)

    return run


def align(docs: DataFrame, tokenizer_path: str, model_path: str, with_groups: bool = False,
          listed: int = LISTED) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256
    of every row, and ``groups`` (the text that the digest is of) if asked."""
    spark = prepare(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        js = f.read()
    with open(model_path, "rb") as f:
        model = f.read()
    bc = spark.sparkContext.broadcast({"value": (js, model)})
    import sentencepiece
    n_b = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    named = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    encoded = materialize(named.mapInArrow(_encoded(bc, with_groups), _DOC_SQL), "align-docs", ["kind"])
    counts = encoded.where("kind = 1").select(F.explode(F.arrays_zip("pair", "times")).alias("x")) \
        .groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.times").alias("n"))
    counts = materialize(counts.withColumn("b", F.col("pair") % n_b), "align-counts")
    # one row per entry of B's vocabulary
    top = counts.groupBy("b").agg(F.max("n").alias("most"))
    counts = counts.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    counts = materialize(counts, "align-pairs")
    hot = counts.orderBy(F.desc("n"), "pair").limit(listed).toArrow()
    keys = hot.column("pair").to_numpy()
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[order], hot.column("n").to_numpy()[order],
                                          hot.column("best").to_numpy()[order].astype(bool)))
    cols = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    scored = encoded.where("kind = 0").select(*cols, "pair", "times").mapInArrow(
        _scored(known), "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                        "groups string, n_best long, count_sum long, pair array<long>, times array<long>")
    scored = materialize(scored, "align-scored")
    rest = scored.where(F.size("pair") > 0).select("row", F.explode(F.arrays_zip("pair", "times")).alias("x")) \
        .select("row", "x.pair", "x.times").join(counts, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"),
            F.sum(F.col("times") * F.col("n")).alias("_sum"))
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
           *(["groups"] if with_groups else [])]
    more = scored.where(F.size("pair") > 0).join(rest, "row") \
        .withColumn("n_best", F.col("n_best") + F.col("_best")).withColumn("count_sum", F.col("count_sum") + F.col("_sum"))
    return scored.where(F.size("pair") == 0).select(*out).unionByName(more.select(*out))

