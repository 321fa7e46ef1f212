"""Removal of byte strings that repeat anywhere in the corpus.

A byte goes if it lies in a string of ``length`` bytes that also starts
somewhere else, in the same document or another.

Prefix doubling ranks every position by its first w bytes and reranks the
pairs (rank here, rank further on) at growing offsets until a position is
unique or past the threshold.  Sorting every byte position of a corpus again
and again moves hundreds of bytes per byte of text, so the ranks here start
at sampled positions and grow from there:

1. w bytes: every start position is represented by the minimizer (smallest
   hash of ``w`` bytes) of its string; equal strings have equal minimizers at
   equal offsets.  Consecutive positions with one minimizer are a run.
2. the whole run: runs with equal bytes repeat at every position; Spark counts
   runs by their rank.  A run whose minimizer is unique is done, too.
3. the remaining runs (where a repeated passage begins or ends): Spark sorts
   them by the minimizer's rank, and positions at the same offset from equal
   minimizers are ranked by all ``length`` bytes.  Copies of a run are one
   row here.  A minimizer with very many different runs is not sorted in one
   task: its positions are counted by their rank instead, which gives the
   same result.

Ranks are 64-bit polynomial hashes.  Texts are only moved for documents that
lose something.

Defined cases: null is an empty text; a text shorter than ``length`` loses
nothing; a repeated row loses everything if it is long enough; rows are told
apart by id and text; an empty table gives no rows; further columns are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import per_worker, plain_names, rows_to_batch, shuffle_partitions
from .components import bitmap, in_bitmap

LENGTH = 400                 # bytes of a string that must not repeat
WINDOW = 64                  # bytes of the first rank
GROUP = 20_000               # different runs of a minimizer that one task sorts
ARROW_ROWS = 256             # runs, documents and intervals given out at once

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = 28                  # low bits of a sampled hash that hold its position
_K1, _K2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _K1
    x = (x ^ (x >> _U(27))) * _K2
    return x ^ (x >> _U(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


class Hasher:
    """Hashes of substrings by prefix sums (mod 2^64)."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) <= n:
            size = max(2 * len(self.up), n + 1, 1 << 16)
            powers = lambda b: np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])
            self.up, self.down = powers(_BASE), powers(_INVERSE)
        out = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * self.up[:n], out=out[1:])
        return out

    def of(self, pre: np.ndarray, start, end) -> np.ndarray:
        return _mix((pre[end] - pre[start]) * self.down[start])


def runs_of(data: np.ndarray, h: Hasher, length: int, window: int):
    """Runs of the start positions of a text: (lo, hi, at, rank of the
    minimizer, rank of the whole run), as arrays; lo..hi are starts and
    ``at`` is the minimizer's place."""
    pre = h.prefix(data)
    n = len(data)
    w = np.arange(n - window + 1)
    ranks = h.of(pre, w, w + window)
    v = (ranks >> _U(_PLACE) << _U(_PLACE)) | w.astype(np.uint64)
    span = length - window + 1
    # smallest value of every span: from block-wise running minima
    blocks = -(-len(v) // span)
    pad = np.full(blocks * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    pad[:len(v)] = v
    grid = pad.reshape(blocks, span)
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(grid, axis=1).ravel()
    starts = n - length + 1
    least = np.minimum(left[:starts], right[span - 1:span - 1 + starts])
    at = (least & _U((1 << _PLACE) - 1)).astype(np.int64)
    lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    hi = np.r_[lo[1:], starts] - 1
    at = at[lo]
    whole = h.of(pre, lo, hi + length)
    whole = _mix(whole + (hi - lo).astype(np.uint64) * _K1 + (at - lo).astype(np.uint64) * _K2)
    return lo, hi, at, ranks[at].view(np.int64), whole.view(np.int64)


_RUN = pa.schema([("row", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("rank", pa.int64()),
                  ("whole", pa.int64())])


def _texts(batch):
    for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        yield row, np.frombuffer((t or "").encode(), dtype=np.uint8)


def _run_rows(length: int, window: int):
    def run(batches):
        h = Hasher()
        for b in batches:
            out: list[list] = [[] for _ in _RUN]
            for row, data in _texts(b):
                if len(data) < length:
                    continue
                lo, hi, _, rank, whole = runs_of(data, h, length, window)
                for x, y in zip(out, (np.full(len(lo), row, dtype=np.int64), lo.astype(np.int32),
                                      hi.astype(np.int32), rank, whole), strict=True):
                    x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], schema=_RUN)

    return run


_EDGE = pa.schema([("rank", pa.int64()), ("whole", pa.int64()), ("row", pa.int64()), ("lo", pa.int32()),
                   ("off", pa.int32()), ("bytes", pa.binary())])


def _edge_rows(bc, length: int, window: int):
    """The bytes of the runs whose minimizer may be asked for; equal runs of
    a batch once or twice (twice tells that the run repeats)."""

    def run(batches):
        h = Hasher()
        bits = per_worker(bc, lambda v: v)
        for b in batches:
            out: list[list] = [[] for _ in _EDGE]
            met: dict[int, int] = {}
            for row, data in _texts(b):
                if len(data) < length:
                    continue
                lo, hi, at, rank, whole = runs_of(data, h, length, window)
                for i in np.flatnonzero(in_bitmap(bits, rank)).tolist():
                    w = int(whole[i])
                    met[w] = met.get(w, 0) + 1
                    if met[w] > 2:
                        continue
                    for x, y in zip(out, (int(rank[i]), w, row, int(lo[i]), int(at[i] - lo[i]),
                                          data[lo[i]:hi[i] + length].tobytes()), strict=True):
                        x.append(y)
            for i in range(0, len(out[0]), 4 * ARROW_ROWS):
                yield rows_to_batch({f.name: x[i:i + 4 * ARROW_ROWS] for f, x in zip(_EDGE, out, strict=True)}, _EDGE)

    return run


def _string_keys(h: Hasher, data: bytes, off: int, length: int) -> np.ndarray:
    """A key of each string of a run: its rank and its offset from the
    minimizer."""
    a = np.frombuffer(data, dtype=np.uint8)
    s = np.arange(len(a) - length + 1)
    return _mix(h.of(h.prefix(a), s, s + length) + (off - s).astype(np.uint64) * _K1)


_SPAN = pa.schema([("row", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _spans(flags: np.ndarray, lo: int, length: int) -> list[tuple[int, int]]:
    on = np.flatnonzero(flags)
    if not len(on):
        return []
    cut = np.flatnonzero(np.diff(on) > 1)
    return list(zip((lo + on[np.r_[0, cut + 1]]).tolist(), (lo + on[np.r_[cut, len(on) - 1]] + length).tolist(),
                    strict=True))


def _edge_spans(length: int):
    """Rows sorted by rank (rank, row, lo, off, bytes, single) -> the spans of
    the repeated strings of single runs."""

    def resolve(h, group):
        if len(group) < 2:
            return
        keys = [_string_keys(h, g["bytes"], g["off"], length) for g in group]
        every = np.concatenate(keys)
        every.sort()
        again = every[1:][every[1:] == every[:-1]]
        if not len(again):
            return
        for g, k in zip(group, keys, strict=True):
            if g["single"]:
                i = np.minimum(np.searchsorted(again, k), len(again) - 1)
                for a, b in _spans(again[i] == k, g["lo"], length):
                    yield g["row"], a, b

    def run(batches):
        h = Hasher()
        group: list[dict] = []
        out: list[tuple] = []
        for b in batches:
            for r in b.to_pylist():
                if group and group[0]["rank"] != r["rank"]:
                    out.extend(resolve(h, group))
                    group = []
                group.append(r)
            if out:
                yield rows_to_batch(dict(zip(("row", "a", "b"), zip(*out, strict=True), strict=True)), _SPAN)
                out = []
        out.extend(resolve(h, group))
        if out:
            yield rows_to_batch(dict(zip(("row", "a", "b"), zip(*out, strict=True), strict=True)), _SPAN)

    return run


def _edge_strings(length: int):
    """Every string of the runs: (key, row, start, single)."""
    schema = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("s", pa.int32()), ("single", pa.bool_())])

    def run(batches):
        h = Hasher()
        for b in batches:
            for r in b.to_pylist():
                k = _string_keys(h, r["bytes"], r["off"], length)
                yield pa.RecordBatch.from_arrays([
                    pa.array(k.view(np.int64)), pa.array(np.full(len(k), r["row"], dtype=np.int64)),
                    pa.array((r["lo"] + np.arange(len(k))).astype(np.int32)),
                    pa.array(np.full(len(k), r["single"]))], schema=schema)

    return run


def repeated_spans(rows: DataFrame, length: int = LENGTH, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``rows``: (row long, text).  (row, a, b): byte spans, which may
    overlap, that cover what repeats."""
    spark = rows.sparkSession
    text = rows.select("row", "text")
    runs = materialize(text.mapInArrow(_run_rows(length, window), "row long, lo int, hi int, rank long, whole long"),
                       "repeat-runs")
    seen = materialize(runs.groupBy("rank", "whole").agg(F.count(F.lit(1)).alias("n")), "repeat-ranks")
    again = seen.where("n > 1").select("rank", "whole")
    full = runs.join(again, ["rank", "whole"], "left_semi").select("row", F.col("lo").alias("a"),
                                                                 (F.col("hi") + length).alias("b"))
    # minimizers with a run of its own and another run besides
    ranks = materialize(seen.groupBy("rank").agg(F.count(F.lit(1)).alias("kinds"),
                                                 F.min("n").alias("least")).where("kinds > 1 and least = 1")
                        .select("rank", "kinds"), "repeat-edges")
    bc = spark.sparkContext.broadcast({"value": bitmap(ranks, "rank")})
    found = text.mapInArrow(_edge_rows(bc, length, window),
                            "rank long, whole long, row long, lo int, off int, bytes binary")
    edges = found.groupBy("rank", "whole").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min("lo").alias("lo"), F.min("off").alias("off"),
        F.first("bytes").alias("bytes")).withColumn("single", F.col("n") == 1).drop("n", "whole")
    edges = edges.join(ranks, "rank")
    edges = materialize(edges, "repeat-bytes")
    cols = ("rank", "row", "lo", "off", "bytes", "single")
    some = edges.where(F.col("kinds") <= group).select(*cols) \
        .repartition(shuffle_partitions(spark), "rank").sortWithinPartitions("rank") \
        .mapInArrow(_edge_spans(length), "row long, a int, b int")
    strings = edges.where(F.col("kinds") > group).select(*cols) \
        .mapInArrow(_edge_strings(length), "key long, row long, s int, single boolean")
    twice = strings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    many = strings.join(twice, "key", "left_semi").where("single").select("row", F.col("s").alias("a"),
                                                                       (F.col("s") + length).alias("b"))
    return full.unionByName(some).unionByName(many)


def _merge(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_CUT = pa.schema([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(keep_text: bool):
    """(text, spans) -> what is left."""

    def run(series):
        for text, spans in series:
            rows = []
            for t, sp in zip(text, spans, strict=True):
                data = (t or "").encode()
                merged = _merge([(int(x["a"]), int(x["b"])) for x in sp])
                left, at = [], 0
                for a, b in merged:
                    left.append(data[at:a])
                    at = b
                left.append(data[at:])
                rest = b"".join(left)
                rows.append((sum(b - a for a, b in merged), len(merged), hashlib.sha256(rest).hexdigest(),
                             rest.decode("utf-8", "ignore") if keep_text else None))
            yield pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256", "kept_text"])

    return F.pandas_udf(run, "n_removed long, n_spans long, kept_sha256 string, kept_text string",
                        F.PandasUDFType.SCALAR_ITER)


def remove_repeats(docs: DataFrame, keep_text: bool = False, length: int = LENGTH, window: int = WINDOW,
                   group: int = GROUP) -> DataFrame:
    """``docs`` plus n_bytes, n_removed, n_spans, kept_sha256 and, if asked,
    kept_text (a character cut in two at a span's edge is dropped from it)."""
    spark = docs.sparkSession
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    d = docs.withColumn("_row", row)
    spans = materialize(repeated_spans(d.select(F.col("_row").alias("row"), "text"), length, window, group), "repeats")
    per = spans.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("_spans"))
    bits = bitmap(spans.select("row"), "row")
    bc = spark.sparkContext.broadcast({"value": bits})

    def asked(rows):
        b = per_worker(bc, lambda v: v)
        for r in rows:
            yield pd.Series(in_bitmap(b, r.to_numpy()))

    d = d.withColumn("_ask", F.pandas_udf(asked, "boolean", F.PandasUDFType.SCALAR_ITER)("_row"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    zero = F.lit(0).cast("long")
    rest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)

    def whole(x: DataFrame) -> DataFrame:
        return x.select(*docs.columns, n_bytes, zero.alias("n_removed"), zero.alias("n_spans"),
                        rest.alias("kept_sha256"), *([F.col("text").alias("kept_text")] if keep_text else []))

    near = d.where("_ask").join(per.withColumnRenamed("row", "_row"), "_row", "left")
    cut = near.where("_spans is not null").withColumn("_cut", _cut(keep_text)("text", "_spans")) \
        .select(*docs.columns, n_bytes, "_cut.n_removed", "_cut.n_spans", "_cut.kept_sha256",
                *(["_cut.kept_text"] if keep_text else []))
    return whole(d.where("not _ask")).unionByName(whole(near.where("_spans is null"))).unionByName(cut)


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the repeated strings taken out of ``text``; a document
    of which nothing is left goes."""
    plain = plain_names(docs)
    r = remove_repeats(plain, keep_text=True, **how)
    return r.where("n_removed = 0 or n_removed < n_bytes") \
        .select(*[F.col("kept_text").alias(c) if c == "text" else F.col(c) for c in plain.columns]).toDF(*docs.columns)
