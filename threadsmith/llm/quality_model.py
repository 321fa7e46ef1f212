"""Quality classifier with supervised subword embeddings.

A word's features are itself and the character n-grams of ``<word>``, hashed to
``BUCKETS`` rows of an embedding table; one row more stands for a word that
repeats the one before it (a pair of words, whichever they are).  A document is
the average of its features' vectors (each as often as it occurs); a softmax over a linear layer
gives its classes.  Table and layer are learned together by stochastic gradient
descent in numpy, on the driver, from a bounded sample of labelled documents
(``per_class`` of each label, by a hash of the id); a step is scaled by the
document's own feature weights, so that long and short documents move their
average alike.

The average is linear, so a word adds a fixed vector to the two class sums: a
worker works it out once per distinct word, and a document of any length is one
pass over its words.

Defined cases: a null or empty text, or one of white space, has the average
zero, so the bias alone scores it; without labelled rows of both classes every
score is 0.5; repeated label rows count once, as 0 if one of them is; repeated
documents are scored alike, ties need no order; very long words give all their
n-grams; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import crc32_of, per_worker, rows_to_batch, text_blocks, unit_hash

BUCKETS = 1 << 16
WIDTH = 16
GRAMS = (2, 3, 4)
PER_CLASS = 1200
EPOCHS = 8
RATE = 0.5
THRESHOLD = 0.7
BLOCK_CHARS = 2_000_000
CACHE_WORDS = 300_000        # words a worker remembers, and
CACHE_CHARS = 8_000_000      # their characters
SEED = 12

_MUL = np.uint32(0x9E3779B1)


def word_features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids of all words, start of each word's among them)."""
    marked = [f"<{w}>" for w in words]
    size = np.array([len(w) for w in marked], dtype=np.int64)
    cp = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.r_[0, np.cumsum(size)]
    owner = np.repeat(np.arange(len(words)), size)
    left = at[owner + 1] - np.arange(len(cp))  # characters to the word's end
    found = [(np.arange(len(words)),
              np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint32))]
    h = np.zeros(len(cp), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        more = np.zeros(len(cp), dtype=np.uint32)
        if len(cp) >= n:
            more[:len(cp) - n + 1] = cp[n - 1:]
        h = (h ^ (more + np.uint32(n))) * _MUL
        h ^= h >> np.uint32(15)
        if n in GRAMS:
            ok = left >= n
            found.append((owner[ok], h[ok] * np.uint32(2 * n + 1)))
    who = np.concatenate([x for x, _ in found])
    ids = np.concatenate([(x ^ (x >> np.uint32(16))) % np.uint32(buckets) for _, x in found]).astype(np.int32)
    order = np.argsort(who, kind="stable")
    return ids[order], np.searchsorted(who[order], np.arange(len(words) + 1))


def document_features(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature ids of a text and how often it has each."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    ids, _ = word_features(words, buckets)
    u, n = np.unique(ids, return_counts=True)
    again = sum(map(eq, words, islice(words, 1, None)))
    if again:
        u, n = np.r_[u, np.int32(buckets)], np.r_[n, again]
    return u, n.astype(np.int32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def descend(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, shares: tuple[float, float],
            buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE,
            seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embeddings, layer, bias) learned from documents' features and classes
    0 and 1, which weigh as their ``shares`` of all labels tell, whatever their
    shares of the sample."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1.0 / width, 1.0 / width, (buckets + 1, width)).astype(np.float32)
    layer, bias = rng.standard_normal((width, 2)) * 0.1, np.zeros(2)
    weigh = len(y) * np.array(shares) / sum(shares) / np.maximum(1, np.bincount(y, minlength=2))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            lr = rate * (1.0 - done / steps)
            done += 1
            ids, n = docs[i]
            w = (n / n.sum()).astype(np.float32) if len(ids) else n.astype(np.float32)
            h = w @ table[ids]
            g = _softmax(h @ layer + bias)
            g[y[i]] -= 1.0
            g *= weigh[y[i]]
            back = layer @ g
            layer -= lr * np.outer(h, g)
            bias -= 0.1 * lr * g
            if len(ids):
                table[ids] -= ((lr / float(w @ w)) * w)[:, None] * back.astype(np.float32)
    return table, layer.astype(np.float32), bias.astype(np.float32)


class Scorer:
    """Scores texts by what each word adds to the class sums."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray, np.ndarray]):
        table, layer, self.bias = model
        self.adds = (table @ layer).astype(np.float64)  # of each bucket
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.sums, self.sizes = np.zeros((0, 2)), np.zeros(0, dtype=np.int64)

    def learn(self, words: list[str]) -> None:
        ids, at = word_features(words, len(self.adds) - 1)
        self.index.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.chars += sum(map(len, words))
        self.sums = np.concatenate([self.sums, np.add.reduceat(self.adds[ids], at[:-1], axis=0)])
        self.sizes = np.concatenate([self.sizes, np.diff(at)])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.index) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.forget()
        split = [t.split() if t else [] for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        unseen = sorted(new.difference(self.index))
        if unseen:
            self.learn(unseen)
        z = np.empty((len(texts), 2))
        for i, words in enumerate(split):
            at = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
            again = int(np.count_nonzero(at[1:] == at[:-1]))
            z[i] = (self.sums[at].sum(axis=0) + again * self.adds[-1]) / max(1, int(self.sizes[at].sum()) + again) \
                + self.bias
        return _softmax(z)[:, 1]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple | None:
    """Learn from (doc_id, text) and (doc_id, quality); None without rows of
    both classes."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id") \
        .agg(F.min("quality").cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    key = unit_hash("doc_id", "quality:")
    share = F.when(F.col("y") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    # at most about 2 x ``per_class`` ids: a side of bounded size
    some = known.where(key < share).select("doc_id", "y", key.alias("k"))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("k", "y", "text")
    schema = pa.schema([("k", pa.float64()), ("y", pa.int32()), ("ids", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    def counted(batches):
        for b in batches:
            for k, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, n = document_features(t)
                yield rows_to_batch({"k": [k], "y": [y], "ids": [ids], "n": [n]}, schema)

    got = materialize(rows.mapInArrow(counted, "k double, y int, ids array<int>, n array<int>"), "quality-sample").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["k"][i].as_py(), got["y"][i].as_py()))
    y = got["y"].to_numpy()[order].astype(np.int64)
    if len(set(y.tolist())) < 2:
        return None
    return descend([(got["ids"][i].values.to_numpy(), got["n"][i].values.to_numpy()) for i in order], y, (counts[0], counts[1]))


def score(docs: DataFrame, model: tuple | None) -> DataFrame:
    """doc_id, score and predicted for every row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    if model is None:
        out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.5).alias("score"))
    else:
        bc = docs.sparkSession.sparkContext.broadcast({"value": model})

        def run(batches):
            s = per_worker(bc, Scorer)
            for ids, texts in text_blocks(batches, BLOCK_CHARS):
                yield rows_to_batch({"doc_id": ids, "score": s.score(texts)}, schema)

        out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def train_and_score(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """Learn from the labels of the other folds (crc32 of the id) and score
    every row."""
    held = crc32_of("doc_id") % folds == fold
    return score(docs, train(docs, labels.where(~held))).select("doc_id", held.alias("held_out"), "score", "predicted")
