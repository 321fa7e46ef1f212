"""Toxicity by a weighted finite-state pattern grammar.

A text is read as clauses of words.  A lexical transducer turns each word
into a class: insult (stems and words learned from labelled documents, plus
none by hand), threat, target, negation, reported speech, or other.  Pattern
transducers over the classes, composed in this order, give every matched
clause a weight: an insult weighs 1, more with a target near it, less when
negated or reported; a threat weighs when it has a target.  A document's
score is a logistic of its best clause and the sum of its clauses, fitted on
the same labelled sample.

The lexicon and the logistic are learned from a bounded sample (``sample``
labelled documents, chosen by a hash of the id; near copies count once, by
their smallest hash of three words).  Every document is scored on its whole text.

Defined cases: null and empty texts have no clauses and get the score of a
document without a match; without labelled rows (or without toxic ones) only
threats with targets count, by fixed weights; repeated label rows count once,
as toxic if one of them is; repeated documents are scored alike; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import crc32_of, per_worker, rows_to_batch, text_blocks, unit_hash
from .linear import train_logistic

SAMPLE = 12_000
THRESHOLD = 0.7
BLOCK_CHARS = 2_000_000
CACHE_WORDS = 300_000
CHUNK = 200                  # sample documents whose units are counted at once
STEM_MIN, STEM_MAX = 4, 8    # letters of a learned stem
MIN_DOCS = 5                 # toxic documents of the sample that a unit needs
PRECISION = 0.93             # part of the unit's documents that are toxic, smoothed
LEXICON = 2000               # units kept at most (the strongest)

# Fixed values of the grammar: classes of closed word lists.
THREAT = frozenset("""kill hurt destroy murder strangle stab shoot beat smash töten umbringen vernichten
schlagen tuer détruire frapper écraser matar destruir golpear aplastar""".split())
TARGET = frozenset("""you your yours u yourself du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous
votre vos tú ti tus usted ustedes vosotros he she they them him her""".split())
NEGATION = frozenset("""not no never none nobody isn't aren't don't doesn't without nicht kein keine nie niemals
ohne ne pas jamais aucun sans nunca ningún sin""".split())
REPORTED = frozenset("""said says wrote claimed quoted quote reported according allegedly called sagte schrieb
behauptete laut dit écrit selon prétend dijo escribió según""".split())

OTHER, INSULT, THREATEN, AIM, NOT, SAID, END = b".ITYNR|"
TOKEN = re.compile(r"\w[\w'’]*|[.!?;:\n\"“”]")
# Pattern transducers over class strings: (pattern, weight factor).
CLAUSE = re.compile(rb"[^|]+")
NEGATED = re.compile(rb"N[^|]{0,2}$")
REPORT = re.compile(rb"R[^|]*$")
AIMED = (re.compile(rb"Y[^|]{0,3}$"), re.compile(rb"^[^|]{0,3}Y"))
W_NEGATED, W_REPORTED, W_AIMED, W_THREAT, W_LOOSE_THREAT = 0.6, 0.7, 1.3, 1.0, 0.1
PLAIN = (2.0, 1.0, -4.0)     # weights without labels


class Lexicon(dict):
    """Word -> class byte."""

    def __init__(self, stems: set[str], words: set[str]):
        super().__init__()
        self.stems, self.words = stems, words
        self.sizes = sorted({len(s) for s in stems})

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = c = self._class(word)
        return c

    def _class(self, w: str) -> int:
        if not (w[0].isalnum() or w[0] == "_"):
            return END
        if w in self.words or any(w[:n] in self.stems for n in self.sizes if len(w) >= n):
            return INSULT
        for c, words in ((THREATEN, THREAT), (AIM, TARGET), (NOT, NEGATION), (SAID, REPORTED)):
            if w in words:
                return c
        return OTHER


def clause_weights(classes: bytes) -> list[float]:
    """Weights of the clauses that match."""
    out = []
    for m in CLAUSE.finditer(classes):
        clause = m[0]
        if b"I" not in clause and b"T" not in clause:
            continue
        best = 0.0
        for i, c in enumerate(clause):
            if c == INSULT:
                w = 1.0
            elif c == THREATEN:
                w = W_THREAT if AIMED[1].search(clause[i + 1:]) else W_LOOSE_THREAT
            else:
                continue
            before, after = clause[:i], clause[i + 1:]
            if c == INSULT and (AIMED[0].search(before) or AIMED[1].search(after)):
                w *= W_AIMED
            if NEGATED.search(before):
                w *= W_NEGATED
            if REPORT.search(before):
                w *= W_REPORTED
            best = max(best, w)
        out.append(best)
    return out


def document_features(text: str | None, lexicon: Lexicon) -> tuple[float, float]:
    """(best clause, log of one plus the sum of the clauses)."""
    words = TOKEN.findall(text.lower()) if text else []
    classes = bytes(map(lexicon.__getitem__, words))
    if b"I" not in classes and b"T" not in classes:
        return 0.0, 0.0
    w = clause_weights(classes)
    return max(w), float(np.log1p(sum(w)))


class Scorer:
    def __init__(self, value: tuple):
        stems, words, self.w = value
        self.lexicon = Lexicon(set(stems), set(words))

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([document_features(t, self.lexicon) for t in texts]).reshape(-1, 2)
        z = x @ np.asarray(self.w[:2]) + self.w[2]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _units(text: str) -> set[str]:
    """Words ("=word") and stems ("stem") of a text."""
    out = set()
    for w in set(TOKEN.findall(text.lower())):
        if len(w) < 3:
            continue
        out.add("=" + w)
        out.update(w[:n] for n in range(STEM_MIN, min(STEM_MAX, len(w) - 1) + 1))
    return out


def _choose(units: list[tuple[str, int]]) -> tuple[list[str], list[str]]:
    """Units that tell toxic documents, without those that another covers.  A
    stem stays if it has more documents than any longer unit of its own."""
    n = dict(units)
    longer: dict[str, int] = {}
    for u, c in units:
        w = u.lstrip("=")
        for k in range(STEM_MIN, len(w) if u[0] != "=" else len(w) + 1):
            longer[w[:k]] = max(longer.get(w[:k], 0), c)
    stems = {u for u, c in units if u[0] != "=" and c > 1.1 * longer.get(u, 0)}
    stems = {s for s in stems if not any(s[:k] in stems for k in range(STEM_MIN, len(s)))}
    words = {u[1:] for u in n if u[0] == "=" and not any(u[1:1 + k] in stems for k in range(STEM_MIN, len(u)))}
    return sorted(stems), sorted(words)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple:
    """Learn (stems, words, weights) from (doc_id, text) and (doc_id, toxic)."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    total = known.count()
    if not total:
        return [], [], PLAIN
    # at most about ``sample`` ids: a side of bounded size
    some = known.where(unit_hash("doc_id", "tox:") < min(1.0, sample / total))
    rows = materialize(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id"),
                       "toxicity-sample")
    schema = pa.schema([("unit", pa.string()), ("t", pa.int64()), ("c", pa.int64()), ("id", pa.int64())])

    def signs(batches):
        met: set = set()
        for b in (b.slice(i, CHUNK) for b in batches for i in range(0, b.num_rows, CHUNK)):
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for t, v, mark in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (v, mark) in met:
                    continue
                met.add((v, mark))
                n[int(v == 1)].update(_units(t))
                n[int(v == 1)][""] += 1
            units = list(n[0].keys() | n[1].keys())
            yield rows_to_batch({"unit": units, "t": [n[1][u] for u in units], "c": [n[0][u] for u in units],
                                 "id": [0] * len(units)}, schema)

    # near copies, told by their smallest three-word hash, meet in one task, so
    # they count once
    words = F.split(F.lower("text"), r"\s+")
    least = F.get(F.transform(F.array(words), lambda w: F.array_min(F.transform(w, lambda x, i: F.crc32(F.concat_ws(
        " ", x, F.get(w, i + 1), F.get(w, i + 2)).cast("binary"))))), F.lit(0))
    counted = rows.select("text", "y", least.alias("_m")).repartition(32, "_m") \
        .mapInArrow(signs, "unit string, t long, c long, id long")
    sums = materialize(counted.groupBy("unit").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "toxicity-units")
    bad, good = (sums.where("unit = ''").select("t", "c").first() or (0, 0))
    if not bad or not good:
        return [], [], PLAIN
    odds = (F.col("t") + 0.5) / (F.col("t") + F.col("c") + 1.0)
    units = sums.where((F.col("unit") != "") & (F.col("t") >= MIN_DOCS) & (odds >= PRECISION)) \
        .orderBy(F.desc("t"), "unit").limit(LEXICON).collect()
    stems, words = _choose([(r["unit"], r["t"]) for r in units])
    fit = pa.schema([("a", pa.float64()), ("b", pa.float64()), ("y", pa.int32())])

    def matched(batches):
        lex = Lexicon(set(stems), set(words))
        for b in batches:
            x = [document_features(t, lex) for t in b.column(0).to_pylist()]
            yield rows_to_batch({"a": [v[0] for v in x], "b": [v[1] for v in x],
                                 "y": [int(v == 1) for v in b.column(1).to_pylist()]}, fit)

    got = rows.select("text", "y").mapInArrow(matched, "a double, b double, y int").toPandas()
    w = train_logistic(got[["a", "b"]].to_numpy(float), got["y"].to_numpy(float))
    return stems, words, tuple(float(v) for v in w)


def score(docs: DataFrame, model: tuple, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score and predicted for every row of ``docs``."""
    bc = docs.sparkSession.sparkContext.broadcast({"value": model})
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        s = per_worker(bc, Scorer)
        for ids, texts in text_blocks(batches, BLOCK_CHARS):
            yield rows_to_batch({"doc_id": ids, "score": s.score(texts)}, schema)

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxic(model: tuple, spark) -> object:
    """The score as a column function of a text column (for filters that
    keep whole rows)."""
    bc = spark.sparkContext.broadcast({"value": model})

    def run(series):
        import pandas as pd
        s = per_worker(bc, Scorer)
        for t in series:
            yield pd.Series(s.score([None if x is None else x for x in t]))

    return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)


def fold_of(folds: int = 3) -> Column:
    return crc32_of("doc_id") % folds


def train_and_score(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """Learn from the labels of the other folds and score every row."""
    held = fold_of(folds) == fold
    model = train(docs, labels.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """``docs`` without the rows that are predicted toxic."""
    model = train(docs, labels.where(fold_of(folds) != fold))
    return docs.where(toxic(model, docs.sparkSession)("text") < THRESHOLD)
