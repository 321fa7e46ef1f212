"""Language identification in two steps.

A text's letters, pairs and triples of letters are counted in hashed bins.
One-versus-one linear support vector machines first tell the language family,
then, inside the family, closely related languages apart.

The machines are trained on the driver from a bounded sample
(``per_language`` documents of each language, chosen by a hash of the id, and
at most ``max_sample`` in all); every document is predicted from its whole
text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
without any labelled row everything is ``und``; with one learned language
every other text has it; repeated rows are predicted alike; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, per_worker, rows_to_batch, text_blocks, unit_hash
from .linear import train_svm

BINS = 4096
BLOCK_CHARS = 2_000_000
PER_LANGUAGE = 400
MAX_SAMPLE = 2000
SHORT = 60                   # characters of the short example that a document adds
LETTER = re.compile(r"[^\W\d_]")

# Families of languages; any other language is its own family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fo", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
}
_FAMILY = {lang: f for f, langs in FAMILIES.items() for lang in langs}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def _alpha_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x3000)], dtype=bool)


def bins(text: str, alpha: np.ndarray, size: int = BINS) -> np.ndarray:
    """Counts of the text's hashed letter n-grams (1 to 3); white space and
    marks between words count as one blank."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = np.where(cp < len(alpha), alpha[np.minimum(cp, len(alpha) - 1)], True)
    cp = np.where(letter, cp, 32)
    cp = cp[letter | np.r_[True, letter[:-1]]]
    cp = np.r_[np.uint32(32), cp].astype(np.uint32)
    shift = np.uint32(32 - (size.bit_length() - 1))
    one = cp * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (cp[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (cp[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
    out = np.bincount(one >> shift, minlength=size)
    for h in (two, three):
        if len(h):
            out = out + np.bincount(h >> shift, minlength=size)
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """Damped and scaled to length 1."""
    x = np.sqrt(counts.astype(np.float64))
    n = np.sqrt((x ** 2).sum(axis=-1, keepdims=True))
    return x / np.where(n > 0, n, 1.0)


class Model:
    """families: pairs of families; inside: pairs of languages of a family;
    every pair has one weight vector (positive: the first)."""

    def __init__(self, langs: list[str], machines: dict):
        self.langs, self.machines = sorted(langs), machines
        self.families = sorted({family_of(x) for x in self.langs})
        self.alpha = _alpha_table()

    def _vote(self, names: list[str], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(winner, its share) among ``names`` for each row."""
        total = np.zeros((len(x), len(names)))
        for i, j in combinations(range(len(names)), 2):
            w = self.machines[names[i], names[j]]
            p = 1.0 / (1.0 + np.exp(-np.clip(4.0 * (x @ w[:-1] + w[-1]), -30, 30)))
            total[:, i] += p
            total[:, j] += 1.0 - p
        best = total.argmax(axis=1)
        pairs = max(1, len(names) - 1)
        return best, total[np.arange(len(x)), best] / pairs if len(names) > 1 else np.ones(len(x))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not known or not self.langs:
            return lang, score
        x = features(np.stack([bins(texts[i], self.alpha) for i in known]))
        fam, sure = self._vote(self.families, x)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(fam == f)
            names = [z for z in self.langs if family_of(z) == name]
            best, share = self._vote(names, x[rows])
            for r, b, s in zip(rows.tolist(), best.tolist(), share.tolist(), strict=True):
                lang[known[r]], score[known[r]] = names[b], min(1.0, max(0.0, float(sure[r]) * s))
        return lang, score


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, max_sample: int = MAX_SAMPLE) -> Model:
    """Learn from (doc_id, text, lang) rows."""
    rows = labelled.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "lang").limit(max_sample).collect()}
    if not counts:
        return Model([], {})
    per = max(1, min(per_language, max_sample // len(counts)))
    part = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per / n))])
    sample = rows.where(unit_hash("doc_id", "lang:") < F.element_at(part, F.col("lang"))).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("at", pa.list_(pa.int16())), ("n", pa.list_(pa.int32()))])

    def counted(batches):
        alpha = _alpha_table()
        for langs, texts in text_blocks(batches, BLOCK_CHARS):
            out: dict[str, list] = {"lang": [], "at": [], "n": []}
            for lang, t in zip(langs, texts, strict=True):
                for piece in (t, t[:SHORT]):
                    if piece and LETTER.search(piece):
                        c = bins(piece, alpha)
                        at = np.flatnonzero(c)
                        out["lang"].append(lang)
                        out["at"].append(at.astype(np.int16))
                        out["n"].append(c[at].astype(np.int32))
            if out["lang"]:
                yield rows_to_batch(out, schema)

    got = sample.mapInArrow(counted, "lang string, at array<smallint>, n array<int>").toArrow()
    langs = got.column("lang").to_pylist()
    x = np.zeros((len(langs), BINS), dtype=np.float32)
    for i, (at, n) in enumerate(zip(got.column("at").to_pylist(), got.column("n").to_pylist(), strict=True)):
        x[i, at] = n
    for i in range(0, len(x), 256):
        x[i:i + 256] = features(x[i:i + 256])
    lang = np.array(langs, dtype=object)
    fam = np.array([family_of(z) for z in langs], dtype=object)
    names = sorted(set(langs))
    machines = {}
    for own, key in ((sorted(set(fam)), fam), (names, lang)):
        for a, b in combinations(own, 2):
            if key is lang and family_of(a) != family_of(b):
                continue
            rows_ = np.flatnonzero((key == a) | (key == b))
            machines[a, b] = train_svm(x[rows_], np.where(key[rows_] == a, 1.0, -1.0))
    return Model(names, machines)


def identify(docs: DataFrame, model: Model, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    bc = docs.sparkSession.sparkContext.broadcast({"value": (model.langs, model.machines)})
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        m = per_worker(bc, lambda v: Model(*v))
        for ids, texts in text_blocks(batches, BLOCK_CHARS):
            for i in range(0, len(ids), 256):
                lang, score = m.predict(texts[i:i + 256])
                yield rows_to_batch({"doc_id": ids[i:i + 256], "lang_pred": lang, "score": score}, schema)

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (F.lit(False) if held_out is None else held_out).alias("held_out"), "lang_pred", "score")


def train_and_identify(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """Learn from the rows of the other folds (crc32 of the id) and predict
    every row."""
    out = crc32_of("doc_id") % folds == fold
    return identify(docs, train(docs.where(~out).select("doc_id", "text", "lang")), out)
