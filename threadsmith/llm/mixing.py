"""Mixing sources to target weights.

Sizes are aggregated per source, weights give each source a share of the
wanted total, a source stops at ``cap`` times its size and the excess is
shared again by weight; each document is then taken floor(rate) times plus
once more with probability equal to the fraction, from a hash of its id.

Defined cases: a null text has size 0; a null source is a source of its own
and comes last; an empty table gives an empty plan; a source without words
has target 0 and takes nothing; rows with the same id share one coin, so
repeated rows are taken alike; further columns are carried, never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import sorted_positions
from ..session import materialize
from .common import unit_hash

SEED = "mix:"
GAP = r"[\x20\x09-\x0D]+"       # what lies between words


def word_count(text: Column) -> Column:
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")
    return F.size(words).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """``sizes``: (source, size) rows.  One row per source: source,
    source_size, target.

    The sharing is water filling: with the capped set C every other source
    gets ``level * weight``; C grows until no source is above its cap.  Each
    round is one aggregate over the per-source table (two numbers reach the
    driver), and there are at most as many rounds as distinct cap levels."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # null last, then by code point (Spark compares UTF-8 bytes)
    per = per.withColumn("_null", F.col("source").isNull())
    per = sorted_positions(per, ["_null", "source"])
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_pos") % len(weights) + 1).cast("int"))
    per = materialize(per.select("source", "source_size", pick.cast("double").alias("_w")), "mix-sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    full = F.col("source_size") * F.lit(float(cap))
    level, before = 0.0, -1
    capped = F.lit(False)
    while True:
        n, full_sum, w = per.agg(F.coalesce(F.sum(capped.cast("int")), F.lit(0)),
                                 F.coalesce(F.sum(F.when(capped, full)), F.lit(0.0)),
                                 F.coalesce(F.sum(F.when(~capped, F.col("_w"))), F.lit(0.0))).first()
        if n == before or w == 0:
            break
        before, level = n, (share * total - full_sum) / w
        capped = full < F.lit(level) * F.col("_w")
    return per.select("source", "source_size", F.when(capped, full).otherwise(F.lit(level) * F.col("_w"))
                      .alias("target"))


def with_copies(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
                seed: str = SEED) -> DataFrame:
    """``docs`` (with their size in _size) plus _source_size, _target and
    _copies (how often the mix takes the document).  The join side has one row
    per source."""
    t = source_targets(docs.select("source", F.col("_size").alias("size")), weights, share, cap).select(
        F.col("source").alias("_src"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    coin = (unit_hash("doc_id", seed) < rate - whole).cast("long")
    return docs.join(t, docs["source"].eqNullSafe(F.col("_src"))).drop("_src") \
        .withColumn("_copies", (whole + coin).cast("long"))


def mix_plan(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words taken, repeats counted).
    The words are counted in one scan, whose narrow rows are kept."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("_size")), "mix-sizes")
    return with_copies(sized, **how).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it."""
    return with_copies(docs.withColumn("_size", word_count(F.col("text"))), **how).where(F.col("_copies") > 0) \
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)
