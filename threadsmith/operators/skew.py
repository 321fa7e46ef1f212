"""Joins with hot keys.

A key that very many rows of the left side share (the ``alt`` of one emoticon in
every post) would put them all into one task of a shuffled join.  The rows are
counted per key (partially aggregated), the hottest keys, a bounded list, meet
their right rows by a broadcast, and only the others are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

HOT_ROWS = 10_000       # rows from which a key is hot
HOT_KEYS = 10_000       # hot keys that are broadcast at most (the hottest)


def hot_keys(left: DataFrame, key: str, hot_rows: int = HOT_ROWS, most: int = HOT_KEYS) -> DataFrame:
    """The hottest keys of ``left``: a table of at most ``most`` rows."""
    return left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")) \
        .filter(F.col("_n") >= hot_rows).orderBy(F.desc("_n"), key).limit(most).select(key)


def lookup(left: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_ROWS, most: int = HOT_KEYS) -> DataFrame:
    """``left`` left-joined with ``right`` (one row per key): distinct keys are
    resolved first, so ``right`` is read for the keys that are asked for; hot
    keys then travel by broadcast, the rest by a shuffled join."""
    found = materialize(right.join(left.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_semi"), "looked-up")
    hot = materialize(hot_keys(left, key, hot_rows, most), "hot-keys")
    few = F.broadcast(hot.join(found, key, "left").withColumn("_hot", F.lit(True)))   # at most ``most`` rows
    rest = [c for c in right.columns if c != key]
    both = left.join(few, key, "left")
    cold = both.filter(F.col("_hot").isNull()).drop("_hot", *rest)
    return both.filter("_hot").drop("_hot").unionByName(cold.join(found, key, "left"))
