"""Connected components of a link table, and a broadcast bitmap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: (a, b) long rows.  (node, label) with the smallest node of
    each component, for every node that has a link.

    Each round takes the smallest label among a node's neighbours and then
    the label's own label (pointer jumping); rounds end when nothing changes.
    Every round is written to the shared folder, which cuts its lineage."""
    e = links.where("a <> b")
    e = materialize(e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                    "links")
    lab = materialize(e.groupBy("a").agg(F.min("b").alias("_m"))
                      .select(F.col("a").alias("node"), F.least("a", "_m").alias("label")), "labels")
    while True:
        near = e.join(lab, e["b"] == lab["node"]).groupBy("a").agg(F.min("label").alias("_m"))
        step = lab.join(near, lab["node"] == near["a"]).select(
            "node", F.col("label").alias("_old"), F.least("label", "_m").alias("label"))
        up = lab.select(F.col("node").alias("_n"), F.col("label").alias("_up"))
        new = materialize(step.join(up, step["label"] == up["_n"], "left").select(
            "node", "_old", F.least("label", F.coalesce("_up", "label")).alias("label")), "labels")
        lab = new.select("node", "label")
        if new.where("label <> _old").limit(1).count() == 0:
            return lab


def bitmap(keys: DataFrame, col: str, log2_bits: int = 25) -> np.ndarray:
    """A bitmap of fixed size with the bit of every key set (for a 64-bit
    column whose low bits are well mixed).  Its size doesn't grow with the
    keys: more keys only make it less selective, and whoever uses it checks
    what passes exactly."""
    k = F.col(col).cast("long")
    slot = k.bitwiseAND((1 << log2_bits) - 1)
    words = keys.select(F.shiftright(slot, 5).alias("w"),
                        F.expr(f"shiftleft(1L, cast({col} & 31L AS int))").alias("v")) \
        .groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    out = np.zeros(1 << (log2_bits - 5), dtype=np.uint32)
    if len(words):
        out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).astype(np.uint32)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys.astype(np.int64) & (len(bits) * 32 - 1)
    return (bits[k >> 5] >> (k & 31).astype(np.uint32)) & np.uint32(1) == 1
