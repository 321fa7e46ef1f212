"""Order-dependent helpers that stay skew-safe.

A topic may hold a large share of all posts, so nothing here partitions a
window by the topic alone.  Ranks inside a topic are built from aggregates
and windows over small keys: posts of one page, pages of one block, blocks of
one topic (each level is ~``block`` times smaller than the one below).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE_BLOCK = 1024  # pages per block in the hierarchical prefix sum
ORD_SHIFT = 31     # order key = page_no << 31 | pos: every int that isn't negative fits


def order_key(page: str = "page_no", pos: str = "pos"):
    """(page, position) as one sortable ``long`` (hash-aggregatable).  The whole
    range of both ints is kept; a negative one is an error, as it would sort
    wrongly, and a null gives null."""
    p, q = F.col(page).cast("long"), F.col(pos).cast("long")
    top = (1 << ORD_SHIFT) - 1
    fits = p.between(0, top) & q.between(0, top)
    key = F.shiftleft(p, ORD_SHIFT) + q
    return F.when(fits, key).when(p.isNotNull() & q.isNotNull(), F.raise_error(F.concat(
        F.lit("page or position out of range: "), p.cast("string"), F.lit(", "), q.cast("string"))).cast("long"))


def order_parts(key: str) -> tuple:
    """The (page, position) columns of an order key."""
    return (F.shiftright(key, ORD_SHIFT).cast("int"), F.col(key).bitwiseAND((1 << ORD_SHIFT) - 1).cast("int"))


def rank_in_topic(df: DataFrame, topic: str = "topic_id", page: str = "page_no",
                  pos: str = "pos", out: str = "rank", block: int = PAGE_BLOCK) -> DataFrame:
    """0-based rank of each row inside its topic by (page, pos).

    Rows are ranked within their page (bounded by the page size), pages get
    offsets from a prefix sum over page counts, computed per block of pages
    and per topic over block totals.  Returns ``df`` plus ``out`` (long).
    """
    keys = df.select(topic, page, pos)
    in_page = keys.withColumn(
        "_r", F.row_number().over(Window.partitionBy(topic, page).orderBy(pos)) - 1)
    pages = keys.groupBy(topic, page).agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_blk", F.floor(F.col(page) / block))
    blocks = pages.groupBy(topic, "_blk").agg(F.sum("_n").alias("_bn"))
    wb = Window.partitionBy(topic).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_boff", F.coalesce(F.sum("_bn").over(wb), F.lit(0)))
    wp = Window.partitionBy(topic, "_blk").orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("_poff", F.coalesce(F.sum("_n").over(wp), F.lit(0))) \
        .join(blocks.select(topic, "_blk", "_boff"), [topic, "_blk"]) \
        .select(topic, page, (F.col("_boff") + F.col("_poff")).alias("_off"))
    ranked = in_page.join(pages, [topic, page]) \
        .select(topic, page, pos, (F.col("_off") + F.col("_r")).cast("long").alias(out))
    return df.join(ranked, [topic, page, pos])


def sorted_positions(df: DataFrame, by: list[str], parts: int | None = None) -> DataFrame:
    """Dense 0-based position of every row in the global order ``by``.

    The rows are range-partitioned on ``by`` (a hot key spans many
    partitions), positions inside a partition come from the sort, and
    partition offsets from a prefix sum over the per-partition counts (one
    row per partition).  The assignment is written once (range bounds are
    sampled per execution).  Adds ``_pos`` (long) and ``_pid`` (int)."""
    from ..session import materialize
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(parts, *by).sortWithinPartitions(*by) \
        .withColumn("_pid", F.spark_partition_id()) \
        .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33))
    # range bounds are sampled per execution: write the assignment once so
    # counts and positions come from the same partitioning
    s = materialize(s, "sorted")
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_pid", "_off")
    return s.join(F.broadcast(offsets), "_pid").withColumn("_pos", F.col("_off") + F.col("_local")) \
        .drop("_off", "_local")
