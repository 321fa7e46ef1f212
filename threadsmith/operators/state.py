"""Per-topic resume state.

The state table has one row per topic key::

    topic_key string, title string, page_link string, file_path string,
    total_pages int, post_cursor int

It is stored as a log of changed rows (``keyed_log``): a run reads the latest
version and writes the rows it changed as the next one, so a table is never
overwritten while it is read and the bytes written follow the changed topics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..config import CurationConfig
from .keyed_log import KeyedLog

STATE_SCHEMA = StructType([
    StructField("topic_key", StringType()),
    StructField("title", StringType()),
    StructField("page_link", StringType()),
    StructField("file_path", StringType()),
    StructField("total_pages", IntegerType()),
    StructField("post_cursor", IntegerType()),
])
STATE_COLS = [f.name for f in STATE_SCHEMA.fields]
NO_PAGE = 2147483647


def empty_state(spark: SparkSession) -> DataFrame:
    """The state with no topic."""
    return spark.createDataFrame([], STATE_SCHEMA)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def state_log(spark: SparkSession, base: str) -> KeyedLog:
    return KeyedLog(spark, base, STATE_SCHEMA, ["topic_key"])


def latest_version(spark: SparkSession, base: str, at_most: int | None = None) -> int | None:
    """Largest committed version under ``base`` (a listing, no data is read),
    optionally not above ``at_most``."""
    return state_log(spark, base).latest(at_most)


def read_state(spark: SparkSession, base: str, at_most: int | None = None) -> DataFrame:
    """S5 (+S6 when missing): the latest state version (not above
    ``at_most`` when given, so a replayed batch reads what it read first)."""
    return state_log(spark, base).read(at_most)


def write_state(state: DataFrame, base: str, version: int) -> str:
    """Write a whole new state version; readers switch to it once it is
    complete."""
    return state_log(state.sparkSession, base).replace(state, version)


def write_changes(changed: DataFrame, base: str, version: int) -> bool:
    """Write the rows that this version inserts or updates (one per key);
    True if the log was compacted."""
    return state_log(changed.sparkSession, base).append(changed, version)


def clear_state(spark: SparkSession, base: str) -> str:
    """A new, empty version (older versions stay for audit)."""
    v = (latest_version(spark, base) or 0) + 1
    return write_state(empty_state(spark), base, v)


def one_per_key(state: DataFrame) -> DataFrame:
    """L2: one state row per topic key (the one read furthest; ties by the
    other columns) and none without a key."""
    rest = [c for c in STATE_COLS if c != "topic_key"]
    order = ["total_pages", "post_cursor", *[c for c in rest if c not in ("total_pages", "post_cursor")]]
    best = state.filter(F.col("topic_key").isNotNull()).groupBy("topic_key") \
        .agg(F.max(F.struct(*order)).alias("_b"))
    return best.select("topic_key", *[F.col("_b")[c].alias(c) for c in rest])


def upsert_state(old: DataFrame, new: DataFrame, unique: bool = False) -> DataFrame:
    """Update the row of each topic key present in ``new``, insert the
    others, keep the rest.  Sides that aren't known to have one row per key are
    reduced to one first."""
    if not unique:
        old, new = one_per_key(old), one_per_key(new)
    return old.join(new.select("topic_key"), "topic_key", "left_anti").select(*STATE_COLS) \
        .unionByName(new.select(*STATE_COLS))


def cursor_advance(selected: DataFrame, cfg: CurationConfig, key: str = "topic_id") -> DataFrame:
    """A4 + W5: per topic the last page of the run and the new cursor: the
    position of the last kept post when the last page added one, else 0
    (as coded) or -1 (intent, so post 0 is not skipped next time)."""
    none = 0 if cfg.resume_as_coded else -1
    agg = selected.groupBy(key).agg(
        F.max("page_no").alias("total_pages"),
        F.max(F.when(F.col("kept"), F.struct("page_no", "pos"))).alias("_lk"))
    cur = F.when(F.col("_lk.page_no") == F.col("total_pages"), F.col("_lk.pos")).otherwise(F.lit(none))
    if cfg.resume_as_coded:
        cur = F.coalesce(cur, F.lit(0))
        if cfg.all_posts:
            # as coded, all-posts mode never marks a page as having added a post
            cur = F.lit(0)
    return agg.select(key, F.col("total_pages").cast("int"), cur.cast("int").alias("post_cursor"))


def remaining_pages(total: Column, stored_total: Column) -> Column:
    """Pages to read: ``total - stored + 1`` with state, else ``total``."""
    return F.when(stored_total.isNull(), total).otherwise(total - stored_total + 1)


def frontier(topics: DataFrame, start: str = "start_page", total: str = "total_pages") -> DataFrame:
    """G1: one row per page to read, ``start..total`` (none when start >
    total; ``sequence`` alone would count down)."""
    seq = F.when(F.col(start) <= F.col(total),
                 F.sequence(F.col(start).cast("int"), F.col(total).cast("int")))
    return topics.withColumn("page_no", F.explode(seq))


def pages_after(pages: DataFrame, state: DataFrame, cfg: CurationConfig, key: str = "topic_id") -> DataFrame:
    """P11 on page rows: ``pages(key, page_no, max_pos)`` -> the pages still to
    be read with ``after``: positions above it are (-1: the whole page).

    ``state(key, total_pages, post_cursor[, read_to, last_pos])``.  Pages before
    the stored last page are not read again; on the resume page positions up to
    the cursor are skipped.  As coded, a page that never passes the cursor (no
    position above it and not a full page) carries the skip to the next page;
    that is computed from per-page maxima, not from a sequential scan.

    ``read_to``: the last page that earlier runs have read (a skip ends there,
    as they have carried it out); ``last_pos``: the last position of the resume
    page then, for a run that doesn't deliver it."""
    extra = [c for c in ("read_to", "last_pos") if c in state.columns]
    st = state.select(key, F.col("total_pages").alias("_sp"), F.col("post_cursor").alias("_sc"),
                      *[F.col(c).alias("_" + c) for c in extra])
    p = pages.select(key, "page_no", "max_pos").join(st, key, "left")      # the state is read once
    if cfg.resume_as_coded:
        known = p.filter(F.col("page_no") >= F.col("_sp")).select(key, "page_no", "max_pos", "_sc")
        if "last_pos" in extra:     # what the run delivers counts before what is remembered
            known = known.withColumn("_new", F.lit(True)).unionByName(st.filter("_last_pos is not null").select(
                key, F.col("_sp").alias("page_no"), F.col("_last_pos").alias("max_pos"), "_sc", F.lit(False).alias("_new")))
            known = known.groupBy(key, "page_no").agg(F.max_by("max_pos", "_new").alias("max_pos"), F.first("_sc").alias("_sc"))
        passes = (F.col("max_pos") > F.col("_sc")) | (F.col("max_pos") >= cfg.posts_per_page - 1)
        ends = known.filter(passes).groupBy(key).agg(F.min("page_no").alias("_end"))
        p = p.join(ends, key, "left")
        last = F.coalesce(F.col("_end"), F.lit(NO_PAGE))
        if "read_to" in extra:
            # beyond the resume page, pages read by earlier runs have ended the skip
            last = F.when(F.col("_read_to") > F.col("_sp"), F.least(last, F.col("_read_to"))).otherwise(last)
        skips = F.col("page_no") <= last
    else:
        skips = F.col("page_no") == F.col("_sp")
    return p.filter(F.col("_sp").isNull() | (F.col("page_no") >= F.col("_sp"))).select(
        key, "page_no", F.when(F.col("_sp").isNotNull() & skips, F.col("_sc")).otherwise(F.lit(-1)).cast("int").alias("after"))


def resume_filter(posts: DataFrame, state: DataFrame, cfg: CurationConfig,
                  key: str = "topic_id") -> DataFrame:
    """P11 + T2: drop what a previous run already handled.  Decided on one
    row per page (``pages_after``); the posts meet that by (topic, page)."""
    pages = posts.groupBy(key, "page_no").agg(F.max("pos").alias("max_pos"))
    return posts.join(pages_after(pages, state, cfg, key), [key, "page_no"]) \
        .filter(F.col("pos") > F.col("after")).drop("after")
