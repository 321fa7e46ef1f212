"""Ordered duplicate removal among the candidate posts of a topic.

Works on a narrow projection (topic, order key, 100-char text key, content
hash, image flag), written once to the shared checkpoint folder, and returns
a verdict per ``(topic_id, page_no, pos)``; the caller joins it back once.
Every step is a partially aggregated minimum (over the ``long`` order key;
the as-coded per-topic minima carry the text key in a struct) or a join on
keys that include the order key or the topic alone against a one-row-per-
topic table, so one hot topic or one hot text never lands in a single task.

Semantics:
* text posts, documented intent: a post is a duplicate when its key
  (first 100 chars, lower-cased) equals the key of an earlier kept post;
* text posts, as coded: before the second kept post ``p1`` exists the key is
  compared with the first kept post ``k0``; after it, only with ``p1``;
* image posts: a duplicate when its content equals an earlier kept image
  post (compared by SHA-256 of the content).  As coded with image resizing
  on, kept image posts were rewritten before the comparison, so none is
  ever found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..config import CurationConfig
from ..functions.text import dedup_key
from ..session import materialize
from .keyed_log import KeyedLog
from .ordering import order_key, order_parts

K = ["topic_id"]
# T4: the first-key index, one row per kept text or image of a topic with the
# smallest order key that has it; merged per run, in buckets of topics.
FIRST_KEYS = StructType([StructField("topic_key", StringType()), StructField("kind", StringType()),
                         StructField("key", StringType()), StructField("ord", LongType())])


def first_key_log(spark: SparkSession, base: str) -> KeyedLog:
    return KeyedLog(spark, base, FIRST_KEYS, ["topic_key", "kind", "key"], bucket_of=["topic_key"])


def merged_first_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that a run changes in the index: keys that it has not, and
    those whose order key becomes smaller."""
    o = old.select("topic_key", "kind", "key", F.col("ord").alias("_o"))
    n = new.groupBy("topic_key", "kind", "key").agg(F.min("ord").alias("ord"))
    return n.join(o, ["topic_key", "kind", "key"], "left").filter(F.col("_o").isNull() | (F.col("ord") < F.col("_o"))) \
        .select("topic_key", "kind", "key", "ord")


def duplicate_sequences(rows: DataFrame, seq: str = "images") -> DataFrame:
    """W4 on ordered sequences: ``rows(topic_id, page_no, pos, <seq> array)``
    -> ``topic_id, page_no, pos, is_dup``: an earlier row of the topic has the
    same sequence, in the same order.

    A sequence is known by a hash of its ordered array, so only hashes are
    counted; the arrays of those rows whose hash repeats are then compared as
    they are, so two sequences that share a hash stay apart."""
    n = materialize(rows.select(*K, order_key().alias("ord"), F.xxhash64(F.col(seq)).alias("h"), F.col(seq).alias("seq")),
                    "sequences")
    again = n.groupBy(*K, "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*K, "h")
    shared = n.join(again, [*K, "h"], "left_semi")
    first = shared.groupBy(*K, "h", "seq").agg(F.min("ord").alias("ord"))
    dup = shared.select(*K, "ord", "h").join(first.select(*K, "ord", "h"), [*K, "ord", "h"], "left_anti") \
        .select(*K, "ord").withColumn("is_dup", F.lit(True))
    out = n.select(*K, "ord").join(dup, [*K, "ord"], "left")
    return _unord(out.select(*K, "ord", F.coalesce("is_dup", F.lit(False)).alias("is_dup")))


def key_columns(cfg: CurationConfig) -> list:
    """Order key, image flag, text key and image-content key of a post."""
    return [order_key("page_no", "pos").alias("ord"),
            F.coalesce(F.col("img_post"), F.lit(False)).alias("img"),
            F.coalesce(dedup_key("content_text", cfg.dedup_prefix), F.lit("")).alias("tkey"),
            F.when(F.col("img_post"), F.sha2(F.coalesce(F.col("content_html"), F.lit("")), 256)).alias("ikey")]


def _narrow(cands: DataFrame, cfg: CurationConfig) -> DataFrame:
    return cands.select(*K, *key_columns(cfg))


def _firsts(df: DataFrame, key: str, flag: str) -> DataFrame:
    return df.groupBy(*K, key).agg(F.min("ord").alias("ord")).withColumn(flag, F.lit(True))


def duplicate_verdicts(cands: DataFrame, cfg: CurationConfig) -> DataFrame:
    """``cands`` = posts that passed every other rule (columns topic_id,
    page_no, pos, img_post, content_text, content_html).  Returns
    ``(topic_id, page_no, pos, is_dup)`` for every candidate."""
    return verdicts_from_keys(materialize(_narrow(cands, cfg), "dedup-keys"), cfg)


def verdicts_from_keys(n: DataFrame, cfg: CurationConfig, earlier: DataFrame | None = None) -> DataFrame:
    """Duplicate verdicts from the narrow key table ``(topic_id, ord, img,
    tkey, ikey)`` of the candidates.  Image and text rows are handled in
    separate branches (a table partitioned by the image flag is read only
    where needed); every join key includes the order key.

    ``earlier(topic_id, kind, key)``: the first-key index of earlier runs
    (documented intent, across runs).  Its keys enter the first-of-key pools
    with an order key below every post, so a repeat of them is a duplicate."""
    n = n.select(*K, "ord", "img", "tkey", "ikey")
    imgs = n.filter(F.col("img"))
    texts = n.filter(~F.col("img"))
    before = F.lit(-1).cast("long")
    ipool = imgs.select(*K, "ord", "ikey")
    if earlier is not None:
        ipool = ipool.unionByName(earlier.filter("kind = 'image'").select(*K, before.alias("ord"), F.col("key").alias("ikey")))
    ifirst = _firsts(ipool, "ikey", "img_first")
    img_v = imgs.join(ifirst, K + ["ikey", "ord"], "left") \
        .withColumn("img_first", F.coalesce("img_first", F.lit(False)))
    if not cfg.dedup_as_coded:
        kept_imgs = img_v.filter("img_first").select(*K, "ord", "tkey")
        pool = texts.select(*K, "ord", "tkey").unionByName(kept_imgs)
        if earlier is not None:
            pool = pool.unionByName(earlier.filter("kind = 'text'").select(*K, before.alias("ord"), F.col("key").alias("tkey")))
        tfirst = _firsts(pool, "tkey", "t_first")
        text_v = texts.join(tfirst, K + ["tkey", "ord"], "left") \
            .select(*K, "ord", (~F.coalesce("t_first", F.lit(False))).alias("is_dup"))
        return _unord(text_v.unionByName(img_v.select(*K, "ord", (~F.col("img_first")).alias("is_dup"))))
    # --- as coded ---------------------------------------------------------
    # k0 = key of the first candidate; p1 = first later candidate kept before
    # any second comparison (image kept, or text with another key); after p1
    # texts compare with p1 only.  Each is one partially aggregated min.
    img_ok = F.lit(True) if cfg.resize_images else F.col("img_first")
    rows = texts.withColumn("img_first", F.lit(None).cast("boolean")).unionByName(
        img_v.select(*K, "ord", "img", "tkey", "ikey", "img_first"))
    first = n.groupBy(*K).agg(F.min(F.struct("ord", "tkey")).alias("f"))
    n1 = rows.join(first, K)
    after_first = F.col("ord") > F.col("f.ord")
    elig = after_first & ((~F.col("img") & (F.col("tkey") != F.col("f.tkey"))) | (F.col("img") & img_ok))
    p1 = n1.filter(elig).groupBy(*K).agg(F.min(F.struct("ord", "tkey")).alias("p"))
    n2 = n1.join(p1, K, "left")
    before_p1 = F.col("p").isNull() | (F.col("ord") < F.col("p.ord"))
    text_dup = after_first & ((before_p1 & (F.col("tkey") == F.col("f.tkey")))
                              | (F.col("p").isNotNull() & (F.col("ord") > F.col("p.ord"))
                                 & (F.col("tkey") == F.col("p.tkey"))))
    img_dup = after_first & ~img_ok
    return _unord(n2.select(*K, "ord", F.when(F.col("img"), img_dup).otherwise(text_dup).alias("is_dup")))


def _unord(df: DataFrame) -> DataFrame:
    page, pos = order_parts("ord")
    return df.select(*K, page.alias("page_no"), pos.alias("pos"), "is_dup")
