"""Story documents: ordered concatenation, parts, file names (A5, A7, S9,
U19, W6, W7, G2, G3).

A story is never assembled in one task: it is rendered as ordered chunk rows
(one page of posts, or ``blocks_per_part`` blocks), each built from a bounded
group.  ``sources.stories`` appends chunks to the story table and streams
the chunks of each touched story in order into its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..config import STORY_FOOTER, STORY_HEADER, CurationConfig
from ..functions.text import quote_norm
from .ledger import INTERVAL, islands
from .ordering import rank_in_topic, sorted_positions


def ordered_concat(order_cols: list[str], value: str) -> Column:
    """Concatenate ``value`` in ``order_cols`` order inside a (bounded)
    group."""
    s = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order_cols], F.col(value).alias("_v"))))
    return F.array_join(F.transform(s, lambda x: x["_v"]), "")


def render_chunks(posts: DataFrame, chunk: str = "page_no", key: str = "topic_id") -> DataFrame:
    """Kept posts -> ``(story_key, chunk_no, html, n_posts)``; the
    typographic apostrophe is normalised (U11).  Each group is one chunk."""
    p = posts.select(key, chunk, "page_no", "pos", quote_norm("content_html").alias("_h"))
    return p.groupBy(key, chunk).agg(
        ordered_concat(["page_no", "pos"], "_h").alias("html"),
        F.count(F.lit(1)).alias("n_posts"),
    ).select(F.col(key).alias("story_key"), F.col(chunk).cast("long").alias("chunk_no"), "html", "n_posts")


def part_numbers(blocks: DataFrame, cfg: CurationConfig, key: str = "topic_id") -> DataFrame:
    """Part number = rank of the block in its story div blocks-per-part."""
    r = rank_in_topic(blocks, topic=key)
    return r.withColumn("part_no", F.floor(F.col("rank") / cfg.blocks_per_part).cast("long"))


def story_parts(blocks: DataFrame, cfg: CurationConfig, key: str = "topic_id") -> DataFrame:
    """W7 + A7: parts of ``blocks_per_part`` blocks, in order."""
    r = part_numbers(blocks, cfg, key)
    return r.groupBy(key, "part_no").agg(
        ordered_concat(["rank"], "content_html").alias("html"),
        F.count(F.lit(1)).alias("n_blocks"),
    ).select(F.col(key).alias("story_key"), "part_no", "html", "n_blocks")


def story_sizes(blocks: DataFrame, cfg: CurationConfig, key: str = "topic_id") -> DataFrame:
    """U19 + G3: bytes of each story (header + blocks + footer, UTF-8) and
    whether it must be split.  Summed per block, so no story is built."""
    fixed = len((STORY_HEADER + STORY_FOOTER).encode("utf-8"))
    s = blocks.groupBy(key).agg(
        (F.sum(F.octet_length(quote_norm("content_html"))) + F.lit(fixed)).cast("long").alias("n_bytes"),
        F.count(F.lit(1)).alias("n_blocks"))
    return s.select(F.col(key).alias("story_key"), "n_bytes", "n_blocks",
                    (F.col("n_bytes") >= cfg.big_story_bytes).alias("is_big"))


def version_numbers(new: DataFrame, used: DataFrame, slug: str = "slug", order: str = "link_no") -> DataFrame:
    """Each new story gets the smallest free version N >= 0 of its slug.

    The used versions of a slug are intervals (islands: nearly always one), and
    the ``r``-th new row of a slug gets ``r`` plus the lengths of the intervals
    that begin at or before the number so reached.  Ranks come from one global
    sort of the new rows (``ordering.sorted_positions``: range partitioned, so a
    slug shared by many stories spans many tasks) and per-slug minima; no window
    is partitioned by slug and no pairs are formed.  Only slugs with new rows
    are looked at."""
    n = sorted_positions(new, [slug, order])
    firsts = n.groupBy(slug).agg(F.min("_pos").alias("_s"))
    taken = islands(used.join(firsts.select(slug), slug, "left_semi")
                    .select(slug, F.col("version").cast("int").alias("page_no")), slug)
    per = firsts.join(taken, slug, "left")

    def step(v, x):
        return v + F.when(x["lo"] <= v, x["hi"] - x["lo"] + 1).otherwise(0).cast("long")

    rank = (F.col("_pos") - F.col("_s")).cast("long")
    free = F.aggregate(F.coalesce("pages", F.array().cast(ArrayType(INTERVAL))), rank, step)
    return n.join(per, slug).select(slug, *[c for c in new.columns if c != slug], free.alias("version"))
