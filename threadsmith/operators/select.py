"""Which posts belong to the story.

Input ``posts`` schema (one row per post, produced by the extraction job or
an adapter)::

    topic_id, page_no int, pos int, post_author string,
    post_text string, content_text string, content_html string,
    post_paragraphs array<string>, paragraphs array<string>,
    n_hosted int, content_n_hosted int, n_post_links int, n_links int,
    post_has_blockquote boolean, content_has_blockquote boolean

``topics`` carries ``topic_id, domain, topic_author``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ARCHIVE_HOST, SITE_B, CurationConfig
from ..functions.text import author_root, has_identifier, is_short, ws_trim
from ..session import materialize
from .dedup import verdicts_from_keys
from .ordering import order_key

REASON_AUTHOR = "author"
REASON_QUOTE = "quote"
REASON_SHORT = "short"
REASON_DUP = "duplicate"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def topic_authors(posts: DataFrame, cfg: CurationConfig) -> DataFrame:
    """A1 + A2: the topic author is the author of the first post (page 1
    first); the author set adds the extra authors.  Partially aggregated."""
    first = posts.groupBy("topic_id").agg(
        F.min_by("post_author", F.struct("page_no", "pos")).alias("topic_author"))
    return first.withColumn("authors", author_set("topic_author", cfg.extra_authors))


def author_set(topic_author, extra) -> Column:
    """A2: ``[topic author] + extra authors`` without repeats."""
    extra_arr = F.array(*[F.lit(a) for a in extra]) if extra else F.array().cast("array<string>")
    return F.array_union(F.array(_c(topic_author)), extra_arr)


def author_match(post_author, authors, match_root: bool = True) -> Column:
    """Exact membership, or (default) the digit-free root of any author is
    a case-sensitive substring of the post author.  Null author -> false."""
    pa = _c(post_author)
    exact = F.array_contains(_c(authors), pa)
    if match_root:
        res = exact | F.exists(_c(authors), lambda a: F.contains(pa, author_root(a)))
    else:
        res = exact
    return F.coalesce(res, F.lit(False))


def hosted_count(images) -> Column:
    """Number of hosted images of a post (array of image structs)."""
    return F.size(F.filter(F.coalesce(_c(images), F.array()), lambda i: F.coalesce(i["hosted"], F.lit(False))))


def image_post(paragraphs, n_hosted, has_blockquote, text, dom, n_links,
               cfg: CurationConfig) -> Column:
    """P7, closed form of the order-dependent fold::

        no paragraph: site B and the post has links
        otherwise:    >= 3 hosted images, no quote, stripped text < 300
                      and (some paragraph mentions screen|repost|supprime
                           or the last paragraph is blank)
    """
    from ..config import IMAGE_KEYWORDS
    paras = F.coalesce(_c(paragraphs), F.array().cast("array<string>"))
    gate = ((F.coalesce(_c(n_hosted), F.lit(0)) >= cfg.image_min_images)
            & ~F.coalesce(_c(has_blockquote), F.lit(False))
            & (F.length(ws_trim(F.coalesce(_c(text), F.lit("")))) < cfg.image_max_chars))
    keyword = F.exists(paras, lambda p: p.rlike(IMAGE_KEYWORDS))
    last_blank = F.length(ws_trim(F.element_at(paras, -1))) == 0
    return F.when(F.size(paras) == 0,
                  (F.coalesce(_c(dom), F.lit("")) == SITE_B) & (F.coalesce(_c(n_links), F.lit(0)) > 0)) \
        .otherwise(gate & (keyword | last_blank))


def scope_verdicts(posts: DataFrame, cfg: CurationConfig) -> tuple[Column, Column]:
    """P7/A8 on both scopes of a post: (image post, image content)."""
    dom = F.col("domain") if "domain" in posts.columns else F.lit("")
    n_hosted = hosted_count("images") if "images" in posts.columns else F.col("content_n_hosted")
    return (image_post("post_paragraphs", "n_hosted", "post_has_blockquote", "post_text", dom, "n_post_links", cfg),
            image_post("paragraphs", n_hosted, "content_has_blockquote", "content_text", dom, "n_links", cfg))


def classify(posts: DataFrame, topics: DataFrame, cfg: CurationConfig, take: DataFrame | None = None) -> DataFrame:
    """Narrow per-post verdict inputs: ``topic_id, page_no, pos[, src],
    is_author, img_post`` (post scope), ``content_img`` (content scope),
    ``pre_reason`` (first rule that rejects the post before the duplicate test)
    and the dedup keys.  Text columns are reduced to flags/keys in the scan, so
    the joins with the topic table and with ``take(topic_id, page_no, after[,
    src])``, the pages to read and the position after which, move narrow rows
    only."""
    dom = F.col("domain") if "domain" in posts.columns else F.lit("")
    img, content_img = scope_verdicts(posts, cfg)
    short = is_short("post_text", cfg.min_chars)
    if cfg.identifier_rescues_short:
        short = short & ~has_identifier(F.get("post_paragraphs", 0), cfg.identifiers,
                                        cfg.identifier_window, "post_has_blockquote")
    src = [c for c in ("src",) if c in posts.columns]
    nar = posts.select("topic_id", "page_no", "pos", *src, "post_author", dom.alias("_dom"),
                       img.alias("img_post"), short.alias("_short"), content_img.alias("content_img"),
                       F.coalesce(F.col("content_has_blockquote"), F.lit(False)).alias("_quote"),
                       *key_columns_for(cfg))
    if take is not None:
        nar = nar.join(take, ["topic_id", "page_no", *src]).filter(F.col("pos") > F.col("after")).drop("after")
    t = topics.select("topic_id", author_set("topic_author", cfg.extra_authors).alias("authors"))
    p = nar.join(t, "topic_id")
    p = p.withColumn("is_author", author_match("post_author", "authors", cfg.match_author_root))
    author_ok = F.col("is_author") | (F.col("_dom") == ARCHIVE_HOST)
    reason = F.when(~author_ok, F.lit(REASON_AUTHOR))
    if not cfg.all_posts:
        reason = reason.when(F.col("_quote"), F.lit(REASON_QUOTE)) \
            .when(F.col("_short") & ~F.col("img_post"), F.lit(REASON_SHORT))
    return p.select("topic_id", "page_no", "pos", *src, "is_author", "img_post", "content_img",
                    reason.alias("pre_reason"), "ord", "tkey", "ikey")


def key_columns_for(cfg: CurationConfig) -> list:
    from .dedup import key_columns
    k = key_columns(cfg)
    return [k[0], k[2], k[3]]          # ord, tkey, ikey (the image flag is img_post)


def selection_verdicts(posts: DataFrame, topics: DataFrame, cfg: CurationConfig,
                       earlier_keys: DataFrame | None = None, take: DataFrame | None = None) -> DataFrame:
    """Narrow verdict per post (of the pages in ``take``, if given):
    ``topic_id, page_no, pos[, src], is_author, img_post, reject_reason`` (null
    = kept), ``kept``, ``is_image`` and the dedup keys.

    The narrow classification is written once (it feeds the dedup and the
    verdict); counters, cursors and reject lists need nothing else."""
    # partitioned by (candidate, image post): the dedup branches read only
    # the candidate partitions, and the image branch only the (rare) images
    nc = materialize(classify(posts, topics, cfg, take).withColumn("cand", F.col("pre_reason").isNull()),
                     "classified", partition_by=["cand", "img_post"])
    place = ["topic_id", "page_no", "pos", *[c for c in ("src",) if c in nc.columns]]
    if cfg.all_posts:
        verdict = nc.select(*place, "is_author", "img_post", F.col("pre_reason").alias("reject_reason"),
                            F.lit(False).alias("is_image"), "tkey", "ikey")
    else:
        keys = nc.filter(F.col("cand")).select(
            "topic_id", "ord", F.col("img_post").alias("img"), "tkey", "ikey")
        v = verdicts_from_keys(keys, cfg, earlier_keys)
        verdict = nc.join(v, ["topic_id", "page_no", "pos"], "left").select(
            *place, "is_author", "img_post",
            F.coalesce(F.col("pre_reason"), F.when(F.col("is_dup"), F.lit(REASON_DUP))).alias("reject_reason"),
            "content_img", "tkey", "ikey")
        verdict = verdict.withColumn("is_image", F.col("reject_reason").isNull() & F.col("content_img")) \
            .drop("content_img")
    return verdict.withColumn("kept", F.col("reject_reason").isNull())


def kept_keys(verdict: DataFrame) -> DataFrame:
    """T4: the dedup keys of the kept posts (``topic_id, kind, key, ord``), each
    with the smallest order key that has it: the rows that a run adds to the
    first-key index (``dedup.FIRST_KEYS``)."""
    k = verdict.filter("kept").select("topic_id", order_key().alias("ord"), "img_post", "tkey", "ikey")
    text = k.select("topic_id", F.lit("text").alias("kind"), F.col("tkey").alias("key"), "ord")
    image = k.filter("img_post").select("topic_id", F.lit("image").alias("kind"), F.col("ikey").alias("key"), "ord")
    return text.unionByName(image).groupBy("topic_id", "kind", "key").agg(F.min("ord").alias("ord"))


def attach_verdicts(posts: DataFrame, verdict: DataFrame) -> DataFrame:
    """Join the verdicts to the post rows.  The post rows are shuffled once,
    by (topic, page) — fine-grained, so a hot topic spreads out — and
    rendering, which groups by (topic, page), reuses that partitioning."""
    page_part = ["topic_id", "page_no"]
    on = [*page_part, "pos", *[c for c in ("src",) if c in posts.columns and c in verdict.columns]]
    return posts.repartition(*page_part).join(verdict.repartition(*page_part), on)


def select_story_posts(posts: DataFrame, topics: DataFrame, cfg: CurationConfig) -> DataFrame:
    """Every post with ``is_author``, ``reject_reason`` (null =
    kept), ``kept`` and ``is_image`` (content scope, false in all-posts
    mode)."""
    return attach_verdicts(posts, selection_verdicts(posts, topics, cfg))


def running_kept(verdict: DataFrame) -> DataFrame:
    """For each kept post, the number of posts kept before it in its
    topic (the counter the original's identifier rule reads).  Built with the
    hierarchical rank, so a hot topic is not one task."""
    from .ordering import rank_in_topic
    # the rank reads its input three times: give it a small written table
    k = materialize(verdict.filter("kept").select("topic_id", "page_no", "pos"), "kept-keys")
    return rank_in_topic(k, out="kept_before")


def story_posts(selected: DataFrame) -> DataFrame:
    """Only the kept posts."""
    return selected.filter("kept")


def topic_counters(selected: DataFrame, cfg: CurationConfig) -> DataFrame:
    """A3 (+P10 breakdown): per topic posts kept, duplicates and rejections
    by rule.  Duplicates are not reported in all-posts mode (null)."""
    r = F.col("reject_reason")
    dups = F.count_if(r == REASON_DUP).cast("long")
    return selected.groupBy("topic_id").agg(
        F.count_if(F.col("kept")).cast("long").alias("posts_kept"),
        (F.lit(None).cast("long") if cfg.all_posts else dups).alias("duplicates"),
        F.count_if(r == REASON_AUTHOR).cast("long").alias("rejected_author"),
        F.count_if(r == REASON_QUOTE).cast("long").alias("rejected_quote"),
        F.count_if(r == REASON_SHORT).cast("long").alias("rejected_short"),
    )
