"""Image assets of story posts.

Fetching is not done here: the asset cache and the archive snapshots are
input tables (``asset_manifest(file_name, url, status, final_url)``,
``snapshots(url, archive_url, snapshot_ts, status)``,
``image_targets(page_url, full_src)``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FULLSIZE_MARKER, SITE_A, SITE_B, ARCHIVE_HOST, CurationConfig
from ..functions.urls import asset_local_path, asset_name, clean_asset_url
from .skew import HOT_ROWS, lookup


def asset_refs(posts: DataFrame, images: str = "images", key: list[str] | None = None) -> DataFrame:
    """Explode the image sources of each post with their index."""
    key = key or ["topic_id", "page_no", "pos"]
    e = posts.select(*key, F.posexplode_outer(images).alias("img_idx", "src")).filter(F.col("src").isNotNull())
    return e.withColumn("url", clean_asset_url("src")).withColumn("file_name", asset_name("url"))


def inventory(refs: DataFrame) -> DataFrame:
    """Each asset name once, with the first URL and its use count.
    Partially aggregated, so a very common image costs one row per task."""
    return refs.groupBy("file_name").agg(
        F.min("url").alias("url"), F.count(F.lit(1)).alias("n_refs"))


def missing_assets(inv: DataFrame, manifest: DataFrame) -> DataFrame:
    """Assets not in the cache (anti join on the file name)."""
    return inv.join(manifest.select("file_name").distinct(), "file_name", "left_anti")


def oldest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The oldest snapshot of each URL (ties broken by archive URL); it
    is usable only when its status is 200."""
    o = snapshots.groupBy("url").agg(
        F.min(F.struct("snapshot_ts", "archive_url", "status")).alias("s"))
    return o.select("url", F.col("s.snapshot_ts").alias("snapshot_ts"),
                    F.col("s.archive_url").alias("archive_url"), F.col("s.status").alias("status"),
                    (F.col("s.status") == 200).alias("accepted"))


def resolve_missing(missing: DataFrame, fetch_status: DataFrame, snapshots: DataFrame) -> DataFrame:
    """J3 + J4: a fetched asset is stored unless it answered 404; a 404 falls
    back to the oldest archived copy when that copy answered 200.
    ``fetch_status(url, status, final_url, fetch_error)``.
    Returns ``url, file_name, source_url`` for the assets to store (S12: the
    stored name is the last segment of the final URL)."""
    f = missing.join(fetch_status, "url", "left").filter(F.col("fetch_error").isNull())
    snap = oldest_snapshot(snapshots).filter("accepted").select(
        F.col("url"), F.col("archive_url"))
    f = f.join(snap, "url", "left")
    ok = F.col("status") != 404
    src = F.when(ok, F.coalesce(F.col("final_url"), F.col("url"))).otherwise(F.col("archive_url"))
    return f.filter(ok | F.col("archive_url").isNotNull()).select(
        "url", asset_name(src).alias("file_name"), src.alias("source_url"))


def rewrite_sources(images, cfg: CurationConfig):
    """Every image source points to the local asset folder."""
    return F.transform(images, lambda i: i.withField(
        "src", asset_local_path(cfg.asset_folder, asset_name(clean_asset_url(i["src"])))))


def html_attr(v):
    """Attribute value as the parser serialises it (``html.escape``)."""
    v = F.replace(v, F.lit("&"), F.lit("&amp;"))
    for ch, ent in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        v = F.replace(v, F.lit(ch), F.lit(ent))
    return v


def _attr(name, value):
    return F.concat(F.lit(f' {name}="'), html_attr(value), F.lit('"'))


EDIT = "struct<i:int,old_tag:string,img:struct<src:string,alt:string,width:string,height:string,hosted:boolean,tag:string>>"


def apply_image_edits(posts: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply ``edits(topic_id, page_no, pos, i, old_tag, img)`` (image ``i``
    of the post becomes ``img``) to ``content_html`` (a JVM-side fold of
    string replaces) and to the ``images`` array.  A post's images are a
    bounded group."""
    key = ["topic_id", "page_no", "pos"]
    g = edits.groupBy(*key).agg(F.collect_list(F.struct("i", "old_tag", "img")).alias("_e"))
    out = posts.join(g, key, "left")
    e = F.coalesce(F.col("_e"), F.array().cast(f"array<{EDIT}>"))
    html = F.aggregate(e, F.col("content_html"), lambda acc, x: F.replace(acc, x["old_tag"], x["img"]["tag"]))
    imgs = F.transform("images", lambda im, idx: F.coalesce(
        F.get(F.transform(F.filter(e, lambda x: x["i"] == idx), lambda x: x["img"]), 0), im))
    return out.withColumn("content_html", html).withColumn("images", imgs).drop("_e")


def _image(src, alt, width, height, hosted, tag):
    return F.struct(src.alias("src"), alt.alias("alt"), width.alias("width"), height.alias("height"),
                    hosted.alias("hosted"), tag.alias("tag"))


def fullsize_edits(posts: DataFrame, targets: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """U16 + J5: hosted images of image posts at full size.  Width/height
    are dropped (a missing width stops before the height: an emoticon); site
    A takes ``alt`` as source when it names a stored file, else the
    full-size source looked up on the image page (left join on ``alt``),
    else keeps its own; site B takes ``alt``; the archive only drops the
    size.  Without ``targets`` nothing is looked up, the rest holds."""
    key = ["topic_id", "page_no", "pos"]
    e = posts.filter("is_image").select(*key, "domain", F.posexplode("images").alias("i", "img")) \
        .filter(F.col("img.hosted"))
    # one full-size source per image page (deterministic: a found source wins);
    # images of one emoticon, in every post, have one and the same ``alt``
    if targets is None:
        e = e.withColumn("full_src", F.lit(None).cast("string"))
    else:
        look = targets.groupBy(F.col("page_url").alias("_alt")).agg(F.max("full_src").alias("full_src"))
        e = lookup(e.withColumn("_alt", F.col("img.alt")), look, "_alt", hot_rows).drop("_alt")
    alt, src = F.col("img.alt"), F.col("img.src")
    src_a = F.when(alt.contains(FULLSIZE_MARKER), alt).otherwise(F.coalesce(F.col("full_src"), src))
    new_src = F.when(F.col("domain") == SITE_A, src_a).when(F.col("domain") == SITE_B, alt).otherwise(src)
    has_w = F.col("img.width").isNotNull()
    t = F.col("img.tag")
    t = F.when(has_w, F.replace(t, _attr("width", F.col("img.width")), F.lit(""))).otherwise(t)
    t = F.when(has_w & F.col("img.height").isNotNull(),
               F.replace(t, _attr("height", F.col("img.height")), F.lit(""))).otherwise(t)
    t = F.when(src.isNotNull() & new_src.isNotNull(),
               F.replace(t, _attr("src", src), _attr("src", new_src))).otherwise(t)
    height = F.when(has_w, F.lit(None).cast("string")).otherwise(F.col("img.height"))
    img = _image(new_src, alt, F.lit(None).cast("string"), height, F.col("img.hosted"), t)
    return e.select(*key, F.col("i").cast("int").alias("i"), F.col("img.tag").alias("old_tag"), img.alias("img"))


def localize_edits(posts: DataFrame, stored: DataFrame, cfg: CurationConfig) -> DataFrame:
    """U15 + P12: images whose asset is cached or was stored now point to
    the local asset folder; the others keep their source (fetch failed).
    ``stored(url, file_name)``."""
    key = ["topic_id", "page_no", "pos"]
    e = posts.select(*key, F.posexplode("images").alias("i", "img")).filter(F.col("img.src").isNotNull())
    e = e.withColumn("url", clean_asset_url(F.col("img.src")))
    e = e.join(stored.groupBy("url").agg(F.min("file_name").alias("stored_name")), "url")
    local = asset_local_path(cfg.asset_folder, F.col("stored_name"))
    t = F.replace(F.col("img.tag"), _attr("src", F.col("img.src")), _attr("src", local))
    img = _image(local, F.col("img.alt"), F.col("img.width"), F.col("img.height"), F.col("img.hosted"), t)
    return e.select(*key, F.col("i").cast("int").alias("i"), F.col("img.tag").alias("old_tag"), img.alias("img"))


def image_refs(posts: DataFrame) -> DataFrame:
    """Image sources of story posts as asset references."""
    e = posts.select("topic_id", "page_no", "pos", F.explode("images").alias("img")) \
        .filter(F.col("img.src").isNotNull())
    return e.withColumn("url", clean_asset_url(F.col("img.src"))).withColumn("file_name", asset_name("url"))


__all__ = ["asset_refs", "inventory", "missing_assets", "oldest_snapshot", "resolve_missing",
           "rewrite_sources", "fullsize_edits", "localize_edits", "apply_image_edits", "image_refs",
           "ARCHIVE_HOST"]
