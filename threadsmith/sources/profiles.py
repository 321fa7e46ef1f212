"""Site profiles (X2): CSS selectors per supported site, as a small table.

The table has a fixed handful of rows, so joining it with ``broadcast`` is
bounded whatever the data size.  Callers may add rows for other sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: selectors of the supported sites -------------------------
# (domain, field, rank, selector); rank orders alternatives of one field;
# content_all: all nodes together, where content is one node.
PROFILE_ROWS = [
    ("jeuxvideo.com", "author", 0, ".bloc-header > span"),
    ("jeuxvideo.com", "deleted_author", 0, ".bloc-pseudo-msg"),
    ("jeuxvideo.com", "total", 0, ".bloc-liste-num-page > span:nth-last-of-type(1)"),
    ("jeuxvideo.com", "total", 1, ".bloc-liste-num-page > span:nth-last-of-type(2)"),
    ("jeuxvideo.com", "post", 0, ".conteneur-message"),
    ("jeuxvideo.com", "content", 0, "[class='txt-msg text-enrichi-forum']"),
    ("jeuxvideo.com", "title", 0, "#bloc-title-forum"),
    ("jeuxvideo.com", "hosted_image", 0, "img.img-shack"),
    ("jeuxvideo.com", "page_title", 0, "title"),
    ("jvarchive.com", "author", 0, "[class='h4 text-truncate min-width-0 mb-0 text-primary'] > a"),
    ("jvarchive.com", "deleted_author", 0, "[class='h4 text-truncate min-width-0 mb-0']"),
    ("jvarchive.com", "total", 0, ".page-item:nth-last-child(2)"),
    ("jvarchive.com", "post", 0, "[class='card-body pb-0 px-3 px-md-4 pt-3']"),
    ("jvarchive.com", "content", 0, ".conteneur-message"),
    ("jvarchive.com", "title", 0, "[class='h2 text-white d-inline align-middle mb-0 mr-2']"),
    ("jvarchive.com", "hosted_image", 0, "img"),
    ("jvarchive.com", "page_title", 0, "title"),
    ("web.archive.org", "author", 0, "h2 + p > a"),
    ("web.archive.org", "total", 0, ".page-links > a:last-child"),
    ("web.archive.org", "post", 0, ".entry-content"),
    ("web.archive.org", "content", 0, ".entry-content > div.txt-msg.text-enrichi-forum"),
    ("web.archive.org", "content", 1, ".entry-content > div"),
    ("web.archive.org", "content_all", 0, ".entry-content >  h2:last-of-type ~ p"),
    ("web.archive.org", "content_all", 1, ".entry-content >  p"),
    ("web.archive.org", "title", 0, ".entry-content > h2"),
    ("web.archive.org", "hosted_image", 0, ".entry-content > div > p > a > img"),
    ("web.archive.org", "page_title", 0, "title"),
]
IMAGE_PAGE_SELECTOR = "#elt_to_aff"   # full-size image on an image-host page
# -----------------------------------------------------------------------------

PROFILE_SCHEMA = "domain string, field string, rank int, selector string"


def profile_dict(rows=None) -> dict[str, dict[str, list[str]]]:
    """{domain: {field: [selectors by rank]}} (small; shipped to tasks)."""
    out: dict[str, dict[str, list[str]]] = {}
    for d, f, r, s in sorted(rows or PROFILE_ROWS, key=lambda x: (x[0], x[1], x[2])):
        out.setdefault(d, {}).setdefault(f, []).append(s)
    return out


def site_profiles(spark: SparkSession, extra_rows=None) -> DataFrame:
    return spark.createDataFrame(PROFILE_ROWS + list(extra_rows or []), PROFILE_SCHEMA)
