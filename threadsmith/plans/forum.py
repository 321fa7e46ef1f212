"""The crawled test pages in the layouts of the supported sites.

``pages`` rows become topic pages: the title, host and paragraphs of a page are
put, as they are, into the markup that a site's selectors look for, and the
page's number decides which variant of the markup it gets (a deleted account, a
missing node, a pager with or without arrow, the archive's fallbacks).  Only
strings are put together here; what the parse makes of them is the library's
work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ARCHIVE_HOST, DELETED_AUTHOR, SITE_A, SITE_B
from ..functions.urls import domain as host_of

PARAGRAPH = r"<p>([^<]+)"          # a paragraph's own text, as written
TITLE = r"(?s)<article><h1>(.*?)</h1>"
PAGE_TITLE = r"(?s)<title[^>]*>(.*?)</title>"
TOPIC_PAGES = 4                    # pages of a topic
LANDINGS = 4                       # files in which a crawl lands


def paragraphs(html: str = "html") -> Column:
    return F.regexp_extract_all(F.col(html), F.lit(PARAGRAPH), 1)


def _tag(open_tag: str, *body, close: str | None = None) -> Column:
    return F.concat(F.lit(open_tag), *[F.lit(b) if isinstance(b, str) else b for b in body],
                    F.lit(close or f"</{open_tag[1:].split('>')[0].split(' ')[0]}>"))


def _one_of(cases: list[tuple[Column, Column]], other: Column) -> Column:
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(other)


def variant_pages(pages: DataFrame) -> DataFrame:
    """``topic_id, page_no, domain, link, html``: one first page per row, by
    turns on site A, site B and the archive, in all variants of the header and
    content rules."""
    k = F.col("page_id")
    n = k.cast("string")
    site = F.pmod(k, F.lit(3))
    p = pages.withColumn("ps", paragraphs()).withColumn("host", host_of("url"))
    title = F.regexp_extract("html", TITLE, 1)
    every = lambda m, r=0: F.pmod(k, F.lit(m)) == r
    total = (F.pmod(k, F.lit(9)) + 1).cast("string")
    first = F.coalesce(F.get("ps", F.lit(0)), F.lit("none"))
    second = F.coalesce(F.get("ps", F.lit(1)), F.lit("none"))

    # site A
    gone = _tag('<div class="bloc-pseudo-msg">', F.when(every(5), F.lit(DELETED_AUTHOR)).otherwise(F.col("host")))
    head_a = F.concat(
        F.when(every(7), F.lit("")).otherwise(_tag('<div id="bloc-title-forum">', title)),
        _tag('<div class="bloc-liste-num-page">', "<span>1</span>", _tag("<span>", F.when(every(13), F.lit("x")).otherwise(total)),
             F.when(every(2), F.lit("<span>»</span>")).otherwise(F.lit(""))),
        _tag('<div class="bloc-header">', _tag("<span> ", F.col("host"), " ", close="</span>")),
        F.when(every(11), F.lit("")).otherwise(gone))
    post_a = lambda who, text: _tag(
        '<div class="conteneur-message">',
        F.when(every(8), _tag('<div class="bloc-pseudo-msg"> ', who)).otherwise(
            _tag('<div class="bloc-header">', _tag("<span> ", who))),
        _tag('<div class="txt-msg text-enrichi-forum">', F.when(every(6), F.lit("<blockquote>cite</blockquote>"))
             .otherwise(F.lit("")), _tag("<p>", text)))
    # site B
    head_b = F.concat(
        _tag('<span class="h2 text-white d-inline align-middle mb-0 mr-2">', title),
        F.when(every(5), F.lit("")).otherwise(
            _tag('<div class="h4 text-truncate min-width-0 mb-0 text-primary">', _tag("<a>", F.col("host")))),
        F.lit('<ul><li class="page-item">1</li>'),
        _tag('<li class="page-item">', total), F.lit('<li class="page-item">»</li></ul>'))
    post_b = lambda who, text: _tag(
        '<div class="card-body pb-0 px-3 px-md-4 pt-3">',
        F.when(every(8), _tag('<div class="h4 text-truncate min-width-0 mb-0">', who)).otherwise(
            _tag('<div class="h4 text-truncate min-width-0 mb-0 text-primary">', _tag("<a>", who))),
        _tag('<div class="conteneur-message">', F.when(every(4), F.lit('<a href="i">'))
             .otherwise(F.lit("<p>")), text, F.when(every(4), F.lit("</a>")).otherwise(F.lit("</p>"))))
    # the archive: content in the named div, in any div, after the last title, or loose
    style = F.pmod(F.floor(k / 3), F.lit(4))
    frame = F.concat(F.lit('<span class="embed-youtube"><iframe src="https://web.archive.org/web/1/https://www.youtube.com/embed/v'),
                     n, F.lit('?rel=0"></iframe></span>'))
    writer = F.when(every(5), F.lit("")).otherwise(F.col("host"))
    head_w = F.when(every(4), F.lit("")).otherwise(
        _tag('<div class="page-links">', "<a>1</a>", _tag("<a>", total)))
    post_w = lambda who, text: _tag('<div class="entry-content">', _one_of([
        (style == 0, F.concat(_tag("<h2>", title), _tag("<p>", _tag("<a>", who)),
                              _tag('<div class="txt-msg text-enrichi-forum">', _tag("<p>", text), frame))),
        (style == 1, F.concat(_tag("<h2>", title), _tag("<p>", _tag("<a>", who)),
                              _tag("<div>", _tag("<p>", text)))),
        (style == 2, F.concat(F.lit("<p>early</p>"), _tag("<h2>", title), _tag("<p>", _tag("<a>", who)),
                              _tag("<p>", text)))],
        F.concat(_tag("<h2>", title), F.lit("<div>no paragraph</div>"))))
    both = lambda post: F.concat(post(F.col("host"), first), post(F.lit("other"), second))
    body = _one_of([(site == 0, F.concat(head_a, both(post_a))), (site == 1, F.concat(head_b, both(post_b)))],
                   F.concat(head_w, post_w(writer, first), post_w(F.lit("other"), second)))
    page_title = _tag("<title>", F.regexp_extract("html", PAGE_TITLE, 1))
    return p.select(
        n.alias("topic_id"), F.lit(1).alias("page_no"),
        _one_of([(site == 0, F.lit(SITE_A)), (site == 1, F.lit(SITE_B))], F.lit(ARCHIVE_HOST)).alias("domain"),
        F.concat(F.lit("https://forum/42-51-"), n, F.lit("-1-0-1-0-t.htm")).alias("link"),
        F.concat(F.lit("<html><head>"), page_title, F.lit("</head><body>"), body, F.lit("</body></html>")).alias("html"))


def topic_pages(pages: DataFrame) -> DataFrame:
    """``topic_id, link, page_no, html``: four crawled pages in a row are the
    pages of one topic of site A; a paragraph is a post, every third by someone
    else."""
    k = F.col("page_id")
    topic = F.floor(k / TOPIC_PAGES).cast("long")
    page_no = (F.pmod(k, F.lit(TOPIC_PAGES)) + 1).cast("int")
    who = F.concat(F.lit("writer"), topic.cast("string"))
    post = lambda text, j: _tag(
        '<div class="conteneur-message">',
        _tag('<div class="bloc-header">', _tag("<span> ", F.when(j % 3 == 2, F.lit("guest")).otherwise(who))),
        _tag('<div class="txt-msg text-enrichi-forum">', _tag("<p>", text)))
    head = F.concat(_tag('<div id="bloc-title-forum">', F.regexp_extract("html", TITLE, 1)),
                    F.lit(f'<div class="bloc-liste-num-page"><span>1</span><span>{TOPIC_PAGES}</span></div>'),
                    _tag('<div class="bloc-header">', _tag("<span>", who)), _tag('<div class="bloc-pseudo-msg">', who))
    posts = F.array_join(F.transform(paragraphs(), post), "")
    return pages.select(
        topic.cast("string").alias("topic_id"),
        F.concat(F.lit("https://www.jeuxvideo.com/forums/42-51-"), topic.cast("string"), F.lit("-"),
                 page_no.cast("string"), F.lit("-0-1-0-t.htm")).alias("link"),
        page_no.alias("page_no"), F.concat(F.lit("<html><body>"), head, posts, F.lit("</body></html>")).alias("html"),
        k.alias("page_id"))
