"""Crawled pages -> topic headers and posts.

One Arrow-batched Python pass per page only finds things: ``candidates`` gives,
for each page and post, the texts that the site's selectors match (field, rank,
text) and the content nodes with their features.  Which candidate counts (the
author of a deleted account, the pager's fallback, the title, the content of an
archived post) is decided by expressions over these in ``resolve``.

Filters on ``pages`` (status, pages already read) must be applied *before* the
parse: Catalyst does not push filters through a Python map.  Rows that the
original tool would crash on become quarantine rows instead of failing the job.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, LongType, StringType, StructField,
                               StructType)

from ..config import ARCHIVE_HOST, DELETED_AUTHOR, SITE_A, UNKNOWN_AUTHOR
from ..functions import html as H
from ..functions.text import ws_trim
from ..functions.urls import domain as domain_of
from ..sources.profiles import profile_dict

IMAGE = StructType([StructField("src", StringType()), StructField("alt", StringType()),
                    StructField("width", StringType()), StructField("height", StringType()),
                    StructField("hosted", BooleanType()), StructField("tag", StringType())])
FRAME = StructType([StructField("span_html", StringType()), StructField("src", StringType())])
# What a selector found: the text of the first match, null without one.
FIELD = StructType([StructField("field", StringType()), StructField("rank", IntegerType()),
                    StructField("text", StringType())])
# A content node of a post (content_all: nodes that count together).
CONTENT = StructType([
    StructField("field", StringType()), StructField("rank", IntegerType()), StructField("html", StringType()),
    StructField("text", StringType()), StructField("paragraphs", ArrayType(StringType())),
    StructField("n_hosted", IntegerType()), StructField("n_links", IntegerType()),
    StructField("has_blockquote", BooleanType()), StructField("images", ArrayType(IMAGE)),
    StructField("frames", ArrayType(FRAME))])
_PLACE = [
    StructField("kind", StringType()),          # page | post | quarantine
    StructField("topic_id", StringType()),
    StructField("page_no", IntegerType()),
    StructField("pos", IntegerType()),
    StructField("src", LongType()),             # the fetched page it comes from
    StructField("attempt", LongType()),
    StructField("n_posts", IntegerType()),      # of a page
    StructField("domain", StringType()),
    StructField("link", StringType()),
    StructField("topic_key", StringType()),
]
_POST_SCOPE = [
    StructField("post_text", StringType()),
    StructField("post_paragraphs", ArrayType(StringType())),
    StructField("n_hosted", IntegerType()),
    StructField("n_post_links", IntegerType()),
    StructField("post_has_blockquote", BooleanType()),
]
CANDIDATES = StructType([*_PLACE, StructField("fields", ArrayType(FIELD)), *_POST_SCOPE,
                         StructField("contents", ArrayType(CONTENT)), StructField("reason", StringType())])
_FOUND_POST = StructType([StructField("pos", IntegerType()), StructField("fields", ArrayType(FIELD)), *_POST_SCOPE,
                          StructField("contents", ArrayType(CONTENT))])
NESTED = StructType([*[f for f in _PLACE if f.name != "pos"], StructField("fields", ArrayType(FIELD)),
                     StructField("posts", ArrayType(_FOUND_POST)), StructField("reason", StringType())])
HEADER_FIELDS = ("author", "deleted_author", "total", "title", "page_title")
POST_COLS = ["topic_id", "page_no", "pos", "src", "domain", "post_author", "post_text", "content_text", "content_html",
             "post_paragraphs", "paragraphs", "n_hosted", "content_n_hosted", "n_post_links", "n_links",
             "post_has_blockquote", "content_has_blockquote", "images", "frames"]
# Parsed posts of pages that wait for another page.
WAITING_COLS = [c for c in POST_COLS if c != "src"]
WAITING_SCHEMA = StructType([
    *[f for f in _PLACE if f.name in ("topic_id", "page_no", "pos", "domain")],
    *[StructField(c, StringType()) for c in ("post_author", "post_text", "content_text", "content_html")],
    *[f for f in _POST_SCOPE if f.name != "post_text"],
    StructField("paragraphs", ArrayType(StringType())), StructField("content_n_hosted", IntegerType()),
    StructField("n_links", IntegerType()), StructField("content_has_blockquote", BooleanType()),
    StructField("images", ArrayType(IMAGE)), StructField("frames", ArrayType(FRAME))])
BATCH_BYTES = 2 << 20       # found rows that are held before they are given out (about, see ``_weight``)
PAGE_ROWS = 100             # pages that come to a Python worker at once
ARCHIVE_WRAPPER = '<div class="txt-msg text-enrichi-forum">'

# Profile of the driver's generic test pages (article with paragraphs).
TEST_LAYOUT_ROWS = [
    ("*", "post", 0, "article > p"),
    ("*", "author", 0, "article > p > b"),
    ("*", "title", 0, "article > h1"),
    ("*", "page_title", 0, "title"),
    ("*", "hosted_image", 0, "img"),
]


PARSED = ("ok", "gone")     # outcomes that have a page to parse


def page_outcome(domain_col, status_col):
    """S3: fetch outcome of a crawled page: ``failed`` (no status, retries
    exhausted), ``not_archived`` (archive 404), ``gone`` (410, still
    parsed), else ``ok``.  Only ok/gone pages are parsed."""
    d, s = F.col(domain_col), F.col(status_col)
    return (F.when(s.isNull(), "failed")
            .when((d == ARCHIVE_HOST) & (s == 404), "not_archived")
            .when(s == 410, "gone").otherwise("ok"))


def page_status(pages: DataFrame) -> DataFrame:
    """S3 over repeated fetches: ``topic_id, page_no, n_attempts, outcome,
    attempt`` of each page.  The newest attempt that can be parsed (ok or gone)
    counts; without one, the newest attempt tells what went wrong.  Attempts
    (``topic_id, page_no, domain, status, attempt``) with one number are ordered
    by their outcome.  Partially aggregated, so a page fetched very often costs
    one row per task."""
    p = pages.withColumn("_o", page_outcome("domain", "status"))
    pick = F.struct("attempt", "_o")
    g = p.groupBy("topic_id", "page_no").agg(
        F.count(F.lit(1)).alias("n_attempts"), F.max(pick).alias("_any"),
        F.max(F.when(F.col("_o").isin(*PARSED), pick)).alias("_good"))
    best = F.coalesce("_good", "_any")
    return g.select("topic_id", "page_no", "n_attempts", best["_o"].alias("outcome"), best["attempt"].alias("attempt"))


# --- candidates: what the selectors find (Python) ------------------------------
class _Bundle(H.Node):
    """Nodes that count together as one content."""

    def __init__(self, nodes):
        super().__init__("div")
        self.children = list(nodes)


def _fields(root, prof, names):
    out = []
    for name in names:
        for rank, sel in enumerate(prof.get(name) or []):
            n = H.select_one(root, sel)
            out.append(dict(field=name, rank=rank, text=None if n is None else n.text()))
    return out


def _scope_features(node, hosted_sel):
    """Paragraph texts, blockquote flag, hosted-image count, link count and
    the hosted image nodes of one scope, in a single walk of the subtree."""
    steps = H.compile_selector(hosted_sel) if hosted_sel else None
    paras, hosted, quote, links, memo = [], [], False, 0, {}
    for n in node.iter():
        t = n.tag
        if t == "p":
            paras.append(n.text())
        elif t == "blockquote":
            quote = True
        elif t == "a":
            links += 1
        if steps is not None and H.matches(n, steps, memo):
            hosted.append(n)
    return paras, quote, len(hosted), links, hosted


def _content(field, rank, node, html, hosted_sel):
    paras, quote, n_hosted, links, hosted = _scope_features(node, hosted_sel)
    ids = {id(h) for h in hosted}
    imgs = [dict(src=i.attrs.get("src"), alt=i.attrs.get("alt"), width=i.attrs.get("width"),
                 height=i.attrs.get("height"), hosted=id(i) in ids, tag=i.html()) for i in H.select(node, "img")]
    frames = [dict(span_html=sp.html(), src=fr.attrs.get("src"))
              for fr, sp in zip(H.select(node, ".embed-youtube > iframe"), H.select(node, ".embed-youtube"))]
    return dict(field=field, rank=rank, html=html, text=node.text(), paragraphs=paras, n_hosted=n_hosted,
                n_links=links, has_blockquote=quote, images=imgs, frames=frames)


def _contents(post, prof):
    """The content nodes of a post, in the order of the profile."""
    hosted = (prof.get("hosted_image") or [None])[0]
    sels = prof.get("content")
    if not sels:
        return [_content("content", 0, post, post.html(), hosted)]
    out = []
    for rank, sel in enumerate(sels):
        n = H.select_one(post, sel)
        if n is not None:
            out.append(_content("content", rank, n, n.html(), hosted))
    for rank, sel in enumerate(prof.get("content_all") or []):
        nodes = H.select(post, sel)
        if nodes:
            out.append(_content("content_all", rank, _Bundle(nodes), "".join(n.html() for n in nodes), hosted))
    return out


def _found_on_page(row, profiles):
    dom = row["domain"] or ""
    base = {k: row[k] for k in ("topic_id", "page_no", "src", "attempt")} | {"domain": dom}
    prof = profiles.get(dom) or profiles.get("*")
    if prof is None:
        yield dict(base, kind="quarantine", reason="unsupported_domain")
        return
    root = H.parse(row["html"])
    try:
        posts = H.select(root, prof["post"][0])
        first = row["page_no"] == 1
        yield dict(base, kind="page", link=row["link"], topic_key=row["topic_key"], n_posts=len(posts),
                   fields=_fields(root, prof, HEADER_FIELDS) if first else None)
        hosted = (prof.get("hosted_image") or [None])[0]
        for pos, post in enumerate(posts):
            paras, quote, n_hosted, links, _ = _scope_features(post, hosted)
            yield dict(base, kind="post", pos=pos, fields=_fields(post, prof, ("author", "deleted_author")),
                       post_text=post.text(), post_paragraphs=paras, n_hosted=n_hosted, n_post_links=links,
                       post_has_blockquote=quote, contents=_contents(post, prof))
    finally:
        H.unlink(root)


def _weight(v) -> int:
    """Bytes, about, that a found row holds in Python: a fixed part of every
    object and the characters of every text."""
    if isinstance(v, str):
        return 60 + len(v)
    if isinstance(v, dict):
        return 300 + sum(map(_weight, v.values()))
    if isinstance(v, list):
        return 60 + sum(map(_weight, v))
    return 8


def candidates(pages: DataFrame, profile_rows=None, spread: bool = False, nested: bool = False) -> DataFrame:
    """``pages(topic_id, page_no, html[, domain | link, attempt])`` ->
    CANDIDATES rows: one of each page, one of each post; ``nested``: NESTED
    rows, one of each page with its posts.

    One Python pass per page; the profile dictionary (a few dozen strings) is
    shipped with the function.  The pages are parsed where they are scanned;
    ``spread`` first deals them round-robin over ``defaultParallelism``
    partitions (a shuffle of the raw pages, for an input in one small file).
    Pages come to a worker ``PAGE_ROWS`` at a time and found rows are given out
    by their size, so a worker holds the same however many pages a task has."""
    profiles = profile_dict(profile_rows)
    conf, rows_key = pages.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows_key)) <= PAGE_ROWS:
        conf.set(rows_key, str(PAGE_ROWS))
    cols = pages.columns
    dom = F.col("domain") if "domain" in cols else domain_of(F.col("link") if "link" in cols else F.col("url"))
    given = lambda c, t: F.col(c).cast(t) if c in cols else F.lit(None).cast(t)
    src = pages.select(F.col("topic_id").cast("string").alias("topic_id"),
                       F.col("page_no").cast("int").alias("page_no"), dom.alias("domain"),
                       given("link", "string").alias("link"), given("topic_key", "string").alias("topic_key"),
                       given("attempt", "long").alias("attempt"), "html")
    if spread:
        src = src.repartition(pages.sparkSession.sparkContext.defaultParallelism)
    # the row's own number: two fetches of one page, alike or not, are two
    src = src.withColumn("src", F.lit(0).cast("long") if pages.isStreaming else F.monotonically_increasing_id())
    schema = NESTED if nested else CANDIDATES
    arrow_schema = to_arrow_schema(schema)
    names = [f.name for f in schema.fields]

    def run(batches):
        out, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                row = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}
                try:
                    rows = list(_found_on_page(row, profiles))
                except Exception as e:  # noqa: BLE001 - one bad page must not fail the job
                    rows = [dict(topic_id=row["topic_id"], page_no=row["page_no"], domain=row["domain"],
                                 src=row["src"], kind="quarantine", reason=f"parse_error: {type(e).__name__}")]
                if nested:
                    rows = [rows[0] | {"posts": rows[1:]}]
                for r in rows:
                    out.append({k: r.get(k) for k in names})
                    size += _weight(r)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)

    return src.mapInArrow(run, schema)


# --- rules over the candidates (expressions) ------------------------------------
# ``fields`` and ``contents`` are the candidate arrays, ``domain`` the site.
def found_text(fields: Column, field: str, rank: int | None = None) -> Column:
    """Text of the first candidate of a field that matched anything, by rank."""
    mine = F.filter(fields, lambda f: (f["field"] == field) & f["text"].isNotNull()
                    & (F.lit(True) if rank is None else f["rank"] == rank))
    return F.get(mine, F.lit(0))["text"]


def has_selector(fields: Column, field: str, rank: int = 0) -> Column:
    """Does the site's profile look for this field at all?"""
    return F.exists(fields, lambda f: (f["field"] == field) & (f["rank"] == rank))


def header_author(fields: Column, domain: Column) -> Column:
    """Site A marks deleted accounts in a node of their own; without an
    author node the author is unknown, and an empty one on the archive is a
    deleted account."""
    named = F.coalesce(ws_trim(found_text(fields, "author")), F.lit(UNKNOWN_AUTHOR))
    gone = (domain == SITE_A) & (ws_trim(found_text(fields, "deleted_author")) == DELETED_AUTHOR)
    return F.when(F.coalesce(gone, F.lit(False)) | ((domain == ARCHIVE_HOST) & (named == "")), F.lit(DELETED_AUTHOR)) \
        .otherwise(named)


def pager_text(fields: Column, domain: Column) -> Column:
    """The pager's symbol; on site A a final arrow stands after the last
    number, which the second selector finds."""
    first = found_text(fields, "total", 0)
    arrow = (domain == SITE_A) & (first == "»") & has_selector(fields, "total", 1)
    return F.when(F.coalesce(arrow, F.lit(False)), found_text(fields, "total", 1)).otherwise(first)


def header_total(fields: Column, domain: Column) -> Column:
    """The number of pages; 1 where the archive shows no pager or the
    profile has none; null for a pager that is no number of 31 bits."""
    sym = pager_text(fields, domain)
    single = F.coalesce(sym == "", F.lit(True)) & ((domain == ARCHIVE_HOST) | ~has_selector(fields, "total"))
    number = F.when(ws_trim(sym).rlike(r"^\+?[0-9]{1,18}$"), ws_trim(sym).try_cast("long"))
    return F.when(single, F.lit(1)).when(number.between(0, (1 << 31) - 1), number).cast("int")


def header_title(fields: Column) -> Column:
    """The title node, else the page's title."""
    return ws_trim(F.coalesce(found_text(fields, "title"), found_text(fields, "page_title")))


def header_fault(fields: Column, domain: Column) -> Column:
    """Why a header can't be used (null: it can)."""
    return F.when((domain == SITE_A) & found_text(fields, "deleted_author").isNull(), "missing_deleted_author_node") \
        .when(header_total(fields, domain).isNull(), "bad_pager")


def post_author(fields: Column, domain: Column) -> Column:
    """The author node, else (not on the archive) the deleted account's."""
    return ws_trim(F.coalesce(found_text(fields, "author"),
                              F.when(domain != ARCHIVE_HOST, found_text(fields, "deleted_author"))))


def post_content(contents: Column, domain: Column) -> Column:
    """The content node; on the archive, where it has no paragraph,
    the next candidate that has one, else the loose paragraphs together."""
    def c(field, rank):
        return F.get(F.filter(contents, lambda x: (x["field"] == field) & (x["rank"] == rank)), F.lit(0))

    def with_paragraph(x):
        return F.when(F.size(x["paragraphs"]) > 0, x)

    return F.when(domain != ARCHIVE_HOST, c("content", 0)).otherwise(F.coalesce(
        with_paragraph(c("content", 0)), with_paragraph(c("content", 1)), c("content_all", 0), c("content_all", 1)))


def _content_columns(c: Column) -> list[Column]:
    html = F.when(c["field"] == "content_all", F.concat(F.lit(ARCHIVE_WRAPPER), c["html"], F.lit("</div>"))) \
        .otherwise(c["html"])
    return [c["text"].alias("content_text"), html.alias("content_html"), c["paragraphs"].alias("paragraphs"),
            c["n_hosted"].alias("content_n_hosted"), c["n_links"].alias("n_links"),
            c["has_blockquote"].alias("content_has_blockquote"), c["images"].alias("images"), c["frames"].alias("frames")]


def _header_columns(fields: Column, domain: Column, when: Column) -> list[Column]:
    return [F.when(when, header_author(fields, domain)).alias("topic_author"),
            F.when(when, header_total(fields, domain)).alias("total_pages"),
            F.when(when, header_title(fields)).alias("title")]


def resolve(found: DataFrame) -> DataFrame:
    """CANDIDATES -> one flat row per page (with the header if it is a first
    page) and per post, and ``reason`` where a row can't be used."""
    f, d = F.col("fields"), F.col("domain")
    post = F.col("kind") == "post"
    head = (F.col("kind") == "page") & f.isNotNull()
    r = found.withColumn("_c", F.when(post, post_content(F.col("contents"), d)))
    fault = F.coalesce("reason", F.when(head, header_fault(f, d)), F.when(post & F.col("_c").isNull(), F.lit("no_content")))
    return r.select(*[x.name for x in _PLACE], *[x.name for x in _POST_SCOPE], *_header_columns(f, d, head),
                    F.when(post, post_author(f, d)).alias("post_author"), *_content_columns(F.col("_c")),
                    fault.alias("reason"))


def page_records(pages: DataFrame, profile_rows=None) -> DataFrame:
    """The same with one row per page, its posts in an array (``posts``, in
    order, those without content with ``reason``): for a stream, where a page's
    rows must stay together."""
    r = candidates(pages, profile_rows, nested=True)
    f, d = F.col("fields"), F.col("domain")
    head = f.isNotNull()

    def post(p):
        c = post_content(p["contents"], d)
        return F.struct(p["pos"].alias("pos"), *[p[x.name].alias(x.name) for x in _POST_SCOPE],
                        post_author(p["fields"], d).alias("post_author"), *_content_columns(c),
                        F.when(c.isNull(), "no_content").alias("reason"))

    return r.select(*[x.name for x in _PLACE if x.name != "pos"], *_header_columns(f, d, head),
                    F.transform("posts", post).alias("posts"),
                    F.coalesce("reason", F.when(head, header_fault(f, d))).alias("reason"))


def extract(pages: DataFrame, profile_rows=None, spread: bool = False) -> DataFrame:
    """Parse pages and apply the rules (see ``candidates`` and ``resolve``)."""
    return resolve(candidates(pages, profile_rows, spread))


def replace_video_frames(content_html="content_html", frames="frames"):
    """X11: each embedded video frame (i-th frame with i-th embed span)
    becomes a paragraph holding a plain link to the watch page (U6 + U9),
    folded over the frames array on the JVM."""
    from ..functions.urls import strip_archive, video_watch_url

    def step(acc, f):
        url = video_watch_url(strip_archive(f["src"]))
        return F.replace(acc, f["span_html"], F.concat(F.lit('<p><a href="'), url, F.lit('">'), url, F.lit("</a></p>")))
    return F.aggregate(F.coalesce(F.col(frames), F.array().cast(f"array<{FRAME.simpleString()}>")),
                       F.col(content_html), step)


def image_targets(image_pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Crawled image-host pages -> ``(page_url, full_src)``; null when
    the page has no full-size image node."""
    from ..sources.profiles import IMAGE_PAGE_SELECTOR

    @F.pandas_udf(StringType())
    def full_src(h):
        def one(doc):
            n = H.select_one(H.parse(doc), IMAGE_PAGE_SELECTOR)
            return None if n is None else n.attrs.get("src")
        return h.map(one)

    return image_pages.select(F.col(url).alias("page_url"), full_src(html).alias("full_src"))


def page_rows(extracted: DataFrame) -> DataFrame:
    """``topic_id, page_no, src, attempt, n_posts, domain, link, topic_key`` of
    every page that was parsed."""
    return extracted.filter(F.col("kind") == "page").select(
        "topic_id", "page_no", "src", "attempt", "n_posts", "domain", "link", "topic_key")


def newest_pages(extracted: DataFrame) -> DataFrame:
    """The page rows that count: of several fetches of one page the newest
    attempt (without attempts: the one with most posts)."""
    rest = ["attempt", "n_posts", "src", "domain", "link", "topic_key"]
    return page_rows(extracted).groupBy("topic_id", "page_no").agg(F.max(F.struct(*rest)).alias("_b")) \
        .select("topic_id", "page_no", *[F.col("_b")[c].alias(c) for c in rest])


def split(extracted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics, posts, quarantine) views of one extraction result.  Write the
    result once (``materialize``) when more than one of them is used."""
    fine = F.col("reason").isNull()
    topics = extracted.filter((F.col("kind") == "page") & (F.col("page_no") == 1) & fine).select(
        "topic_id", "src", "domain", "link", "topic_key", "topic_author", "total_pages", "title")
    posts = extracted.filter((F.col("kind") == "post") & fine).select(*POST_COLS)
    quarantine = extracted.filter(~fine).select("topic_id", "page_no", "pos", "reason")
    return topics, posts, quarantine


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write the parse result once to the shared checkpoint folder (the
    parse runs once; lineage is cut)."""
    from ..session import materialize as _m
    return _m(df, name)
