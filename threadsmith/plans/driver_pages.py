"""Driver queries over crawled pages and over several runs: page outcomes,
header and content rules, image rules, page splits, the end-to-end runs and the
stored logs, each with an independent SQL statement (see ``driver``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ARCHIVE_HOST, DELETED_AUTHOR, FULLSIZE_MARKER, SITE_A, SITE_B, UNKNOWN_AUTHOR, CurationConfig
from ..operators import assets as A
from ..operators import dedup as D
from ..operators import extract as X
from ..operators import ledger as L
from ..operators import select as SEL
from ..operators import state as ST
from ..operators.keyed_log import KeyedLog
from ..session import materialize, scratch_path
from . import curate, forum
from .adapters import conversation_posts, table
from .driver import (CONV_CFG, RESUME_CFG, _conv, _hrefs, _q_order_state, _q_unescape, q_conv_selected, q_hrefs, q_trim,
                     query)


# --- fetch outcomes -------------------------------------------------------------
@query("page_status", f"""WITH a AS (
  SELECT CAST(user_id AS VARCHAR) AS topic_id, CAST(event_id % 12 + 1 AS INTEGER) AS page_no, event_id AS attempt,
    CASE WHEN user_id % 3 = 0 THEN '{ARCHIVE_HOST}' ELSE '{SITE_A}' END AS domain,
    CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN 404 WHEN 'signup' THEN 410 ELSE 200 END AS status FROM events),
o AS (SELECT *, CASE WHEN status IS NULL THEN 'failed' WHEN domain = '{ARCHIVE_HOST}' AND status = 404 THEN 'not_archived'
        WHEN status = 410 THEN 'gone' ELSE 'ok' END AS oc FROM a)
SELECT topic_id, page_no, count(*) AS n_attempts,
  coalesce(arg_max(oc, attempt) FILTER (WHERE oc IN ('ok', 'gone')), arg_max(oc, attempt)) AS outcome,
  coalesce(max(attempt) FILTER (WHERE oc IN ('ok', 'gone')), max(attempt)) AS attempt
FROM o GROUP BY topic_id, page_no""")
def page_status_q(spark, sf):
    """S3: events are attempts to fetch a page of the user's topic; error
    events failed, purchases answered 404, signups 410."""
    e = table(spark, sf, "events")
    t = F.col("event_type")
    return X.page_status(e.select(
        F.col("user_id").cast("string").alias("topic_id"), (F.col("event_id") % 12 + 1).cast("int").alias("page_no"),
        F.col("event_id").alias("attempt"), F.when(F.col("user_id") % 3 == 0, ARCHIVE_HOST).otherwise(SITE_A).alias("domain"),
        F.when(t == "error", F.lit(None).cast("int")).when(t == "purchase", 404).when(t == "signup", 410).otherwise(200)
        .alias("status")))


# --- header and content rules ----------------------------------------------------
def _variants(spark, sf) -> DataFrame:
    return X.extract(forum.variant_pages(table(spark, sf, "pages")), spread=True)


_HOST = "regexp_replace(string_split(url, '/')[3], 'www.', '', 'g')"
_H1 = "regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1)"
_PAGE_TITLE = "regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"
_Q_HEAD = f"""h AS (
  SELECT page_id AS k, {_HOST} AS host, page_id % 3 AS site, (page_id // 3) % 4 AS style,
    {q_trim(_q_unescape(_H1))} AS h1, {q_trim(_q_unescape(_PAGE_TITLE))} AS page_title FROM pages),
f AS (
  SELECT *, CASE WHEN site = 0 AND k % 11 = 0 AND k % 8 <> 0 THEN 'missing_deleted_author_node'
                 WHEN site = 0 AND k % 13 = 0 THEN 'bad_pager' END AS fault FROM h)"""


@query("topic_header", f"""WITH {_Q_HEAD}
SELECT CAST(k AS VARCHAR) AS topic_id,
  CASE site WHEN 0 THEN CASE WHEN k % 5 = 0 AND k % 11 <> 0 THEN '{DELETED_AUTHOR}' ELSE host END
            WHEN 1 THEN CASE WHEN k % 5 = 0 AND k % 8 = 0 THEN '{UNKNOWN_AUTHOR}' ELSE host END
            ELSE CASE WHEN style = 3 THEN '{UNKNOWN_AUTHOR}' WHEN k % 5 = 0 THEN '{DELETED_AUTHOR}' ELSE host END END AS topic_author,
  CASE WHEN site = 0 AND k % 7 = 0 THEN page_title ELSE h1 END AS title
FROM f WHERE fault IS NULL""")
def topic_header(spark, sf):
    """X3 + X5: author and title of every page's header, in the markup of
    three sites with deleted, unknown and empty authors and missing titles."""
    topics, _, _ = X.split(_variants(spark, sf))
    return topics.select("topic_id", "topic_author", "title")


@query("total_pages", f"""WITH {_Q_HEAD}
SELECT CAST(k AS VARCHAR) AS topic_id,
  CAST(CASE WHEN site = 0 AND k % 13 = 0 THEN NULL WHEN site = 2 AND k % 4 = 0 THEN 1 ELSE k % 9 + 1 END AS INTEGER) AS total_pages,
  fault AS reason FROM f""")
def total_pages(spark, sf):
    """X4 + X1's quarantine: the pager of every page (plain, with an arrow,
    none, or no number) and why a header can't be used."""
    e = _variants(spark, sf)
    return e.filter("kind = 'page'").select("topic_id", "total_pages", "reason")


_Q_POSTS = f"""p AS (
  SELECT page_id AS k, {_HOST} AS host, page_id % 3 AS site, (page_id // 3) % 4 AS style,
    regexp_extract_all(html, '{forum.PARAGRAPH}', 1) AS ps FROM pages),
q AS (SELECT k, host, site, style, 0 AS pos, coalesce(ps[1], 'none') AS raw FROM p
      UNION ALL SELECT k, 'other', site, style, 1, coalesce(ps[2], 'none') FROM p),
t AS (SELECT *, {_q_unescape("raw")} AS txt,
        CASE WHEN site = 2 AND pos = 0 AND k % 5 = 0 THEN '' ELSE host END AS who FROM q)"""


@query("forum_posts", f"""WITH {_Q_POSTS}
SELECT CAST(k AS VARCHAR) AS topic_id, CAST(pos AS INTEGER) AS pos, who AS post_author,
  md5(CASE WHEN site = 0 AND k % 6 = 0 THEN 'cite' || txt WHEN site = 2 AND style = 2 THEN who || txt ELSE txt END) AS text_md5,
  CAST(CASE WHEN site = 1 AND k % 4 = 0 THEN 0 WHEN site = 2 AND style = 2 THEN 2 ELSE 1 END AS INTEGER) AS n_paragraphs,
  CAST(CASE WHEN site = 1 AND k % 4 = 0 THEN 1 WHEN site = 2 AND style = 2 THEN 1 ELSE 0 END AS INTEGER) AS n_links,
  (site = 0 AND k % 6 = 0) AS has_blockquote,
  CASE WHEN site = 2 AND style = 0 THEN 'https://www.youtube.com/watch?v=v' || CAST(k AS VARCHAR) END AS video
FROM t WHERE NOT (site = 2 AND style = 3)""")
def forum_posts(spark, sf):
    """Position, author (also of deleted accounts),
    content (with the archive's fallbacks), blockquotes and video links of the
    posts of three sites."""
    _, posts, _ = X.split(_variants(spark, sf))
    link = F.regexp_extract(X.replace_video_frames(), r'<p><a href="([^"]*)">https://www.youtube', 1)
    return posts.select("topic_id", "pos", "post_author", F.md5(F.col("content_text").cast("binary")).alias("text_md5"),
                        F.size("paragraphs").alias("n_paragraphs"), "n_links",
                        F.col("content_has_blockquote").alias("has_blockquote"),
                        F.when(link != "", link).alias("video"))


# --- image rules -------------------------------------------------------------------
IMAGE_CFG = CurationConfig()


def _image_scopes(spark, sf) -> DataFrame:
    """Links stand for images.  Post scope: the head of the article (its own
    first or second paragraph text, all links of the page); content scope: the
    navigation (its entries as paragraphs, its links)."""
    p = table(spark, sf, "pages")
    k = F.col("page_id")
    nav = F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1)
    items = F.regexp_extract_all(nav, F.lit(r"<li><a [^>]*>([^<]*)"), 1)
    links = F.regexp_extract_all(nav, F.lit(r'href="([^"]*)"'), 1)
    paras = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.concat(items, F.array(F.lit(""))))\
        .otherwise(items)
    head = F.regexp_extract("html", r"(?s)<article>.*?<p>([^<]*)", 1)
    second = F.coalesce(F.get(F.regexp_extract_all("html", F.lit(forum.PARAGRAPH), 1), F.lit(1)), F.lit("x"))
    return p.select(
        k, F.when(k % 2 == 0, SITE_B).otherwise(SITE_A).alias("domain"),
        F.when(k % 4 == 0, F.array(second)).otherwise(F.array(head)).alias("post_paragraphs"),
        F.size(_hrefs()).alias("n_hosted"), (k % 7 == 0).alias("post_has_blockquote"),
        F.regexp_extract("html", forum.TITLE, 1).alias("post_text"), F.size(_hrefs()).alias("n_post_links"),
        paras.alias("paragraphs"), F.transform(links, lambda x: F.struct(
            x.alias("src"), (F.length(x) % 5 != 0).alias("hosted"))).alias("images"),
        (k % 5 == 0).alias("content_has_blockquote"), F.array_join(items, "").alias("content_text"),
        F.size(links).alias("n_links"))


def _q_image(paras, hosted, quote, text, links) -> str:
    return f"""coalesce(CASE WHEN len({paras}) = 0 THEN page_id % 2 = 0 AND {links} > 0
  ELSE {hosted} >= 3 AND NOT {quote} AND length({q_trim(text)}) < 300 AND (
    len(list_filter({paras}, lambda x: regexp_matches(x, 'screen|repost|supprime'))) > 0
    OR length({q_trim(f"{paras}[-1]")}) = 0) END, false)"""


@query("image_posts", f"""WITH s AS (
  SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav, {q_hrefs()} AS hrefs,
    regexp_extract(html, '(?s)<article>.*?<p>([^<]*)', 1) AS head, {_H1} AS h1,
    coalesce(regexp_extract_all(html, '{forum.PARAGRAPH}', 1)[2], 'x') AS second FROM pages),
i AS (SELECT *, regexp_extract_all(nav, '<li><a [^>]*>([^<]*)', 1) AS items, regexp_extract_all(nav, 'href="([^"]*)"', 1) AS links FROM s),
c AS (SELECT *, CASE WHEN page_id % 4 = 0 THEN [second] ELSE [head] END AS pp,
        CASE page_id % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN list_append(items, '') ELSE items END AS cp,
        len(list_filter(links, lambda x: length(x) % 5 <> 0)) AS n_hosted FROM i)
SELECT page_id, {_q_image('pp', 'len(hrefs)', '(page_id % 7 = 0)', 'h1', 'len(hrefs)')} AS img_post,
  {_q_image('cp', 'n_hosted', '(page_id % 5 = 0)', "array_to_string(items, '')", 'len(links)')} AS content_img,
  CAST(n_hosted AS INTEGER) AS n_hosted, page_id % 5 = 0 AS has_blockquote, len(cp) > 0 AS has_paragraph
FROM c""")
def image_posts(spark, sf):
    """P7 on both scopes of a post, with A8 (hosted images), P6 and P8."""
    s = _image_scopes(spark, sf)
    post, content = SEL.scope_verdicts(s, IMAGE_CFG)
    return s.select("page_id", F.coalesce(post, F.lit(False)).alias("img_post"),
                    F.coalesce(content, F.lit(False)).alias("content_img"), SEL.hosted_count("images").alias("n_hosted"),
                    F.col("content_has_blockquote").alias("has_blockquote"), (F.size("paragraphs") > 0).alias("has_paragraph"))


_LANG = "regexp_extract(html, '<html lang=\"([a-z]*)\"', 1)"


@query("image_dedup", f"""SELECT page_id, {_LANG} AS topic_id,
  row_number() OVER (PARTITION BY {_LANG}, {q_hrefs()} ORDER BY page_id) > 1 AS is_dup FROM pages""")
def image_dedup(spark, sf):
    """A page repeats an earlier one of its language when it has the same
    images (links) in the same order."""
    p = table(spark, sf, "pages").select(
        F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("topic_id"),
        (F.floor(F.col("page_id") / 20) + 1).cast("int").alias("page_no"), (F.col("page_id") % 20).cast("int").alias("pos"),
        _hrefs().alias("images"))
    v = D.duplicate_sequences(p)
    return v.select(((F.col("page_no") - 1).cast("long") * 20 + F.col("pos")).alias("page_id"), "topic_id", "is_dup")


EMOTICON = "https://www.noelshack.com/emoticon"
HOT_ALT_ROWS = 100
_SIZE = ' width="68" height="51"'


@query("image_fullsize", f"""WITH r AS (
  SELECT page_id, unnest({q_hrefs()}) AS h, unnest(range(len({q_hrefs()}))) AS i, {_LANG} AS lang FROM pages),
m AS (
  SELECT *, 'https://image.example/minis/' || page_id || '-' || i || '.png' AS src,
    CASE i % 3 WHEN 0 THEN '{EMOTICON}' WHEN 1 THEN 'https://www.noelshack.com/{FULLSIZE_MARKER}/' || md5(h) || '.png'
      ELSE 'https://www.noelshack.com/page/' || md5(h) END AS alt FROM r),
t AS (SELECT alt, 'https://image.example/full/' || md5(max(h)) || '.png' AS full_src FROM m
      WHERE lang = 'en' AND i % 3 <> 1 GROUP BY alt),
n AS (
  SELECT m.*, CASE page_id % 3 WHEN 0 THEN CASE WHEN contains(m.alt, '{FULLSIZE_MARKER}') THEN m.alt ELSE coalesce(t.full_src, m.src) END
                               WHEN 1 THEN m.alt ELSE m.src END AS new_src
  FROM m LEFT JOIN t USING (alt))
SELECT page_id, CAST(i AS INTEGER) AS i, new_src AS src,
  CASE WHEN i % 4 = 3 THEN '51' END AS height,
  '<img alt="' || alt || '" src="' || new_src || '"' || CASE WHEN i % 4 = 3 THEN ' height="51"' ELSE '' END || '>' AS tag
FROM n""")
def image_fullsize(spark, sf):
    """U16 + J5 + X12's table: links stand for images; every third has one and
    the same ``alt`` (an emoticon), others name a stored file or an image page
    whose full-size source is looked up; every fourth has no width."""
    p = table(spark, sf, "pages")
    site = F.pmod("page_id", F.lit(3))
    base = p.select("page_id", F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"),
                    F.when(site == 0, SITE_A).when(site == 1, SITE_B).otherwise(ARCHIVE_HOST).alias("domain"),
                    _hrefs().alias("hs"))

    def alt(h, i):
        return F.when(i % 3 == 0, F.lit(EMOTICON)) \
            .when(i % 3 == 1, F.concat(F.lit(f"https://www.noelshack.com/{FULLSIZE_MARKER}/"), F.md5(h.cast("binary")), F.lit(".png"))) \
            .otherwise(F.concat(F.lit("https://www.noelshack.com/page/"), F.md5(h.cast("binary"))))

    def image(h, i):
        src = F.concat(F.lit("https://image.example/minis/"), F.col("page_id").cast("string"), F.lit("-"), i.cast("string"), F.lit(".png"))
        narrow = i % 4 == 3
        tag = F.concat(F.lit('<img alt="'), alt(h, i), F.lit('" src="'), src, F.lit('"'),
                       F.when(narrow, F.lit(' height="51"')).otherwise(F.lit(_SIZE)), F.lit(">"))
        return F.struct(src.alias("src"), alt(h, i).alias("alt"), F.when(~narrow, "68").alias("width"), F.lit("51").alias("height"),
                        F.lit(True).alias("hosted"), tag.alias("tag"))

    posts = base.select(F.col("page_id").cast("string").alias("topic_id"), F.lit(1).alias("page_no"), F.lit(0).alias("pos"),
                        "domain", F.lit(True).alias("is_image"), F.transform("hs", image).alias("images"))
    links = base.filter("lang = 'en'").select(F.posexplode("hs").alias("i", "h"))
    targets = links.filter("i % 3 <> 1").groupBy(alt(F.col("h"), F.col("i")).alias("page_url")).agg(F.max("h").alias("h")) \
        .select("page_url", F.concat(F.lit("https://image.example/full/"), F.md5(F.col("h").cast("binary")), F.lit(".png"))
                .alias("full_src"))
    e = A.fullsize_edits(posts, targets, hot_rows=HOT_ALT_ROWS)
    return e.select(F.col("topic_id").cast("long").alias("page_id"), "i", F.col("img.src").alias("src"),
                    F.col("img.height").alias("height"), F.col("img.tag").alias("tag"))


# --- archive and quotes ----------------------------------------------------------------
@query("selection_cases", f"""WITH {q_conv_selected(4).replace(
    "AS is_author,", "OR p.topic_id % 3 = 0 AS is_author, length(p.text) % 4 = 0 AS quote,", 1).replace(
    "WHERE is_author AND NOT short", "WHERE is_author AND NOT short AND NOT quote", 1).replace(
    "WHEN c.short THEN 'short'", "WHEN c.quote THEN 'quote' WHEN c.short THEN 'short'", 1)}
SELECT topic_id, CAST(count_if(reject_reason IS NULL) AS BIGINT) AS posts_kept,
  CAST(count_if(reject_reason = 'duplicate') AS BIGINT) AS duplicates, CAST(count_if(reject_reason = 'author') AS BIGINT) AS rejected_author,
  CAST(count_if(reject_reason = 'quote') AS BIGINT) AS rejected_quote, CAST(count_if(reject_reason = 'short') AS BIGINT) AS rejected_short
FROM sel GROUP BY topic_id""")
def selection_cases(spark, sf):
    """P2 + P6 + P9: every third topic is archived (its authors don't count);
    a quarter of the posts holds a quote."""
    posts = _conv(spark, sf, CASES_CFG).withColumn(
        "domain", F.when(F.pmod("topic_id", F.lit(3)) == 0, ARCHIVE_HOST).otherwise(SITE_A)) \
        .withColumn("content_has_blockquote", F.length(F.coalesce("content_text", F.lit(""))) % 4 == 0)
    v = SEL.selection_verdicts(posts, SEL.topic_authors(posts, CASES_CFG), CASES_CFG)
    return SEL.topic_counters(v, CASES_CFG)


CASES_CFG = CONV_CFG


# --- several runs ------------------------------------------------------------------------
@query("dedup_across_runs", f"""WITH {q_conv_selected(2)}
SELECT CAST(topic_id AS VARCHAR) AS topic_id, page_no, pos FROM sel WHERE reject_reason IS NULL""")
def dedup_across_runs(spark, sf):
    """T4: the pages of every topic come in three runs; each looks its texts up
    in the first-key index that the runs before it left, so the three together
    keep what one run over everything keeps."""
    cfg = RESUME_CFG.with_(dedup_across_runs=True)
    posts = _conv(spark, sf, cfg).withColumn("topic_id", F.col("topic_id").cast("string"))
    topics = SEL.topic_authors(posts, cfg)
    log = D.first_key_log(spark, scratch_path(spark, "first-keys"))
    kept = None
    for run, part in enumerate((F.col("page_no") == 1, F.col("page_no") == 2, F.col("page_no") > 2)):
        old = log.read().withColumnRenamed("topic_key", "topic_id")
        v = SEL.selection_verdicts(posts.filter(part), topics, cfg, old.select("topic_id", "kind", "key") if run else None)
        v = materialize(v, "verdicts")
        new = SEL.kept_keys(v).withColumnRenamed("topic_id", "topic_key")
        log.append(new if not run else D.merged_first_keys(log.read(), new), run)
        out = v.filter("kept").select("topic_id", "page_no", "pos")
        kept = out if kept is None else kept.unionByName(out)
    return kept


def conversation_crawl(conv: DataFrame, cfg: CurationConfig) -> DataFrame:
    """Conversations as a parse result (see ``extract.resolve``): one row per
    page, with the header on the first, and one per post."""
    p = conversation_posts(conv, cfg.posts_per_page).withColumn("topic_id", F.col("topic_id").cast("string"))
    link = F.concat(F.lit("https://www.jeuxvideo.com/forums/42-51-"), F.col("topic_id"), F.lit("-"),
                    F.col("page_no").cast("string"), F.lit("-0-1-0-t.htm"))
    schema = {f.name: f.dataType.simpleString() for f in X.resolve(X.candidates(
        conv.sparkSession.createDataFrame([], "topic_id string, page_no int, link string, html string"))).schema}
    src = F.xxhash64("topic_id", "page_no")
    posts = p.withColumn("kind", F.lit("post")).withColumn("src", src).withColumn("domain", F.lit(SITE_A))
    last = p.groupBy("topic_id").agg(F.max("page_no").alias("total_pages"), F.min_by("post_author", F.struct("page_no", "pos"))
                                     .alias("_author"))
    pages = p.groupBy("topic_id", "page_no").agg(F.count(F.lit(1)).cast("int").alias("n_posts")).join(last, "topic_id") \
        .withColumn("kind", F.lit("page")).withColumn("src", src).withColumn("domain", F.lit(SITE_A)).withColumn("link", link) \
        .withColumn("topic_key", F.concat(F.lit("https://www.jeuxvideo.com/forums/42-51-"), F.col("topic_id"), F.lit("-"))) \
        .withColumn("topic_author", F.when(F.col("page_no") == 1, F.col("_author"))).withColumn("title", F.col("topic_id"))
    whole = lambda df: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
                                   for c, t in schema.items()])
    return whole(posts).unionByName(whole(pages))


@query("resume_any_split", f"""WITH {q_conv_selected(2)}
SELECT CAST(topic_id AS VARCHAR) AS topic_id, page_no, pos, post_author FROM sel WHERE reject_reason IS NULL""")
def resume_any_split(spark, sf):
    """P11 + G1: a first run gets the odd pages of every topic, a second one
    the even pages, without the first page or the page it resumes at; header,
    pages and waiting posts come from the ledger.  Together they keep what one
    run over all pages keeps."""
    cfg = RESUME_CFG.with_(dedup_across_runs=True)
    crawl = conversation_crawl(table(spark, sf, "conversations"), cfg)
    state, ledger = ST.empty_state(spark), L.empty_ledger(spark)
    waiting, keys, kept = spark.createDataFrame([], X.WAITING_SCHEMA), None, None
    for part in ("page_no % 2 = 1", "page_no % 2 = 0"):
        r = curate.read_pages(materialize(crawl.filter(part), "crawled"), cfg, state, ledger, waiting)
        out = curate.finish(r, cfg, state, part, earlier_keys=keys)
        state, ledger, waiting, keys = (materialize(x, "run-result") for x in (out.state, out.ledger, out.waiting, out.kept_keys))
        posts = out.story_posts.select("topic_id", "page_no", "pos", "post_author")
        kept = posts if kept is None else kept.unionByName(posts)
    return kept


# --- stored logs --------------------------------------------------------------------------
_STATE_PARTS = ("o_orderdate < TIMESTAMP '1994-01-01'", "o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'",
                "o_orderdate >= TIMESTAMP '1997-01-01'")


@query("state_log", "WITH " + ",\n".join(f"v{i} AS ({_q_order_state(c)})" for i, c in enumerate(_STATE_PARTS)) + """,
every AS (SELECT *, 0 AS v FROM v0 UNION ALL SELECT *, 1 FROM v1 UNION ALL SELECT *, 2 FROM v2)
SELECT topic_key, arg_max(title, v) AS title, arg_max(page_link, v) AS page_link, arg_max(file_path, v) AS file_path,
  arg_max(total_pages, v) AS total_pages, arg_max(post_cursor, v) AS post_cursor FROM every GROUP BY topic_key""")
def state_log_q(spark, sf):
    """S5 + S7: three versions of the topic state, each written as the rows it
    changes; read back as the newest row per topic."""
    o = table(spark, sf, "orders")
    log = KeyedLog(spark, scratch_path(spark, "state-log"), ST.STATE_SCHEMA, ["topic_key"])
    for v, part in enumerate(_STATE_PARTS):
        log.append(_order_state_of(o.filter(part.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))), v)
    return log.read()


def _order_state_of(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("title"), F.max("o_orderkey").alias("mk"),
        F.count(F.lit(1)).cast("int").alias("total_pages"),
        F.count_if(F.col("o_orderstatus") == "O").cast("int").alias("post_cursor")).select(
        F.col("o_custkey").cast("string").alias("topic_key"), "title",
        F.concat(F.lit("orders/"), F.col("mk").cast("string")).alias("page_link"),
        F.concat(F.lit("stories/"), F.col("o_custkey").cast("string")).alias("file_path"), "total_pages", "post_cursor")


@query("state_unique", f"""WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS topic_key, o_orderpriority AS title,
  'orders/' || CAST(o_orderkey AS VARCHAR) AS page_link, o_orderstatus AS file_path,
  CAST(o_orderkey % 50 AS INTEGER) AS total_pages, CAST(o_orderkey % 7 AS INTEGER) AS post_cursor FROM orders)
SELECT topic_key, m.title AS title, m.page_link AS page_link, m.file_path AS file_path, m.total_pages AS total_pages, m.post_cursor AS post_cursor
FROM (SELECT topic_key, max(struct_pack(total_pages := total_pages, post_cursor := post_cursor, title := title, page_link := page_link,
        file_path := file_path)) AS m FROM o GROUP BY topic_key)""")
def state_unique(spark, sf):
    """L2: state rows with many per topic (orders of a customer) are reduced
    to the one that has been read furthest."""
    o = table(spark, sf, "orders")
    return ST.one_per_key(o.select(
        F.col("o_custkey").cast("string").alias("topic_key"), F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("page_link"), F.col("o_orderstatus").alias("file_path"),
        (F.col("o_orderkey") % 50).cast("int").alias("total_pages"), (F.col("o_orderkey") % 7).cast("int").alias("post_cursor")))


# --- the end-to-end runs over the raw pages ---------------------------------------------------
PAGES_CFG = CurationConfig(min_chars=200, posts_per_page=20, dedup_across_runs=True)
_Q_CURATED = f"""WITH x AS (
  SELECT page_id // {forum.TOPIC_PAGES} AS topic, CAST(page_id % {forum.TOPIC_PAGES} + 1 AS INTEGER) AS page_no,
    regexp_extract_all(html, '{forum.PARAGRAPH}', 1) AS ps FROM pages),
p AS (SELECT topic, page_no, unnest(ps) AS raw, CAST(unnest(range(len(ps))) AS INTEGER) AS pos FROM x),
t AS (SELECT *, {_q_unescape("raw")} AS txt, CASE WHEN pos % 3 = 2 THEN 'guest' ELSE 'writer' || topic END AS who FROM p),
c AS (SELECT *, lower(substr(txt, 1, 100)) AS tkey FROM t
      WHERE contains(who, 'writer') AND length(replace({q_trim("' ' || who || txt")}, chr(10), '')) >= {PAGES_CFG.min_chars}),
f AS (SELECT *, row_number() OVER (PARTITION BY topic, tkey ORDER BY page_no, pos) AS n FROM c),
first AS (SELECT DISTINCT topic FROM x WHERE page_no = 1)
SELECT CAST(topic AS VARCHAR) AS topic_id, page_no, pos, who AS post_author, md5(txt) AS text_md5
FROM f JOIN first USING (topic) WHERE n = 1"""


def _kept(posts: DataFrame) -> DataFrame:
    return posts.select("topic_id", "page_no", "pos", "post_author", F.md5(F.col("content_text").cast("binary")).alias("text_md5"))


@query("curate_pages", _Q_CURATED)
def curate_pages(spark, sf):
    """Batch run over every crawled page (topics of four pages): parse, author,
    quote, short and image rules, ordered dedup, rendering, state and metrics;
    the kept posts with their text."""
    pages = forum.topic_pages(table(spark, sf, "pages")).drop("page_id")
    return _kept(curate.run(spark, pages, PAGES_CFG, run_id="driver").story_posts)


@query("stream_pages", _Q_CURATED)
def stream_pages(spark, sf):
    """T1-T3 on every crawled page: the pages of a topic land in several
    landings, out of order and some again, one landing per micro-batch; a keyed
    state holds what can't be read yet.  The posts that the stream keeps are those
    of one batch run.  A landing has a file per core, so a batch is written, read
    and parsed by all cores."""
    from ..streaming.ingest import page_ingest
    p = forum.topic_pages(table(spark, sf, "pages"))
    base = scratch_path(spark, "stream-pages")
    files = spark.sparkContext.defaultParallelism
    # the landing of a page: later pages of a topic often land before earlier ones
    at = F.pmod(F.col("page_id") * 7 + F.floor(F.col("page_id") / 5), F.lit(forum.LANDINGS))
    for i in range(forum.LANDINGS):
        again = F.pmod(F.col("page_id"), F.lit(6)) == i
        p.filter((at == i) | (again & (at < i))).drop("page_id").repartition(files).write.parquet(f"{base}/landing/f{i}")
    schema = p.drop("page_id").schema
    page_ingest(spark, f"{base}/landing/*", schema, f"{base}/out", PAGES_CFG, max_files=files)
    return _kept(spark.read.parquet(f"{base}/out/story_posts"))
