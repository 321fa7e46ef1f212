"""Driver queries: each operator of the curation pipeline run over the test
tables (whole tables, no sampling), plus an independent SQL statement of the
same result for the DuckDB oracle.

Mapping of the test tables (see ``adapters``): conversations are topics of
posts, documents are posts grouped by language or source, pages are crawled
web pages (``a[href]`` stands for image sources), events are archive
snapshots, orders are state versions, parts are story titles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CurationConfig
from ..functions import slug as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import assets as A
from ..operators import dedup as D
from ..operators import render as R
from ..operators import select as SEL
from ..operators import state as ST
from ..session import materialize
from .adapters import conversation_posts, document_posts, table

# --- parameters of the driver runs (fixed so that results are comparable) --
CONV_CFG = CurationConfig(extra_authors=("assistant",), posts_per_page=4)
RESUME_CFG = CurationConfig(extra_authors=("assistant",), posts_per_page=2)
RESUME_PREV_PAGES = 2           # the previous run saw pages 1..2
DOC_CFG = CurationConfig(posts_per_page=20)
DOC_IDENTIFIERS = ("chapitre", "partie", r"chapitre \d", "ende", "capítulo")
HREF_PATTERN = r'(?i)<a\s[^>]*?href="([^"]*)"'
TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title>"
ARCHIVE_PREFIX = "https://web.archive.org/web/2020/"
SUPPORTED_DOMAINS = ("jeuxvideo.com", "jvarchive.com", "web.archive.org")
UPSERT_SPLIT = "1998-01-01"
# ----------------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# --- SQL helpers (DuckDB) ---------------------------------------------------
WS = T.WS_CLASS


def q_trim(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


def q_root(x: str) -> str:
    return rf"regexp_replace({x}, '\p{{Nd}}', '', 'g')"


def q_conv_posts(ppp: int) -> str:
    return (f"SELECT conv_id AS topic_id, CAST(turn // {ppp} + 1 AS INTEGER) AS page_no, "
            f"CAST(turn % {ppp} AS INTEGER) AS pos, role AS post_author, coalesce(text, '') AS text, turn "
            f"FROM conversations")


def q_conv_selected(ppp: int, extra: str = "assistant") -> str:
    """CTEs p, t, c (classified), cand, firsts (intent dedup), sel."""
    return f"""
p AS ({q_conv_posts(ppp)}),
t AS (SELECT conv_id AS topic_id, arg_min(role, turn) AS topic_author FROM conversations GROUP BY conv_id),
c AS (SELECT p.*, coalesce(contains(p.post_author, {q_root('t.topic_author')}) OR p.post_author = t.topic_author
                 OR contains(p.post_author, {q_root(f"'{extra}'")}) OR p.post_author = '{extra}', false) AS is_author,
             length(replace({q_trim('p.text')}, chr(10), '')) < 1000 AS short
      FROM p JOIN t USING (topic_id)),
cand AS (SELECT *, lower(substr(text, 1, 100)) AS tkey FROM c WHERE is_author AND NOT short),
firsts AS (SELECT topic_id, tkey, min(turn) AS turn, true AS first FROM cand GROUP BY topic_id, tkey),
sel AS (SELECT c.*, CASE WHEN NOT c.is_author THEN 'author' WHEN c.short THEN 'short'
                         WHEN f.first IS NULL THEN 'duplicate' END AS reject_reason
        FROM c LEFT JOIN cand USING (topic_id, turn)
        LEFT JOIN firsts f ON f.topic_id = c.topic_id AND f.tkey = cand.tkey AND f.turn = c.turn)"""


def _conv(spark, sf, cfg=CONV_CFG):
    return conversation_posts(table(spark, sf, "conversations"), cfg.posts_per_page)


def _conv_selected(spark, sf, cfg=CONV_CFG):
    posts = _conv(spark, sf, cfg)
    return SEL.select_story_posts(posts, SEL.topic_authors(posts, cfg), cfg)


def _hrefs(html="html"):
    return F.regexp_extract_all(F.col(html), F.lit(HREF_PATTERN), 1)


def q_hrefs(html="html") -> str:
    return f"regexp_extract_all({html}, '{HREF_PATTERN}', 1)"


# --- URL scalars ------------------------------------------------------------
@query("url_domain", "SELECT page_id, regexp_replace(string_split(url, '/')[3], 'www.', '', 'g') AS domain FROM pages")
def url_domain(spark, sf):
    """U1 on every crawled page URL."""
    return table(spark, sf, "pages").select("page_id", U.domain("url").alias("domain"))


_RUN1 = r"(?s)^((?:\P{Nd}*\p{Nd}+){0}\P{Nd}*)\p{Nd}+(.*)$"


@query("topic_key", f"""SELECT page_id,
  CASE WHEN regexp_matches(url, '{_RUN1}') THEN lower(regexp_extract(url, '{_RUN1}', 1)) END AS topic_key
FROM pages""")
def topic_key_q(spark, sf):
    """U4 (digit run 1: the test URLs carry one or two digit runs)."""
    return table(spark, sf, "pages").select("page_id", U.topic_key("url", 1).alias("topic_key"))


@query("page_frontier", f"""WITH t AS (
  SELECT regexp_replace(string_split(url, '/')[3], 'www.', '', 'g') AS domain,
         arg_min(url, page_id) AS link, count(*) AS total_pages FROM pages GROUP BY 1),
f AS (SELECT domain, link, CAST(unnest(generate_series(1, total_pages)) AS INTEGER) AS page_no FROM t)
SELECT domain, page_no,
  CASE WHEN regexp_matches(link, '{_RUN1}')
       THEN regexp_extract(link, '{_RUN1}', 1) || CAST(page_no AS VARCHAR) || regexp_extract(link, '{_RUN1}', 2) END
  AS page_link
FROM f""")
def page_frontier(spark, sf):
    """G1 + U2: topics are the crawled hosts (first page link, page count);
    one row per page to read with its link (digit run 1 replaced)."""
    p = table(spark, sf, "pages").select("page_id", "url", U.domain("url").alias("domain"))
    t = p.groupBy("domain").agg(F.min_by("url", "page_id").alias("link"),
                                F.count(F.lit(1)).cast("int").alias("total_pages")) \
        .withColumn("start_page", F.lit(1))
    f = ST.frontier(t)
    return f.select("domain", "page_no", U.page_link("link", "page_no", 1).alias("page_link"))


@query("archive_page_link", r"""SELECT page_id, url AS link_p1,
  regexp_replace(url, '/[^/]*\z', '') || '/2/' AS link_p2,
  regexp_replace(url, '/[^/]*\z', '') || '/12/' AS link_p12 FROM pages""")
def archive_page_link_q(spark, sf):
    """U3 for pages 1, 2 and 12 of every URL."""
    p = table(spark, sf, "pages")
    return p.select("page_id", U.archive_page_link("url", F.lit(1)).alias("link_p1"),
                    U.archive_page_link("url", F.lit(2)).alias("link_p2"),
                    U.archive_page_link("url", F.lit(12)).alias("link_p12"))


@query("archive_strip", f"""SELECT page_id,
  contains('{ARCHIVE_PREFIX}' || url, 'web.archive.org') AS is_archive,
  array_to_string(string_split('{ARCHIVE_PREFIX}' || url, '/')[6:], '/') AS stripped,
  CASE WHEN contains(url, 'web.archive.org') THEN array_to_string(string_split(url, '/')[6:], '/') ELSE url END AS cleaned
FROM pages""")
def archive_strip(spark, sf):
    """U5-U7 on archived copies of every page URL and on the URL itself."""
    p = table(spark, sf, "pages").withColumn("arch", F.concat(F.lit(ARCHIVE_PREFIX), F.col("url")))
    return p.select("page_id", U.is_archive("arch").alias("is_archive"),
                    U.strip_archive("arch").alias("stripped"), U.clean_asset_url("url").alias("cleaned"))


_URI = U.URI_PARTS


@query("video_link", f"""WITH x AS (SELECT page_id, url,
   regexp_extract(url, '{_URI}', 1) AS sch, regexp_extract(url, '{_URI}', 2) AS auth,
   regexp_extract(url, '{_URI}', 3) AS path, regexp_extract(url, '{_URI}', 5) AS frag FROM pages)
SELECT page_id,
  (CASE WHEN sch <> '' THEN sch || ':' ELSE '' END) || (CASE WHEN auth <> '' THEN '//' || auth ELSE '' END)
  || '/watch?v=' || (CASE WHEN contains(path, '/') THEN string_split(path, '/')[-1] ELSE '' END)
  || (CASE WHEN frag <> '' THEN '#' || frag ELSE '' END) AS watch_url
FROM x""")
def video_link(spark, sf):
    """U9 applied to every page URL as an embed link."""
    return table(spark, sf, "pages").select("page_id", U.video_watch_url("url").alias("watch_url"))


# --- assets over page links -------------------------------------------------
def _page_refs(spark, sf):
    p = table(spark, sf, "pages").select("page_id", _hrefs().alias("images"))
    return A.asset_refs(p, "images", key=["page_id"])


_Q_REFS = f"""refs AS (
  SELECT page_id, h AS src,
    CASE WHEN contains(h, 'web.archive.org') THEN array_to_string(string_split(h, '/')[6:], '/') ELSE h END AS url
  FROM (SELECT page_id, unnest({q_hrefs()}) AS h FROM pages)),
named AS (SELECT *, CASE WHEN contains(url, '/') THEN string_split(url, '/')[-1] ELSE '' END AS file_name FROM refs)"""


@query("asset_name", f"WITH {_Q_REFS} SELECT page_id, src, file_name FROM named")
def asset_name_q(spark, sf):
    """U7 + U8 for every linked asset of every page."""
    return _page_refs(spark, sf).select("page_id", "src", "file_name")


@query("asset_inventory", f"""WITH {_Q_REFS}
SELECT file_name, min(url) AS url, count(*) AS n_refs FROM named GROUP BY file_name""")
def asset_inventory(spark, sf):
    """Each asset once with its first URL and use count."""
    return A.inventory(_page_refs(spark, sf))


_EN = "html LIKE '%<html lang=\"en\"%'"


@query("asset_missing", f"""WITH {_Q_REFS},
inv AS (SELECT file_name, min(url) AS url, count(*) AS n_refs FROM named GROUP BY file_name),
cache AS (SELECT DISTINCT file_name FROM named WHERE page_id IN (SELECT page_id FROM pages WHERE {_EN}))
SELECT * FROM inv ANTI JOIN cache USING (file_name)""")
def asset_missing(spark, sf):
    """Assets not in the cache; the cache holds what the English
    pages link to (they were crawled with images before)."""
    refs = _page_refs(spark, sf)
    en = table(spark, sf, "pages").filter(F.col("html").contains('<html lang="en"')).select("page_id")
    manifest = refs.join(en, "page_id", "left_semi").select("file_name")
    return A.missing_assets(A.inventory(refs), manifest)


@query("asset_rewrite", f"""SELECT page_id, CAST(len({q_hrefs()}) AS BIGINT) AS n_assets,
  array_to_string(list_transform({q_hrefs()}, lambda h: 'risitas-html/images/' ||
     (CASE WHEN contains(CASE WHEN contains(h, 'web.archive.org') THEN array_to_string(string_split(h, '/')[6:], '/') ELSE h END, '/')
           THEN string_split(CASE WHEN contains(h, 'web.archive.org') THEN array_to_string(string_split(h, '/')[6:], '/') ELSE h END, '/')[-1]
           ELSE '' END)), ' ') AS rewritten
FROM pages""")
def asset_rewrite(spark, sf):
    """Every linked asset of a page points to the local asset folder."""
    p = table(spark, sf, "pages").select("page_id", _hrefs().alias("h"))
    imgs = F.transform("h", lambda x: F.struct(x.alias("src")))
    r = A.rewrite_sources(imgs, DOC_CFG)
    return p.select("page_id", F.size("h").cast("long").alias("n_assets"),
                    F.array_join(F.transform(r, lambda i: i["src"]), " ").alias("rewritten"))


@query("asset_oldest_snapshot", """WITH s AS (
  SELECT CAST(user_id AS VARCHAR) AS url, ts AS snapshot_ts, 'snap/' || CAST(event_id AS VARCHAR) AS archive_url,
         CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status FROM events),
o AS (SELECT url, arg_min(archive_url, (snapshot_ts, archive_url)) AS archive_url,
             min(snapshot_ts) AS snapshot_ts FROM s GROUP BY url)
SELECT o.url, o.snapshot_ts, o.archive_url, s.status, s.status = 200 AS accepted
FROM o JOIN s USING (url, archive_url)""")
def asset_oldest_snapshot(spark, sf):
    """snapshots = events (url = user, status 503 for error events); the
    oldest snapshot per URL and whether it is usable."""
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("url"), F.col("ts").alias("snapshot_ts"),
        F.concat(F.lit("snap/"), F.col("event_id").cast("string")).alias("archive_url"),
        F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"))
    return A.oldest_snapshot(e)


# --- page extraction by regex ----------------------------------------------
@query("page_links", f"SELECT page_id, CAST(len({q_hrefs()}) AS BIGINT) AS n_links FROM pages")
def page_links(spark, sf):
    """Number of links of each page."""
    return table(spark, sf, "pages").select("page_id", F.size(_hrefs()).cast("long").alias("n_links"))


@query("unsupported_sites", f"""SELECT page_id, regexp_replace(string_split(url, '/')[3], 'www.', '', 'g') AS domain,
  'unsupported_domain' AS reason FROM pages
WHERE coalesce(regexp_replace(string_split(url, '/')[3], 'www.', '', 'g'), '') NOT IN {SUPPORTED_DOMAINS}""")
def unsupported_sites(spark, sf):
    """Pages whose domain has no site profile (anti join with the
    broadcast profile table, which has a fixed handful of rows)."""
    from ..sources.profiles import site_profiles
    prof = site_profiles(spark).select("domain").distinct()
    p = table(spark, sf, "pages").select("page_id", U.domain("url").alias("domain"))
    return p.join(F.broadcast(prof), p["domain"].eqNullSafe(prof["domain"]), "left_anti") \
        .withColumn("reason", F.lit("unsupported_domain"))


# --- text scalars over documents -------------------------------------------
@query("short_posts", f"""SELECT doc_id, CAST(length(replace({q_trim("coalesce(text, '')")}, chr(10), '')) AS BIGINT) AS n_chars_stripped,
  length(replace({q_trim("coalesce(text, '')")}, chr(10), '')) < 1000 AS is_short FROM documents""")
def short_posts(spark, sf):
    """P4 on every document."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.stripped_len(F.coalesce(F.col("text"), F.lit(""))).alias("n_chars_stripped"),
                    T.is_short("text").alias("is_short"))


@query("identifier_match", f"""SELECT doc_id,
  coalesce(regexp_matches(substr(string_split(text, chr(10))[1], 1, 200), '{"|".join(DOC_IDENTIFIERS)}', 'i'), false)
  AS has_identifier FROM documents""")
def identifier_match(spark, sf):
    """P5: identifiers in the first 200 chars of the first paragraph (line)."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.has_identifier(F.get(T.lines("text"), 0), DOC_IDENTIFIERS).alias("has_identifier"))


@query("quote_norm", "SELECT doc_id, replace(text, '’', '''') AS text_norm FROM documents")
def quote_norm_q(spark, sf):
    """U11 on every document."""
    return table(spark, sf, "documents").select("doc_id", T.quote_norm("text").alias("text_norm"))


def _q_ex(i: int) -> str:
    return f"nullif(replace({q_trim(f'substr(string_split(text, chr(10))[{i}], 1, 50)')}, chr(10), ''), '')"


@query("excerpt", f"SELECT doc_id, coalesce({_q_ex(1)}, {_q_ex(2)}) AS excerpt FROM documents")
def excerpt_q(spark, sf):
    """U12 on every document (paragraphs = lines)."""
    return table(spark, sf, "documents").select("doc_id", T.excerpt(T.lines("text")).alias("excerpt"))


# --- slugs and versions over parts ------------------------------------------
def q_slug(x: str, title: bool) -> str:
    a = T.ASCII_WS_CLASS
    s = x
    if title:
        s = f"replace({q_trim(f'regexp_replace({x}, ' + chr(39) + r'(?i)\[risitas\]' + chr(39) + ', ' + chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, ' ', '-')"
    s = f"lower(regexp_replace(strip_accents({s}), '[^\\x00-\\x7F]', '', 'g'))"
    s = f"regexp_replace({s}, '[^A-Za-z0-9_{a[1:-1]}-]', '', 'g')"
    s = f"regexp_replace({s}, '(?:-|{a})+', '-', 'g')"
    return f"trim({s}, '-_')"


@query("story_slug", f"""SELECT p_partkey, {q_slug('p_name', True)} AS title_slug,
  {q_slug('p_brand', False)} || '-' || {q_slug('p_name', True)} || '-0' AS file_stem FROM part""")
def story_slug(spark, sf):
    """U10 + U20: title slug of every part name; file stem brand-title-0."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.slugify("p_name", title=True).alias("title_slug"),
                    S.story_stem("p_brand", "p_name", F.lit(0)).alias("file_stem"))


@query("slug_version", f"""WITH s AS (SELECT p_partkey, {q_slug('p_brand', False)} || '-' || {q_slug('p_name', True)} AS slug FROM part),
u AS (SELECT slug, CAST(p_size % 3 AS BIGINT) AS version FROM s JOIN part USING (p_partkey) WHERE p_size <= 10),
g AS (SELECT slug, version - (row_number() OVER (PARTITION BY slug ORDER BY version) - 1) AS gap FROM (SELECT DISTINCT slug, version FROM u)),
n AS (SELECT p_partkey, slug, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) - 1 AS r FROM s WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 10))
SELECT n.p_partkey, n.slug, CAST(n.r + (SELECT count(*) FROM g WHERE g.slug = n.slug AND g.gap <= n.r) AS BIGINT) AS version
FROM n""")
def slug_version(spark, sf):
    """Parts of size <= 10 are stories already written (version = size
    mod 3); every other part gets the smallest free version of its slug."""
    p = table(spark, sf, "part").select(
        "p_partkey", "p_size", F.concat_ws("-", S.slugify("p_brand"), S.slugify("p_name", title=True)).alias("slug"))
    used = p.filter(F.col("p_size") <= 10).select("slug", F.pmod("p_size", F.lit(3)).cast("long").alias("version"))
    new = p.filter(F.col("p_size") > 10).select("p_partkey", "slug")
    return R.version_numbers(new, used, order="p_partkey").select("p_partkey", "slug", F.col("version").cast("long"))


# --- selection over conversations -------------------------------------------
@query("topic_author", "SELECT conv_id AS topic_id, arg_min(role, turn) AS topic_author FROM conversations GROUP BY conv_id")
def topic_author(spark, sf):
    """A1: author of the first post of each topic."""
    return SEL.topic_authors(_conv(spark, sf), CONV_CFG).select("topic_id", "topic_author")


@query("author_set", """SELECT conv_id AS topic_id,
  CASE WHEN arg_min(role, turn) = 'assistant' THEN 'assistant' ELSE arg_min(role, turn) || '|assistant' END AS authors
FROM conversations GROUP BY conv_id""")
def author_set_q(spark, sf):
    """A2: topic author + extra author 'assistant', without repeats."""
    t = SEL.topic_authors(_conv(spark, sf), CONV_CFG)
    return t.select("topic_id", F.array_join("authors", "|").alias("authors"))


@query("author_match", f"""WITH t AS (SELECT conv_id, arg_min(role, turn) AS a FROM conversations GROUP BY conv_id)
SELECT c.conv_id AS topic_id, c.turn,
  coalesce(contains(c.role, {q_root('t.a')}) OR c.role = t.a, false) AS match_root,
  coalesce(c.role = t.a, false) AS match_exact
FROM conversations c JOIN t USING (conv_id)""")
def author_match_q(spark, sf):
    """P1/U13/J6 in both modes (root substring, exact)."""
    c = table(spark, sf, "conversations")
    posts = conversation_posts(c, CONV_CFG.posts_per_page)
    t = SEL.topic_authors(posts, CurationConfig())
    j = c.join(t.withColumnRenamed("topic_id", "conv_id"), "conv_id")
    return j.select(F.col("conv_id").alias("topic_id"), "turn",
                    SEL.author_match("role", "authors", True).alias("match_root"),
                    SEL.author_match("role", "authors", False).alias("match_exact"))


@query("story_posts", f"WITH {q_conv_selected(4)} SELECT topic_id, page_no, pos, post_author, false AS is_image FROM sel WHERE reject_reason IS NULL")
def story_posts_q(spark, sf):
    """P9 (+P2): the posts of each story: author (or extra author) matches,
    no quote, not short unless an image post, not a duplicate."""
    s = _conv_selected(spark, sf)
    return SEL.story_posts(s).select("topic_id", "page_no", "pos", "post_author", "is_image")


@query("reject_reason_counts", f"""WITH {q_conv_selected(4)}
SELECT topic_id, CAST(count_if(reject_reason IS NULL) AS BIGINT) AS posts_kept,
  CAST(count_if(reject_reason = 'duplicate') AS BIGINT) AS duplicates,
  CAST(count_if(reject_reason = 'author') AS BIGINT) AS rejected_author,
  CAST(0 AS BIGINT) AS rejected_quote,
  CAST(count_if(reject_reason = 'short') AS BIGINT) AS rejected_short
FROM sel GROUP BY topic_id""")
def reject_reason_counts(spark, sf):
    """P10 + A3: per topic kept posts, duplicates and rejections by rule
    (from the narrow per-post verdicts)."""
    posts = _conv(spark, sf)
    v = SEL.selection_verdicts(posts, SEL.topic_authors(posts, CONV_CFG), CONV_CFG)
    return SEL.topic_counters(v, CONV_CFG)


IDENT_CFG = CONV_CFG.with_(identifier_rescues_short=True, identifiers=("chapitre", "partie", "the", "que"))


@query("story_posts_identifiers", f"""WITH {q_conv_selected(4).replace(
    "< 1000 AS short",
    "< 1000 AND NOT coalesce(regexp_matches(substr(string_split(p.text, chr(10))[1], 1, 200), "
    "'chapitre|partie|the|que', 'i'), false) AS short")}
SELECT topic_id, page_no, pos, post_author FROM sel WHERE reject_reason IS NULL""")
def story_posts_identifiers(spark, sf):
    """P9 with P5 as documented: a short post whose first paragraph carries
    an identifier (first 200 chars, any case) is kept."""
    s = _conv_selected(spark, sf, IDENT_CFG)
    return SEL.story_posts(s).select("topic_id", "page_no", "pos", "post_author")


@query("running_kept", f"""WITH {q_conv_selected(4)}
SELECT topic_id, page_no, pos, row_number() OVER (PARTITION BY topic_id ORDER BY turn) - 1 AS kept_before
FROM sel WHERE reject_reason IS NULL""")
def running_kept_q(spark, sf):
    """Running count of kept posts before each kept post of a topic."""
    posts = _conv(spark, sf)
    v = SEL.selection_verdicts(posts, SEL.topic_authors(posts, CONV_CFG), CONV_CFG)
    return SEL.running_kept(v)


@query("all_posts", f"WITH {q_conv_selected(4)} SELECT topic_id, page_no, pos, post_author FROM sel WHERE is_author")
def all_posts(spark, sf):
    """All-posts mode keeps every post of the authors."""
    cfg = CONV_CFG.with_(all_posts=True)
    s = _conv_selected(spark, sf, cfg)
    return SEL.story_posts(s).select("topic_id", "page_no", "pos", "post_author")


@query("story_render", f"""WITH {q_conv_selected(4)}
SELECT topic_id AS story_key, CAST(page_no AS BIGINT) AS chunk_no,
  string_agg(replace(text, '’', ''''), '' ORDER BY pos) AS html, count(*) AS n_posts
FROM sel WHERE reject_reason IS NULL GROUP BY topic_id, page_no""")
def story_render(spark, sf):
    """A5 + S9: each story rendered as ordered chunks (one per page)."""
    return R.render_chunks(SEL.story_posts(_conv_selected(spark, sf)))


# --- ordered dedup over documents -------------------------------------------
def _doc_cands(spark, sf):
    d = document_posts(table(spark, sf, "documents"), DOC_CFG.posts_per_page, topic_col="lang")
    return d.withColumn("img_post", F.lit(False))


def _dedup_out(spark, sf, cfg):
    c = _doc_cands(spark, sf)
    v = D.duplicate_verdicts(c, cfg)
    return v.select((F.col("page_no") - 1).cast("long") * DOC_CFG.posts_per_page + F.col("pos"),
                    F.col("topic_id").alias("lang"), "is_dup").toDF("doc_id", "lang", "is_dup")


_Q_DOCKEYS = "c AS (SELECT doc_id, lang, lower(substr(coalesce(text, ''), 1, 100)) AS tkey FROM documents)"


@query("dedup_intent", f"""WITH {_Q_DOCKEYS},
f AS (SELECT lang, tkey, min(doc_id) AS first_id FROM c GROUP BY lang, tkey)
SELECT c.doc_id, c.lang, c.doc_id <> f.first_id AS is_dup FROM c JOIN f USING (lang, tkey)""")
def dedup_intent(spark, sf):
    """W3 (documented intent): a document repeats an earlier one of its
    language when its first 100 chars match, ignoring case."""
    return _dedup_out(spark, sf, DOC_CFG)


@query("dedup_as_coded", f"""WITH {_Q_DOCKEYS},
f AS (SELECT lang, arg_min(tkey, doc_id) AS k0, min(doc_id) AS f_id FROM c GROUP BY lang),
p AS (SELECT c.lang, arg_min(c.tkey, c.doc_id) AS k1, min(c.doc_id) AS p_id FROM c JOIN f USING (lang)
      WHERE c.doc_id > f.f_id AND c.tkey <> f.k0 GROUP BY c.lang)
SELECT c.doc_id, c.lang,
  (c.doc_id > f.f_id AND (((p.p_id IS NULL OR c.doc_id < p.p_id) AND c.tkey = f.k0)
                          OR (p.p_id IS NOT NULL AND c.doc_id > p.p_id AND c.tkey = p.k1))) AS is_dup
FROM c JOIN f USING (lang) LEFT JOIN p USING (lang)""")
def dedup_as_coded(spark, sf):
    """W3 as coded: compare with the first kept post until a second one is
    kept, then only with the second."""
    return _dedup_out(spark, sf, DOC_CFG.with_(dedup_as_coded=True))


# --- parts and sizes over documents by source ------------------------------
def _doc_blocks(spark, sf):
    d = table(spark, sf, "documents")
    return document_posts(d, DOC_CFG.posts_per_page, topic_col="source") \
        .select("topic_id", "page_no", "pos", "content_html")


@query("story_chunks", """WITH b AS (SELECT source, doc_id, text,
   (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 30 AS part_no FROM documents)
SELECT source AS story_key, CAST(part_no AS BIGINT) AS part_no, string_agg(text, '' ORDER BY doc_id) AS html,
  count(*) AS n_blocks FROM b GROUP BY source, part_no""")
def story_chunks(spark, sf):
    """W7 + A7: each source's documents in order, in parts of 30 blocks."""
    return R.story_parts(_doc_blocks(spark, sf), DOC_CFG)


_FIXED = len((R.STORY_HEADER + R.STORY_FOOTER).encode("utf-8"))


@query("big_stories", f"""SELECT source AS story_key,
  CAST(sum(octet_length(encode(replace(text, '’', '''')))) + {_FIXED} AS BIGINT) AS n_bytes, count(*) AS n_blocks,
  sum(octet_length(encode(replace(text, '’', '''')))) + {_FIXED} >= 3670016 AS is_big
FROM documents GROUP BY source""")
def big_stories(spark, sf):
    """U19 + G3: UTF-8 size of each rendered story and whether it is split."""
    return R.story_sizes(_doc_blocks(spark, sf), DOC_CFG)


@query("export_union", """SELECT source AS story_key, 'run' AS origin FROM documents WHERE lang = 'en' GROUP BY source
UNION ALL SELECT source AS story_key, 'named' AS origin FROM documents WHERE coalesce(lang, '') <> 'en' GROUP BY source""")
def export_union(spark, sf):
    """Stories made in this run (sources with English documents) plus
    stories named by the user (sources with any others), as a bag."""
    d = table(spark, sf, "documents")
    en = F.coalesce(F.col("lang") == "en", F.lit(False))
    run = d.filter(en).select(F.col("source").alias("story_key")).distinct() \
        .withColumn("origin", F.lit("run"))
    named = d.filter(~en).select(F.col("source").alias("story_key")).distinct() \
        .withColumn("origin", F.lit("named"))
    return run.unionByName(named)


# --- resume state over conversations ----------------------------------------
def _resume_inputs(spark, sf):
    cfg = RESUME_CFG
    posts = _conv(spark, sf, cfg)
    topics = SEL.topic_authors(posts, cfg)
    prev = SEL.selection_verdicts(posts.filter(F.col("page_no") <= RESUME_PREV_PAGES), topics, cfg)
    # a stored state is a table: write the derived one once (one row per topic)
    state = materialize(ST.cursor_advance(prev, cfg), "prev-state")
    return posts, topics, state


def q_prev_state(whole: bool = False) -> str:
    # selection restricted to the pages of the previous run
    body = q_conv_selected(2) if whole else q_conv_selected(2).replace(
        f"p AS ({q_conv_posts(2)})", f"p AS (SELECT * FROM ({q_conv_posts(2)}) WHERE page_no <= {RESUME_PREV_PAGES})", 1)
    return body + """,
lastp AS (SELECT topic_id, max(page_no) AS st_page FROM sel GROUP BY topic_id),
st AS (SELECT l.topic_id, CAST(l.st_page AS INTEGER) AS total_pages,
              CAST(coalesce(max(CASE WHEN s.reject_reason IS NULL AND s.page_no = l.st_page THEN s.pos END), 0) AS INTEGER) AS post_cursor
       FROM lastp l JOIN sel s USING (topic_id) GROUP BY l.topic_id, l.st_page)"""


@query("cursor_advance", f"WITH {q_prev_state(whole=True)} SELECT topic_id, total_pages, post_cursor FROM st")
def cursor_advance_q(spark, sf):
    """A4 + W5: state after a run over every page: last page and the position
    of the last kept post on it (0 when none)."""
    posts = _conv(spark, sf, RESUME_CFG)
    topics = SEL.topic_authors(posts, RESUME_CFG)
    return ST.cursor_advance(SEL.selection_verdicts(posts, topics, RESUME_CFG), RESUME_CFG)


@query("resume_filter", f"""WITH {q_prev_state()},
allp AS ({q_conv_posts(2)}),
pg AS (SELECT topic_id, page_no, max(pos) AS mx FROM allp GROUP BY topic_id, page_no),
ends AS (SELECT pg.topic_id, min(pg.page_no) AS end_page FROM pg JOIN st USING (topic_id)
         WHERE pg.page_no >= st.total_pages AND (pg.mx > st.post_cursor OR pg.mx >= 1) GROUP BY pg.topic_id)
SELECT a.topic_id, a.page_no, a.pos FROM allp a LEFT JOIN st USING (topic_id) LEFT JOIN ends USING (topic_id)
WHERE st.topic_id IS NULL OR (a.page_no >= st.total_pages
      AND NOT (a.page_no <= coalesce(ends.end_page, 2147483647) AND a.pos <= st.post_cursor))""")
def resume_filter_q(spark, sf):
    """P11 + J2 + T2: the posts a resumed run reads after the stored cursor
    (state joined on the topic key)."""
    posts, _, state = _resume_inputs(spark, sf)
    return ST.resume_filter(posts, state, RESUME_CFG).select("topic_id", "page_no", "pos")


@query("remaining_pages", f"""WITH {q_prev_state()},
tot AS (SELECT conv_id AS topic_id, CAST(max(turn) // 2 + 1 AS INTEGER) AS total_pages FROM conversations GROUP BY conv_id)
SELECT tot.topic_id, tot.total_pages,
  CAST(CASE WHEN st.topic_id IS NULL THEN tot.total_pages ELSE tot.total_pages - st.total_pages + 1 END AS INTEGER) AS remaining_pages
FROM tot LEFT JOIN st USING (topic_id)""")
def remaining_pages_q(spark, sf):
    """Pages left to read per topic given the stored state."""
    posts, _, state = _resume_inputs(spark, sf)
    tot = posts.groupBy("topic_id").agg(F.max("page_no").cast("int").alias("total_pages"))
    j = tot.join(state.select("topic_id", F.col("total_pages").alias("st_pages")), "topic_id", "left")
    return j.select("topic_id", "total_pages",
                    ST.remaining_pages(F.col("total_pages"), F.col("st_pages")).cast("int").alias("remaining_pages"))


def _order_state(df, since: bool):
    f = F.col("o_orderdate") >= F.lit(UPSERT_SPLIT).cast("timestamp_ntz")
    d = df.filter(f if since else ~f)
    return d.groupBy("o_custkey").agg(
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("title"),
        F.max("o_orderkey").alias("mk"),
        F.count(F.lit(1)).cast("int").alias("total_pages"),
        F.count_if(F.col("o_orderstatus") == "O").cast("int").alias("post_cursor"),
    ).select(F.col("o_custkey").cast("string").alias("topic_key"), "title",
             F.concat(F.lit("orders/"), F.col("mk").cast("string")).alias("page_link"),
             F.concat(F.lit("stories/"), F.col("o_custkey").cast("string")).alias("file_path"),
             "total_pages", "post_cursor")


def _q_order_state(cond: str) -> str:
    return f"""SELECT CAST(o_custkey AS VARCHAR) AS topic_key,
  arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS title,
  'orders/' || CAST(max(o_orderkey) AS VARCHAR) AS page_link,
  'stories/' || CAST(o_custkey AS VARCHAR) AS file_path,
  CAST(count(*) AS INTEGER) AS total_pages, CAST(count_if(o_orderstatus = 'O') AS INTEGER) AS post_cursor
FROM orders WHERE {cond} GROUP BY o_custkey"""


@query("state_upsert", f"""WITH o AS ({_q_order_state(f"o_orderdate < TIMESTAMP '{UPSERT_SPLIT}'")}),
n AS ({_q_order_state(f"o_orderdate >= TIMESTAMP '{UPSERT_SPLIT}'")})
SELECT coalesce(n.topic_key, o.topic_key) AS topic_key,
  CASE WHEN n.topic_key IS NOT NULL THEN n.title ELSE o.title END AS title,
  CASE WHEN n.topic_key IS NOT NULL THEN n.page_link ELSE o.page_link END AS page_link,
  CASE WHEN n.topic_key IS NOT NULL THEN n.file_path ELSE o.file_path END AS file_path,
  CASE WHEN n.topic_key IS NOT NULL THEN n.total_pages ELSE o.total_pages END AS total_pages,
  CASE WHEN n.topic_key IS NOT NULL THEN n.post_cursor ELSE o.post_cursor END AS post_cursor
FROM o FULL OUTER JOIN n ON o.topic_key = n.topic_key""")
def state_upsert(spark, sf):
    """S7 + J8: state from orders before the split date, updated/extended by
    the state from later orders (one row per customer)."""
    o = table(spark, sf, "orders")
    return ST.upsert_state(_order_state(o, False), _order_state(o, True))


# --- HTML extraction over pages ---------------------------------------------
def _extracted(spark, sf):
    from ..operators import extract as X
    p = table(spark, sf, "pages").select(F.col("page_id").alias("topic_id"), F.lit(1).alias("page_no"),
                                         "url", "html")
    return X.extract(p, X.TEST_LAYOUT_ROWS, spread=True)


def _q_unescape(x: str) -> str:
    """Entity decoding for the oracle: the legacy entities also decode
    without ';' (as HTML parsers do); '&amp' goes last so '&amp;lt;' decodes
    one level only."""
    for ent, ch in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;", "''"), ("&amp;?", "&")):
        x = f"regexp_replace({x}, '{ent}', '{ch}', 'g')"
    return x


@query("page_title", f"""SELECT CAST(page_id AS VARCHAR) AS topic_id,
  {q_trim(_q_unescape("regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1)"))} AS title,
  CAST(1 AS INTEGER) AS total_pages FROM pages""")
def page_title(spark, sf):
    """X3-X5 (header of each page: title, page count) from the parse job."""
    from ..operators import extract as X
    topics, _, _ = X.split(_extracted(spark, sf))
    return topics.select("topic_id", "title", "total_pages")


_Q_PARTS = """a AS (SELECT page_id, string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>')[2:] AS l
               FROM pages),
parts AS (SELECT page_id, unnest(l) AS part, unnest(range(len(l))) AS pos FROM a)"""


@query("post_explode", f"""WITH {_Q_PARTS}
SELECT CAST(page_id AS VARCHAR) AS topic_id, CAST(1 AS INTEGER) AS page_no, CAST(pos AS INTEGER) AS pos,
  CASE WHEN contains(part, '<b>') THEN
    {q_trim(_q_unescape("regexp_replace(regexp_extract(part, '(?s)<b>(.*?)(?:</b>|$)', 1), '<[^>]*>', '', 'g')"))}
  END AS post_author,
  CAST(length({_q_unescape("regexp_replace(part, '<[^>]*>', '', 'g')")}) AS BIGINT) AS n_chars,
  CAST(0 AS BIGINT) AS n_paragraphs,
  CAST(len(regexp_extract_all(part, '<a[\\s>]', 0)) AS BIGINT) AS n_links,
  contains(part, '<blockquote') AS content_has_blockquote
FROM parts""")
def post_explode(spark, sf):
    """Every page parsed into posts (``article > p``) with
    position, author, text length and feature counts (the oracle splits the
    article markup with regexes; the job parses it into a tree)."""
    from ..operators import extract as X
    _, posts, _ = X.split(_extracted(spark, sf))
    return posts.select("topic_id", "page_no", "pos", "post_author",
                        F.length("content_text").cast("long").alias("n_chars"),
                        F.size("paragraphs").cast("long").alias("n_paragraphs"),
                        F.col("n_links").cast("long").alias("n_links"),
                        "content_has_blockquote")


# --- streaming ----------------------------------------------------------------
@query("stream_ingest", """SELECT user_id, count(*) AS n_posts, max(ts) AS last_ts FROM events GROUP BY user_id""")
def stream_ingest(spark, sf):
    """Events arrive through a file stream (availableNow); each row
    counts once (streaming dedup in the state store) and a stateful
    aggregation keeps per-topic counters, emitting the changed topics per
    micro-batch; the result is the latest state per topic."""
    from ..streaming.ingest import event_ingest
    return event_ingest(spark, sf, "events.parquet")
