"""End-to-end curation run: crawled pages -> stories, state, metrics.

Stage plan:
  1. filter pages (status, pages already read) before the parse;
  2. parse once (Python, Arrow batches) and write the result to the shared
     checkpoint folder: the raw pages are read once, lineage is cut, and
     every output reads the written result;
  3. decide on narrow rows which pages are read now (``read_pages``): one row
     per topic (header, ledger, state) and one row per page; a page after a gap,
     or without its topic's header, waits with its parsed posts;
  4. selection on a narrow classification written once (partitioned by
     candidate / image post): topic and page joins on narrow rows (AQE picks
     broadcast or sort-merge from runtime sizes, skew splits on), duplicate
     verdicts by aggregates + joins keyed by post position;
  5. the post rows are shuffled once, by (topic, page), to meet the verdicts
     of those that are kept; rendering groups by (story, page) on that same
     partitioning;
  6. state, ledger, waiting pages, first-key index, metrics, rejects,
     quarantine and the crawl frontier from the narrow tables.
"""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ARCHIVE_HOST, CurationConfig
from ..functions.slug import slugify
from ..functions.text import excerpt
from ..functions.urls import domain as domain_of
from ..functions.urls import topic_key as topic_key_of
from ..functions.urls import topic_page_link
from ..operators import assets as A
from ..operators import extract as X
from ..operators import ledger as L
from ..operators import render as R
from ..operators import select as SEL
from ..operators import state as ST
from ..session import materialize


@dataclass
class Named:
    """The tables that need the names of the run's stories."""
    stories: DataFrame       # story_key, run_id, chunk_no, html, n_posts
    state: DataFrame         # new full state
    changes: DataFrame       # the state rows that this run inserts or updates
    touched: DataFrame       # story_key, file_path, mode (create|append)


@dataclass
class RunOutputs:
    story_posts: DataFrame   # kept posts
    rejects: DataFrame       # topic_id, page_no, pos, reject_reason
    metrics: DataFrame       # run_date, topic_id, posts_kept, duplicates, ...
    quarantine: DataFrame    # topic_id, page_no, pos, reason
    frontier: DataFrame      # topic_id, page_no, page_link: pages to crawl that are missing
    kept_keys: DataFrame     # topic_key, kind, key, ord: dedup keys of this run's kept posts
    ledger: DataFrame        # the ledger rows that this run inserts or updates
    waiting: DataFrame       # parsed posts of the pages that wait (all of them)
    named: Future            # a Named, see ``finish``

    stories = property(lambda self: self.named.result().stories)
    state = property(lambda self: self.named.result().state)
    changes = property(lambda self: self.named.result().changes)
    touched = property(lambda self: self.named.result().touched)


@dataclass
class Reading:
    """What a run reads: decided on narrow rows."""
    topics: DataFrame        # topic_id and header of the topics whose header is known
    posts: DataFrame         # parsed posts, of this run and of pages that waited
    take: DataFrame | None   # topic_id, page_no, src, after: pages to read and the position after which (None: all posts)
    known: DataFrame         # one row per topic: header, ledger, state, start_page, read_to, ordered
    pages: DataFrame         # one row per page: topic_id, page_no, fate (read | open | gap | headless | done)
    broken: DataFrame        # topic_id, page_no, pos, reason: what the parse could not use
    waiting: DataFrame | None
    ledger: DataFrame | None
    keeps: bool = True       # the caller keeps the pages that wait


def page_filter(p: DataFrame, state: DataFrame, ledger: DataFrame) -> DataFrame:
    """The page part of P11, before the parse: pages before the stored one are
    not read again, but for the first (the header) and those that were not full
    when they were read.  The pages to leave out are found on narrow rows; raw
    pages meet them by (topic, page), and not at all if there are none."""
    narrow = p.select("topic_key", "page_no", "domain").filter(
        (F.col("page_no") != 1) & (F.col("domain") != ARCHIVE_HOST)).distinct()      # P13, per topic
    st = state.select("topic_key", F.col("total_pages").alias("_sp"))
    op = ledger.select("topic_key", F.transform("open", lambda x: x["page_no"]).alias("_open"))
    out = narrow.join(st, "topic_key").filter(F.col("page_no") < F.col("_sp")).join(op, "topic_key", "left") \
        .filter(~F.coalesce(F.array_contains("_open", F.col("page_no")), F.lit(False))).select("topic_key", "page_no")
    return p.join(out, ["topic_key", "page_no"], "left_anti")


def prepare_pages(pages: DataFrame, state: DataFrame, cfg: CurationConfig, ledger: DataFrame | None = None) -> DataFrame:
    """S3 + U4 + J2 + page part of P11, all before the parse."""
    p = pages
    if "domain" not in p.columns:
        p = p.withColumn("domain", domain_of("link"))
    p = p.withColumn("topic_key", topic_key_of("link", cfg.page_digit_run))
    if "status" in p.columns:
        p = p.filter(X.page_outcome("domain", "status").isin(*X.PARSED))
    if cfg.use_state:
        p = page_filter(p, state, ledger if ledger is not None else L.empty_ledger(pages.sparkSession))
    return p


@dataclass
class AssetInputs:
    """Inputs of the asset stage (fetching itself happens outside Spark)."""
    manifest: DataFrame          # cached assets: file_name, url, status, final_url
    fetch_status: DataFrame      # url, status, final_url, fetch_error
    snapshots: DataFrame         # url, archive_url, snapshot_ts, status


def read_pages(ext: DataFrame, cfg: CurationConfig, state: DataFrame, ledger: DataFrame | None,
               waiting: DataFrame | None) -> Reading:
    """Which pages are read now, from the parse result, the state, the ledger
    and the pages that wait."""
    spark = ext.sparkSession
    keeps = ledger is not None and waiting is not None
    ledger = ledger if ledger is not None else L.empty_ledger(spark)
    waiting = waiting if waiting is not None else spark.createDataFrame([], X.WAITING_SCHEMA)
    topics, posts, broken = X.split(ext)
    now = materialize(X.newest_pages(ext), "pages")
    heads = topics.join(now.filter("page_no = 1").select("topic_id", "src"), ["topic_id", "src"], "left_semi") \
        .select("topic_id", *[F.col(c).alias("_" + c) for c in L.HEADER])
    seen = now.groupBy("topic_id").agg(F.min("topic_key").alias("topic_key"), F.min("domain").alias("_dom"),
                                       F.min_by("link", "page_no").alias("_any_link"))
    led = ledger.drop("topic_id")
    st = state.select("topic_key", F.col("total_pages").alias("sp"), F.col("post_cursor").alias("sc"),
                      F.col("file_path").alias("st_path"))
    ordered = F.lit(cfg.use_state) & F.coalesce(F.col("_dom") != ARCHIVE_HOST, F.lit(True)) & F.col("topic_key").isNotNull()
    known = seen.join(heads, "topic_id", "left").join(led, "topic_key", "left").join(st, "topic_key", "left") \
        .withColumn("ordered", ordered).join(L.islands(now).withColumnRenamed("pages", "_now"), "topic_id", "left")
    fresh = F.col("_topic_author").isNotNull()           # this run read the header
    old = F.when(F.col("ordered"), F.col("pages"))
    known = known.select(
        "topic_id", "topic_key", "ordered", "_any_link", "open",
        F.coalesce("_domain", "domain", "_dom").alias("domain"),
        *[F.when(fresh, F.col("_" + c)).otherwise(F.col(c)).alias(c) for c in L.HEADER if c != "domain"],
        old.alias("old_pages"), L.merged(old, "_now").alias("pages"),
        *[F.when(F.col("ordered"), F.col(c)).alias(c) for c in ("sp", "sc")], "st_path") \
        .withColumn("start_page", F.coalesce("sp", F.lit(1))) \
        .withColumn("has_header", F.col("topic_author").isNotNull())
    known = materialize(known.withColumn("read_before", L.read_to("old_pages", "start_page"))
                        .withColumn("read_to", L.read_to("pages", "start_page")), "topics")
    # pages that waited, unless they came anew
    back = waiting.join(known.filter("ordered").select("topic_id"), "topic_id", "left_semi") \
        .join(now.select("topic_id", "page_no"), ["topic_id", "page_no"], "left_anti").withColumn("src", F.lit(-1).cast("long"))
    posts = posts.unionByName(back.select(*posts.columns))
    of_pages = now.select("topic_id", "page_no", "src", (F.col("n_posts") - 1).alias("last_pos")).unionByName(
        back.groupBy("topic_id", "page_no", "src").agg(F.max("pos").alias("last_pos")))
    fate = F.when(~F.col("has_header"), "headless").when(~F.col("ordered"), "read") \
        .when(F.col("page_no") > F.col("read_to"), "gap") \
        .when(F.col("page_no") >= F.col("start_page"), "read") \
        .when(F.exists(F.coalesce("open", F.array().cast(L.LEDGER_SCHEMA["open"].dataType)),
                       lambda x: x["page_no"] == F.col("page_no")), "open").otherwise("done")
    pages = materialize(of_pages.join(known.select("topic_id", "ordered", "has_header", "read_to", "start_page", "open"),
                                      "topic_id").withColumn("fate", fate)
                        .select("topic_id", "page_no", "src", "last_pos", "ordered", "fate", "open"), "page-fates")
    was_open = F.get(F.filter(F.col("open"), lambda x: x["page_no"] == F.col("_p")), F.lit(0))["last_pos"]
    # the resume page of a topic with a ledger: full unless it is listed as open
    resume = known.filter("ordered and sp is not null").withColumn("_p", F.col("sp")).select(
        "topic_id", F.col("sp").alias("total_pages"), F.col("sc").alias("post_cursor"), F.col("read_before").alias("read_to"),
        F.when(F.col("old_pages").isNotNull(), F.coalesce(was_open, F.lit(cfg.posts_per_page - 1))).alias("last_pos"))
    after = ST.pages_after(pages.filter("fate = 'read'").withColumnRenamed("last_pos", "max_pos"), resume, cfg)
    take = pages.filter("fate = 'read'").select("topic_id", "page_no", "src").join(after, ["topic_id", "page_no"]).unionByName(
        pages.filter("fate = 'open'").withColumn("_p", F.col("page_no")).select(
            "topic_id", "page_no", "src", was_open.cast("int").alias("after")))
    held = pages.filter("ordered and fate in ('gap', 'headless')").select("topic_id", "page_no", "src")
    new_waiting = posts.join(held, ["topic_id", "page_no", "src"], "left_semi").select(*X.WAITING_COLS).unionByName(
        waiting.join(known.filter("ordered").select("topic_id"), "topic_id", "left_anti").select(*X.WAITING_COLS))
    # pages that were not full when read, or are listed so: what the ledger needs of them
    listed = F.exists(F.coalesce("open", F.array().cast(L.LEDGER_SCHEMA["open"].dataType)),
                      lambda x: x["page_no"] == F.col("page_no"))
    ragged = pages.filter(F.col("fate").isin("read", "open") & ((F.col("last_pos") < cfg.posts_per_page - 1) | listed)) \
        .groupBy("topic_id").agg(F.collect_list(F.struct("page_no", "last_pos")).alias("_read"))
    new_ledger = known.filter("ordered").join(ragged, "topic_id", "left") \
        .withColumn("open", L.open_pages("open", "_read", cfg.posts_per_page)) \
        .withColumn("link", F.when(F.col("has_header"), F.col("link"))).select(*L.LEDGER_SCHEMA.fieldNames())
    return Reading(known.filter("has_header").select("topic_id", "topic_key", *L.HEADER), posts, take, known, pages,
                   broken, new_waiting, new_ledger, keeps)


def run(spark: SparkSession, pages: DataFrame, cfg: CurationConfig, state: DataFrame | None = None,
        run_id: str = "run-0", profile_rows=None, image_targets: DataFrame | None = None,
        assets: AssetInputs | None = None, existing_stems: DataFrame | None = None,
        earlier_keys: DataFrame | None = None, ledger: DataFrame | None = None,
        waiting: DataFrame | None = None) -> RunOutputs:
    """One batch run.  ``pages(topic_id, link, page_no, html[, status,
    attempt])``; ``image_targets(page_url, full_src)`` from
    ``extract.image_targets``; ``existing_stems(file_path)``: story files already
    in the output folder (their version numbers are taken, as are those recorded
    in the state); ``earlier_keys``: the first-key index of earlier runs (used
    when ``cfg.dedup_across_runs``); ``ledger`` and ``waiting``: what earlier
    runs gave back as such.  With them, a topic's pages may come in any split
    over runs and each only once; without, the frontier lists the pages that
    wait, and the header and the resume page are needed in every run."""
    if cfg.download_images != (assets is not None):
        raise ValueError("download_images and the asset inputs go together")
    state = ST.one_per_key(state if state is not None else ST.empty_state(spark))
    p = prepare_pages(pages, state, cfg, ledger)
    # the raw pages are read once, by the parse; everything after reads its
    # written result
    ext = X.materialize(spark, X.extract(p, profile_rows), "extract")
    r = read_pages(ext, cfg, state, ledger, waiting)
    return finish(r, cfg, state, run_id, image_targets, assets, existing_stems, earlier_keys)


def select_and_edit(r: Reading, cfg: CurationConfig, image_targets: DataFrame | None, assets: AssetInputs | None,
                    earlier: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(verdicts of the posts read, kept posts with their images edited)."""
    # narrow, per post; written once, as every table of the run follows from it
    verdict = materialize(SEL.selection_verdicts(r.posts, r.topics, cfg, earlier, r.take), "verdicts")
    posts = r.posts
    if cfg.replace_video_frames:
        posts = posts.withColumn("content_html", F.when(F.col("domain") == ARCHIVE_HOST, X.replace_video_frames())
                                 .otherwise(F.col("content_html")))
    kept = SEL.attach_verdicts(posts, SEL.story_posts(verdict)).drop("src") \
        .withColumn("excerpt", excerpt("paragraphs"))              # U12 (the "chapter added" line)
    if cfg.resize_images:                                         # U16 (+ J5 where targets are given)
        kept = A.apply_image_edits(kept, A.fullsize_edits(kept, image_targets))
    if cfg.download_images:                                       # A6, J3, J4, U15
        refs = A.image_refs(kept)
        inv = A.inventory(refs)
        fetched = A.resolve_missing(A.missing_assets(inv, assets.manifest), assets.fetch_status, assets.snapshots)
        names = assets.manifest.select("file_name").unionByName(fetched.select("file_name")).distinct() \
            .withColumn("_ok", F.lit(True))
        stored = refs.select("url", "file_name").distinct() \
            .join(fetched.select("url", F.col("file_name").alias("_f")), "url", "left") \
            .join(names, "file_name", "left") \
            .select("url", F.coalesce("_f", F.when(F.col("_ok"), F.col("file_name"))).alias("file_name")) \
            .filter(F.col("file_name").isNotNull())
        kept = A.apply_image_edits(kept, A.localize_edits(kept, stored, cfg))
    return verdict, kept


def story_names(topics: DataFrame, active: DataFrame, known: DataFrame, state: DataFrame, cfg: CurationConfig,
                existing_stems: DataFrame | None) -> DataFrame:
    """U20 + W6 + S11: ``topic_id, topic_key, st_path, file_path`` of the topics
    with new posts; a story that has a file keeps it."""
    t = topics.join(active, "topic_id").join(known.select("topic_id", "st_path"), "topic_id") \
        .withColumn("slug", F.concat_ws("-", slugify("topic_author"), slugify("title", title=True, tag=cfg.story_tag)))
    t = materialize(t, "active-topics")
    stems = state.select("file_path")
    if existing_stems is not None:
        stems = stems.unionByName(existing_stems.select("file_path"))
    used = stems.select(F.regexp_extract("file_path", r"^(.*)-(\d+)$", 1).alias("slug"),
                        F.regexp_extract("file_path", r"^(.*)-(\d+)$", 2).cast("long").alias("version")) \
        .filter(F.col("slug") != "")
    new_t = t.filter(F.col("st_path").isNull() | F.lit(not cfg.use_state)).select("slug", "topic_id")
    versions = R.version_numbers(new_t, used, order="topic_id")
    return materialize(t.join(versions.select("topic_id", "version"), "topic_id", "left").withColumn(
        "file_path", F.coalesce(F.when(F.lit(cfg.use_state), F.col("st_path")),
                                F.concat_ws("-", "slug", F.col("version").cast("string")))), "story-names")


def finish(r: Reading, cfg: CurationConfig, state: DataFrame, run_id: str,
           image_targets: DataFrame | None = None, assets: AssetInputs | None = None,
           existing_stems: DataFrame | None = None, earlier_keys: DataFrame | None = None,
           wait: bool = True) -> RunOutputs:
    """Selection, rendering and the tables of a run from what it reads.  The
    stories are named by a thread of their own; without ``wait`` a caller that
    writes all tables can begin with those that need no names."""
    earlier = None
    if cfg.dedup_across_runs and earlier_keys is not None:
        earlier = earlier_keys.join(r.topics.select("topic_id", "topic_key"), "topic_key").select("topic_id", "kind", "key")
    verdict, kept = select_and_edit(r, cfg, image_targets, assets, earlier)
    counters = SEL.topic_counters(verdict, cfg)
    rejects = verdict.filter(~F.col("kept")).select("topic_id", "page_no", "pos", "reject_reason")
    # With state on, a topic without new posts keeps story and state
    active = counters.filter((F.col("posts_kept") > 0) | F.lit(not cfg.use_state)).select("topic_id")

    def names() -> Named:
        t = story_names(r.topics, active, r.known, state, cfg, existing_stems)
        touched = t.select(F.col("topic_id").alias("story_key"), "file_path",
                           F.when(F.col("st_path").isNotNull() & F.lit(cfg.use_state), "append")
                           .otherwise("create").alias("mode"))
        changes = state_changes(t, r.known, verdict, cfg)
        stories = R.render_chunks(kept).withColumn("run_id", F.lit(run_id)) \
            .join(t.select(F.col("topic_id").alias("story_key")), "story_key", "left_semi")
        return Named(stories, ST.upsert_state(state, changes, unique=True) if cfg.use_state else state, changes, touched)

    with_names = ThreadPoolExecutor(max_workers=1)
    named = with_names.submit(inheritable_thread_target(names))
    with_names.shutdown(wait=wait)
    if wait:
        named.result()
    keys = SEL.kept_keys(verdict).join(r.topics.select("topic_id", "topic_key"), "topic_id") \
        .select("topic_key", "kind", "key", "ord")
    return RunOutputs(
        kept, rejects, counters.withColumn("run_date", F.current_date()).withColumn("run_id", F.lit(run_id)),
        quarantined(r, cfg), to_crawl(r, cfg), keys, r.ledger, r.waiting, named)


def state_changes(names: DataFrame, known: DataFrame, verdict: DataFrame, cfg: CurationConfig) -> DataFrame:
    """A4 + S7: the state rows of the topics with new posts: the page up to
    which a topic is read, and the position of the last kept post on it (0 as
    coded, else -1, where it has none)."""
    none = F.lit(0 if cfg.resume_as_coded else -1)
    last = verdict.filter("kept").groupBy("topic_id").agg(F.max(F.struct("page_no", "pos")).alias("_l"))
    j = names.join(known.filter("ordered").select("topic_id", "read_to", "sp", "sc"), "topic_id").join(last, "topic_id", "left")
    cursor = F.when(F.col("_l.page_no") == F.col("read_to"), F.col("_l.pos")) \
        .when(F.col("sp") == F.col("read_to"), F.col("sc"))
    if cfg.resume_as_coded and cfg.all_posts:
        cursor = F.lit(0)       # as coded, all-posts mode never marks a page as having added a post
    return j.select("topic_key", "title", F.col("link").alias("page_link"), "file_path",
                    F.col("read_to").alias("total_pages"), F.coalesce(cursor, none).cast("int").alias("post_cursor")) \
        .filter(F.lit(cfg.use_state))


def quarantined(r: Reading, cfg: CurationConfig) -> DataFrame:
    """Rows that can't be used, and the pages that wait (with the reason)."""
    none = F.lit(None).cast("int")
    wait = r.pages.filter(F.col("fate").isin("gap", "headless")).select(
        "topic_id", "page_no", none.alias("pos"),
        F.when(F.col("fate") == "gap", "page_gap").otherwise("header_page_missing").alias("reason")).distinct()
    out = r.broken.unionByName(wait)
    if cfg.use_state:
        out = out.unionByName(r.known.filter("topic_key is null").select(
            "topic_id", none.alias("page_no"), none.alias("pos"), F.lit("topic_key_missing").alias("reason")))
    return out


def to_crawl(r: Reading, cfg: CurationConfig) -> DataFrame:
    """G1 + U2/U3 + U18: the pages that the crawl has not delivered, from the
    resume page to the header's count (those that wait, too, if nobody keeps
    them); a topic without header needs page 1."""
    none = F.array().cast(L.LEDGER_SCHEMA["pages"].dataType)
    have = F.col("pages")
    if not r.keeps:
        read = F.array(F.struct(F.col("start_page").alias("lo"), F.col("read_to").alias("hi")))
        have = F.when(F.col("ordered"), F.when(F.col("read_to") >= F.col("start_page"), read).otherwise(none)).otherwise(have)
    head = r.known.filter("has_header").select("topic_id", "link", "domain", "start_page", "total_pages", have.alias("pages"))
    head = L.missing_pages(head).select("topic_id", "page_no", "link", "domain")
    bare = r.known.filter(~F.col("has_header")).select("topic_id", F.lit(1).alias("page_no"),
                                                       F.col("_any_link").alias("link"), "domain")
    return head.unionByName(bare).select(
        "topic_id", "page_no", topic_page_link("link", "page_no", "domain", cfg.page_digit_run).alias("page_link"))
