"""End-to-end: forum pages (site A layout) -> stories, state, metrics; then a
resumed run on newly crawled pages."""

from pyspark.sql import functions as F

from threadsmith.config import CurationConfig
from threadsmith.functions import html as H
from threadsmith.plans import curate

LINK = "https://www.jeuxvideo.com/forums/42-51-67052724-1-0-1-0-mon-histoire.htm"
LONG = "Lorem ipsum dolor sit amet " * 50


def post(author, body):
    return (f'<div class="conteneur-message"><div class="bloc-header"><span> {author} </span>'
            f'<div class="bloc-pseudo-msg">{author}</div></div>'
            f'<div class="txt-msg text-enrichi-forum">{body}</div></div>')


def page(posts, total):
    pager = "".join(f"<span>{i}</span>" for i in range(1, total + 1))
    return (f"<html><head><title>Mon histoire</title></head><body>"
            f'<div id="bloc-title-forum">[Risitas] Mon histoire</div>'
            f'<div class="bloc-liste-num-page">{pager}</div>{"".join(posts)}</body></html>')


IMG = '<img class="img-shack" src="https://image.noelshack.com/minis/a{0}.png" alt="https://www.noelshack.com/fichiers/a{0}.png" width="68" height="51">'
P1 = [post("pogo12", f"<p>Chapitre 1</p><p>{LONG}</p>"),
      post("other", "<p>lol</p>"),
      post("pogo12", "<p>merci</p>"),
      post("pogo12", f"<blockquote>cite</blockquote><p>{LONG}</p>"),
      post("pogo12", f"<p>chapitre 1</p><p>{LONG}</p>")]
P2 = [post("pogo12", f"<p>Chapitre 2</p><p>{LONG}</p>"),
      post("pogo99", f"<p>Chapitre 3</p><p>{LONG}</p>"),
      post("pogo12", "<p>screen</p>" + "".join(IMG.format(i) for i in range(3)))]


def pages_df(spark, rows):
    return spark.createDataFrame(
        [("t1", LINK.replace("-1-0-1-0", f"-{n}-0-1-0"), n, 200, h) for n, h in rows],
        "topic_id string, link string, page_no int, status int, html string")


def test_parser_on_forum_page():
    root = H.parse(page(P2, 2))
    assert len(H.select(root, ".conteneur-message")) == 3
    assert H.select_one(root, ".bloc-liste-num-page > span:nth-last-of-type(1)").text() == "2"


def test_first_and_resumed_run(spark):
    cfg = CurationConfig()
    out = curate.run(spark, pages_df(spark, [(1, page(P1, 2)), (2, page(P2, 2))]), cfg, run_id="r1")
    kept = sorted((r.page_no, r.pos, r.is_image) for r in out.story_posts.collect())
    assert kept == [(1, 0, False), (2, 0, False), (2, 1, False), (2, 2, True)]
    assert sorted(r.excerpt for r in out.story_posts.collect() if r.page_no == 2) == ["Chapitre 2", "Chapitre 3", "screen"]
    reasons = {(r.page_no, r.pos): r.reject_reason for r in out.rejects.collect()}
    assert reasons == {(1, 1): "author", (1, 2): "short", (1, 3): "quote", (1, 4): "duplicate"}
    m = out.metrics.first()
    assert (m.posts_kept, m.duplicates) == (4, 1)
    st = out.state.collect()
    assert len(st) == 1 and (st[0].total_pages, st[0].post_cursor) == (2, 2)
    assert st[0].file_path == "pogo12-mon-histoire-0"
    assert st[0].topic_key == "https://www.jeuxvideo.com/forums/42-51-67052724-"
    html = "".join(r.html for r in out.stories.orderBy("chunk_no").collect())
    assert html.index("Chapitre 1") < html.index("Chapitre 2") < html.index("Chapitre 3")
    assert [r.mode for r in out.touched.collect()] == ["create"]
    state1 = spark.createDataFrame(out.state.collect(), out.state.schema)

    # second run: page 2 gained a post, page 3 is new; page 1 is read for the header only
    p2b = P2 + [post("pogo12", f"<p>Chapitre 4</p><p>{LONG}</p>")]
    p3 = [post("pogo12", f"<p>Chapitre 5</p><p>{LONG}</p>")]
    out2 = curate.run(spark, pages_df(spark, [(1, page(P1, 3)), (2, page(p2b, 3)), (3, page(p3, 3))]),
                      cfg, state=state1, run_id="r2")
    kept2 = sorted((r.page_no, r.pos) for r in out2.story_posts.collect())
    assert kept2 == [(2, 3), (3, 0)]
    st2 = out2.state.collect()
    assert (st2[0].total_pages, st2[0].post_cursor, st2[0].file_path) == (3, 0, "pogo12-mon-histoire-0")
    assert [r.mode for r in out2.touched.collect()] == ["append"]


def test_all_posts_and_no_state(spark):
    cfg = CurationConfig(all_posts=True, use_state=False)
    out = curate.run(spark, pages_df(spark, [(1, page(P1, 2)), (2, page(P2, 2))]), cfg)
    kept = sorted((r.page_no, r.pos) for r in out.story_posts.collect())
    assert kept == [(1, 0), (1, 2), (1, 3), (1, 4), (2, 0), (2, 1), (2, 2)]
    assert out.metrics.first().duplicates is None


def test_unsupported_and_status(spark):
    df = spark.createDataFrame(
        [("t9", "https://example.org/a/1-2-3-4", 1, 200, "<html></html>"),
         ("t1", LINK, 1, None, page(P1, 1))],
        "topic_id string, link string, page_no int, status int, html string")
    out = curate.run(spark, df, CurationConfig())
    q = [(r.topic_id, r.reason) for r in out.quarantine.collect()]
    assert q == [("t9", "unsupported_domain")]
    assert out.story_posts.count() == 0


def test_extra_author_and_exact_match(spark):
    posts = P1[:1] + [post("ProlEtendard", f"<p>Chapitre 2</p><p>{LONG}</p>"),
                      post("pogo99", f"<p>Chapitre 3</p><p>{LONG}</p>")]
    df = pages_df(spark, [(1, page(posts, 1))])
    kept = lambda cfg: sorted(r.pos for r in curate.run(spark, df, cfg).story_posts.collect())
    assert kept(CurationConfig(use_state=False)) == [0, 2]                       # root match pogo
    assert kept(CurationConfig(use_state=False, extra_authors=("ProlEtendard",))) == [0, 1, 2]
    assert kept(CurationConfig(use_state=False, match_author_root=False)) == [0]  # exact only


def test_file_versions_skip_existing(spark):
    df = pages_df(spark, [(1, page(P1, 1))])
    stems = spark.createDataFrame([("pogo12-mon-histoire-0",), ("pogo12-mon-histoire-2",)], "file_path string")
    out = curate.run(spark, df, CurationConfig(use_state=False), existing_stems=stems)
    assert [r.file_path for r in out.touched.collect()] == ["pogo12-mon-histoire-1"]


def test_ragged_resume_page_modes(spark):
    first = curate.run(spark, pages_df(spark, [(1, page(P1, 2)), (2, page(P2, 2))]), CurationConfig(), run_id="r1")
    state = spark.createDataFrame(first.state.collect(), first.state.schema)       # page 2, cursor 2
    p3 = [post("pogo12", f"<p>Chapitre 5</p><p>{LONG}</p>")]
    crawl = pages_df(spark, [(1, page(P1, 3)), (2, page(P2, 3)), (3, page(p3, 3))])
    coded = curate.run(spark, crawl, CurationConfig(), state=state)
    assert coded.story_posts.count() == 0                     # the 3-post page carries the skip
    assert [(r.total_pages, r.post_cursor) for r in coded.state.collect()] == [(2, 2)]   # untouched
    intent = curate.run(spark, crawl, CurationConfig(resume_as_coded=False), state=state)
    assert sorted((r.page_no, r.pos) for r in intent.story_posts.collect()) == [(3, 0)]


def test_missing_header_page_quarantined(spark):
    out = curate.run(spark, pages_df(spark, [(2, page(P2, 2))]), CurationConfig(use_state=False))
    assert [(r.topic_id, r.reason) for r in out.quarantine.collect()] == [("t1", "header_page_missing")]
    assert out.story_posts.count() == 0


ARCHIVE_LINK = "https://web.archive.org/web/2019/https://blog.example/1/2/3/story/"


def arch_post(author, body):
    return f'<div class="entry-content"><h2>Story</h2><p><a>{author}</a></p><div class="txt-msg text-enrichi-forum">{body}</div></div>'


def test_archive_topic_no_author_check_no_state(spark):
    html = ("<html><head><title>t</title></head><body>"
            + arch_post("writer", f"<p>Chapitre 1</p><p>{LONG}</p>")
            + arch_post("someone else", f"<p>Chapitre 2</p><p>{LONG}</p>")
            + arch_post("writer", "<p>short</p>") + "</body></html>")
    df = spark.createDataFrame([("a1", ARCHIVE_LINK, 1, 200, html)],
                               "topic_id string, link string, page_no int, status int, html string")
    out = curate.run(spark, df, CurationConfig())
    assert sorted(r.pos for r in out.story_posts.collect()) == [0, 1]          # P2: author not enforced
    assert out.state.count() == 0                                              # P13: archive keeps no state
    assert [r.mode for r in out.touched.collect()] == ["create"]


def test_frontier_lists_missing_pages(spark):
    # header says 3 pages, the crawl delivered pages 1 and 3
    out = curate.run(spark, pages_df(spark, [(1, page(P1, 3)), (3, page(P2, 3))]), CurationConfig(use_state=False))
    got = [(r.page_no, r.page_link) for r in out.frontier.collect()]
    assert got == [(2, LINK.replace("-1-0-1-0", "-2-0-1-0"))]


def test_dedup_across_runs(spark):
    r1 = curate.run(spark, pages_df(spark, [(1, page(P1, 2)), (2, page(P2, 2))]), CurationConfig(), run_id="r1")
    state = spark.createDataFrame(r1.state.collect(), r1.state.schema)
    keys = spark.createDataFrame(r1.kept_keys.collect(), r1.kept_keys.schema)
    repeat = P2 + [post("pogo12", f"<p>chapitre 2</p><p>{LONG}</p>")]      # repeats a chapter of run 1
    crawl = pages_df(spark, [(1, page(P1, 2)), (2, page(repeat, 2))])
    as_coded = curate.run(spark, crawl, CurationConfig(), state=state, earlier_keys=keys)
    assert sorted((r.page_no, r.pos) for r in as_coded.story_posts.collect()) == [(2, 3)]   # kept: fresh run
    across = curate.run(spark, crawl, CurationConfig(dedup_across_runs=True), state=state, earlier_keys=keys)
    assert across.story_posts.count() == 0
    assert [r.reject_reason for r in across.rejects.collect() if r.page_no == 2 and r.pos == 3] == ["duplicate"]


def test_batch_equals_incremental_with_cross_run_dedup(spark):
    import random
    rnd = random.Random(5)
    texts = [f"<p>Chapitre {i}</p><p>{LONG}</p>" for i in range(6)] + ["<p>merci</p>"]
    pages = []
    for pg in range(1, 4):                                    # full pages: 20 posts each
        posts = [post(rnd.choice(["pogo12", "pogo77", "other"]), rnd.choice(texts)) for _ in range(20)]
        pages.append((pg, posts))
    cfg = CurationConfig(dedup_across_runs=True, resume_as_coded=False)
    full = [(pg, page(ps, 3)) for pg, ps in pages]
    batch = curate.run(spark, pages_df(spark, full), cfg)
    expected = sorted((r.page_no, r.pos) for r in batch.story_posts.collect())
    for k in (1, 2):
        first = [(pg, page(ps, k)) for pg, ps in pages[:k]]
        r1 = curate.run(spark, pages_df(spark, first), cfg, run_id="r1")
        st = spark.createDataFrame(r1.state.collect(), r1.state.schema)
        keys = spark.createDataFrame(r1.kept_keys.collect(), r1.kept_keys.schema)
        r2 = curate.run(spark, pages_df(spark, full), cfg, state=st, earlier_keys=keys, run_id="r2")
        got = sorted([(r.page_no, r.pos) for r in r1.story_posts.collect()]
                     + [(r.page_no, r.pos) for r in r2.story_posts.collect()])
        assert got == expected, k
