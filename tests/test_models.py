"""Closed forms (aggregates/joins) vs. small sequential models of the rules.

Many random topics are generated and checked in one Spark job per rule."""

import random

from pyspark.sql import functions as F

from threadsmith.config import CurationConfig
from threadsmith.operators import dedup as D
from threadsmith.operators import state as ST

TEXTS = ["alpha", "ALPHA", "beta", "gamma", "Alpha!", "x" * 100 + "tail1", "X" * 100 + "tail2"]
IMGS = ["<img a>", "<img b>"]


def key(t):
    return t[:100].lower()


def model_dedup(cands, as_coded, resize):
    """cands: list of (text, is_img, html) in order -> list of is_dup."""
    kept_texts, kept_imgs, out = [], [], []
    for text, img, html in cands:
        if not kept_texts:
            dup = False
        elif img:
            dup = False if (as_coded and resize) else any(html == k for k in kept_imgs)
        elif as_coded:
            ref = kept_texts[0] if len(kept_texts) == 1 else kept_texts[1]
            dup = key(text) == key(ref)
        else:
            dup = any(key(text) == key(k) for k in kept_texts)
        out.append(dup)
        if not dup:
            kept_texts.append(text)
            if img:
                kept_imgs.append(html)
    return out


def gen_topics(n, seed):
    rnd = random.Random(seed)
    rows, topics = [], {}
    for t in range(n):
        cands = []
        for i in range(rnd.randint(1, 9)):
            img = rnd.random() < 0.25
            text = rnd.choice(TEXTS)
            html = rnd.choice(IMGS) if img else text
            cands.append((text, img, html))
            rows.append((t, 1 + i // 3, i % 3, text, html, img))
        topics[t] = cands
    return rows, topics


def test_dedup_modes(spark):
    rows, topics = gen_topics(400, 7)
    df = spark.createDataFrame(rows, "topic_id long, page_no int, pos int, content_text string, "
                                     "content_html string, img_post boolean")
    for as_coded in (False, True):
        for resize in (True, False):
            cfg = CurationConfig(dedup_as_coded=as_coded, resize_images=resize)
            got = {(r.topic_id, r.page_no, r.pos): r.is_dup for r in D.duplicate_verdicts(df, cfg).collect()}
            for t, cands in topics.items():
                exp = model_dedup(cands, as_coded, resize)
                have = [got[(t, 1 + i // 3, i % 3)] for i in range(len(cands))]
                assert have == exp, (as_coded, resize, t, cands, have, exp)


def model_resume(page_sizes, st_page, cursor, ppp):
    """Posts read on resume: iterate pages from st_page with the skip flag."""
    out, past = [], False
    for page in range(st_page, len(page_sizes) + 1):
        for pos in range(page_sizes[page - 1]):
            skip = False
            if not past:
                if pos <= cursor:
                    if pos == ppp - 1:
                        past = True
                    skip = True
                else:
                    past = True
            if not skip:
                out.append((page, pos))
    return out


def test_resume_filter_ragged(spark):
    rnd = random.Random(3)
    ppp = 5
    rows, st_rows, exp = [], [], {}
    for t in range(300):
        sizes = [rnd.randint(1, ppp) for _ in range(rnd.randint(1, 5))]
        st_page = rnd.randint(1, len(sizes))
        cursor = rnd.randint(0, ppp - 1)
        for pg, n in enumerate(sizes, 1):
            rows += [(t, pg, p) for p in range(n)]
        st_rows.append((t, st_page, cursor))
        exp[t] = model_resume(sizes, st_page, cursor, ppp)
    posts = spark.createDataFrame(rows, "topic_id long, page_no int, pos int")
    st = spark.createDataFrame(st_rows, "topic_id long, total_pages int, post_cursor int")
    got = {}
    for r in ST.resume_filter(posts, st, CurationConfig(posts_per_page=ppp)).collect():
        got.setdefault(r.topic_id, []).append((r.page_no, r.pos))
    for t, e in exp.items():
        assert sorted(got.get(t, [])) == e, (t, e, got.get(t))


def test_cursor_advance(spark):
    rows = [  # topic, page, pos, kept
        (1, 1, 0, True), (1, 2, 0, False), (1, 2, 3, True), (1, 2, 5, False),
        (2, 1, 4, True), (2, 2, 1, False),
        (3, 1, 0, False), (3, 3, 0, True),
    ]
    df = spark.createDataFrame(rows, "topic_id long, page_no int, pos int, kept boolean")
    got = {r.topic_id: (r.total_pages, r.post_cursor) for r in ST.cursor_advance(df, CurationConfig()).collect()}
    assert got == {1: (2, 3), 2: (2, 0), 3: (3, 0)}
    got = {r.topic_id: r.post_cursor for r in ST.cursor_advance(df, CurationConfig(resume_as_coded=False)).collect()}
    assert got == {1: 3, 2: -1, 3: 0}


def test_frontier_and_upsert(spark):
    t = spark.createDataFrame([(1, 3, 5), (2, 5, 3), (3, 4, 4)], "topic_id long, start_page int, total_pages int")
    got = sorted((r.topic_id, r.page_no) for r in ST.frontier(t).collect())
    assert got == [(1, 3), (1, 4), (1, 5), (3, 4)]
    old = spark.createDataFrame([("a", "t", "l", "f", 3, 1), ("b", "t", "l", "f", 2, 0)], ST.STATE_SCHEMA)
    new = spark.createDataFrame([("b", "t2", "l2", "f", 5, 7), ("c", "t3", "l3", "g", 1, 0)], ST.STATE_SCHEMA)
    got = {r.topic_key: (r.title, r.total_pages, r.post_cursor) for r in ST.upsert_state(old, new).collect()}
    assert got == {"a": ("t", 3, 1), "b": ("t2", 5, 7), "c": ("t3", 1, 0)}


def test_state_versions(spark, tmp_path):
    base = str(tmp_path / "state")
    assert ST.read_state(spark, base).count() == 0
    s = spark.createDataFrame([("a", "t", "l", "f", 3, 1)], ST.STATE_SCHEMA)
    ST.write_state(s, base, 1)
    ST.write_state(ST.upsert_state(ST.read_state(spark, base), s.withColumn("post_cursor", F.lit(4))), base, 2)
    assert [r.post_cursor for r in ST.read_state(spark, base).collect()] == [4]
    ST.clear_state(spark, base)
    assert ST.read_state(spark, base).count() == 0


def test_version_numbers(spark):
    from threadsmith.operators.render import version_numbers
    used = spark.createDataFrame([("s1", 0), ("s1", 1), ("s2", 0), ("s2", 2)], "slug string, version long")
    new = spark.createDataFrame([("s1", 10), ("s2", 11), ("s2", 12), ("s2", 13), ("s3", 14)], "slug string, link_no long")
    got = {r.link_no: r.version for r in version_numbers(new, used).collect()}
    assert got == {10: 2, 11: 1, 12: 3, 13: 4, 14: 0}


def test_cursor_all_posts_mode(spark):
    df = spark.createDataFrame([(1, 1, 0, True), (1, 2, 3, True)], "topic_id long, page_no int, pos int, kept boolean")
    got = [(r.total_pages, r.post_cursor) for r in ST.cursor_advance(df, CurationConfig(all_posts=True)).collect()]
    assert got == [(2, 0)]


def test_version_numbers_random(spark):
    from threadsmith.operators.render import version_numbers
    rnd = random.Random(9)
    used_rows, new_rows, exp = [], [], {}
    link = 0
    for sl in range(12):
        slug = f"s{sl}"
        used = sorted(set(rnd.sample(range(40), rnd.randint(0, 25))) | ({0, 1, 2, 3} if sl % 3 == 0 else set()))
        used_rows += [(slug, v) for v in used]
        free = (v for v in range(10_000) if v not in set(used))
        for _ in range(rnd.randint(0, 15)):
            exp[link] = next(free)
            new_rows.append((slug, link))
            link += 1
    new = spark.createDataFrame(new_rows, "slug string, link_no long")
    used = spark.createDataFrame(used_rows, "slug string, version long")
    got = {r.link_no: r.version for r in version_numbers(new, used).collect()}
    assert got == exp
