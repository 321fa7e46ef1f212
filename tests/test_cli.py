"""Command-line runner: run, resume, export, clear."""

import os
import shutil

from threadsmith import cli
from threadsmith.operators import state as ST
from threadsmith.sources import stories as SS
from tests.test_pipeline import LONG, P1, P2, page, pages_df, post


def test_run_resume_clear(spark, tmp_path):
    out = str(tmp_path / "out")
    p1 = str(tmp_path / "crawl1")
    pages_df(spark, [(1, page(P1, 2)), (2, page(P2, 2))]).write.parquet(p1)
    assert cli.main(["run", "--pages", p1, "--out", out], spark=spark) == 0
    p2 = str(tmp_path / "crawl2")
    p2b = P2 + [post("pogo12", f"<p>Chapitre 4</p><p>{LONG}</p>")]
    p3 = [post("pogo12", f"<p>Chapitre 5</p><p>{LONG}</p>")]
    pages_df(spark, [(1, page(P1, 3)), (2, page(p2b, 3)), (3, page(p3, 3))]).write.parquet(p2)
    cli.main(["run", "--pages", p2, "--out", out], spark=spark)
    st = ST.read_state(spark, f"{out}/state").collect()
    assert [(r.total_pages, r.post_cursor) for r in st] == [(3, 0)]
    cli.main(["export", "--out", out], spark=spark)
    assert os.listdir(f"{out}/export") == ["pogo12-mon-histoire-0.html"]
    html = open(f"{out}/export/pogo12-mon-histoire-0.html", encoding="utf-8").read()
    assert html.index("Chapitre 1") < html.index("Chapitre 3") < html.index("Chapitre 4") < html.index("Chapitre 5")
    assert html.count("<!DOCTYPE html>") == 1
    cli.main(["clear", "--out", out], spark=spark)
    assert ST.read_state(spark, f"{out}/state").count() == 0


def _posts(spark, out, store=None):
    """(story, page, position) of every post in a committed story."""
    runs = SS.StoryStore(spark, f"{out}/story_table").runs()
    return sorted((r.story, r.page_no, r.pos) for r in spark.read.parquet(f"{out}/story_posts").collect() if r.run_seq in runs)


def _written(spark, out):
    return sorted((r.story, r.chunk_no, r.n_posts) for r in SS.StoryStore(spark, f"{out}/story_table").chunks().collect())


def test_run_again_leaves_every_post_once(spark, tmp_path):
    src = str(tmp_path / "crawl")
    pages_df(spark, [(1, page(P1, 2)), (2, page(P2, 2))]).write.parquet(src)
    once = [("pogo12-mon-histoire-0", 1, 1), ("pogo12-mon-histoire-0", 2, 3)]
    # with state: the second run finds nothing new
    out = str(tmp_path / "state")
    for _ in range(2):
        cli.main(["run", "--pages", src, "--out", out], spark=spark)
        assert _written(spark, out) == once
    # ended after the chunks and before the state: the next run replaces its part
    out = str(tmp_path / "killed")
    cli.main(["run", "--pages", src, "--out", out], spark=spark)
    shutil.rmtree(f"{out}/state")
    shutil.rmtree(f"{out}/ledger")
    cli.main(["run", "--pages", src, "--out", out], spark=spark)
    assert _written(spark, out) == once and len(_posts(spark, out)) == 4
    # without state every run makes a story of its own (as the original tool
    # does), and a run of the same name replaces its own
    out = str(tmp_path / "none")
    for _ in range(2):
        cli.main(["run", "--pages", src, "--out", out, "--no-database", "--run-id", "a"], spark=spark)
        assert _written(spark, out) == once
    cli.main(["run", "--pages", src, "--out", out, "--no-database"], spark=spark)
    assert _written(spark, out) == once + [("pogo12-mon-histoire-1", c, n) for _, c, n in once]
    posts = _posts(spark, out)
    assert len(posts) == len(set(posts)) == 8
    # the session keeps its settings
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "STATIC"
