"""Structured Streaming ingest: multi-batch, re-delivery, resume via state."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from threadsmith.config import CurationConfig
from threadsmith.streaming import ingest, topics
from tests.conftest import SF0001
from tests.test_pipeline import LONG, P1, P2, page, pages_df, post


def test_event_ingest_batches_and_redelivery(spark, tmp_path):
    ev = spark.read.parquet(f"{SF0001}/events.parquet")
    landing = str(tmp_path / "landing")
    parts = ev.randomSplit([1.0, 1.0, 1.0], seed=5)
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(f"{landing}/f{i}")
    parts[1].coalesce(1).write.parquet(f"{landing}/f9")          # re-delivered rows
    exp = {r.user_id: (r.n, r.t) for r in ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("t")).collect()}
    out = ingest.event_ingest(spark, landing + "/*", None, base=str(tmp_path / "out"), max_files=1)
    assert {r.user_id: (r.n_posts, r.last_ts) for r in out.collect()} == exp
    # bounded dedup state: the re-delivered copies are within a 60-day watermark
    out = ingest.event_ingest(spark, landing + "/*", None, base=str(tmp_path / "out2"), max_files=1,
                              dedup_within="60 days")
    assert {r.user_id: (r.n_posts, r.last_ts) for r in out.collect()} == exp


def test_page_ingest_two_batches(spark, tmp_path):
    landing, base = str(tmp_path / "landing"), str(tmp_path / "out")
    first = pages_df(spark, [(1, page(P1, 2)), (2, page(P2, 2))])
    first.write.parquet(f"{landing}/b0")
    cfg = CurationConfig()
    ingest.page_ingest(spark, landing + "/*", first.schema, base, cfg)
    p2b = P2 + [post("pogo12", f"<p>Chapitre 4</p><p>{LONG}</p>")]
    p3 = [post("pogo12", f"<p>Chapitre 5</p><p>{LONG}</p>")]
    pages_df(spark, [(1, page(P1, 3)), (2, page(p2b, 3)), (3, page(p3, 3))]).write.parquet(f"{landing}/b1")
    ingest.page_ingest(spark, landing + "/*", first.schema, base, cfg)
    kept = sorted((r.batch_id, r.page_no, r.pos) for r in spark.read.parquet(f"{base}/story_posts").collect())
    assert kept == [(0, 1, 0), (0, 2, 0), (0, 2, 1), (0, 2, 2), (1, 2, 3), (1, 3, 0)]
    from threadsmith.operators.state import read_state
    st = read_state(spark, f"{base}/state").collect()
    assert [(r.total_pages, r.post_cursor) for r in st] == [(3, 0)]


def test_late_pages_are_reported_by_a_timer(spark, tmp_path):
    """A running query with a limit reports a page that still waits; a run of
    what is available has no timers."""
    landing, base = str(tmp_path / "landing"), str(tmp_path / "out")
    df = pages_df(spark, [(1, page(P1, 3)), (3, page(P2, 3))])
    df.coalesce(1).write.parquet(f"{landing}/b0")
    with pytest.raises(ValueError):
        ingest.page_ingest(spark, landing + "/*", df.schema, base, CurationConfig(), wait_limit_s=1)
    q = ingest.page_ingest(spark, landing + "/*", df.schema, base, CurationConfig(), every="1 second", wait_limit_s=1)
    reasons, end = set(), time.time() + 90
    try:
        while "page_gap_late" not in reasons and time.time() < end:
            time.sleep(2)
            done = [d for d in glob.glob(f"{base}/quarantine/batch_id=*") if os.path.exists(f"{d}/_SUCCESS")]
            reasons = {r.reason for r in spark.read.parquet(*done).collect()} if done else set()
    finally:
        q.stop()
    assert reasons == {"page_gap", "page_gap_late"}


def test_record_of_a_topic():
    """The state's logic against a plain list of what has come."""
    rnd = random.Random(6)
    for _ in range(200):
        rec, waiting, taken, sizes = topics.Record({"domain": "a"}, 5), {}, {}, {p: rnd.randint(0, 5) for p in range(1, 9)}
        order = [p for p in range(1, 9) for _ in range(rnd.randint(1, 2))]
        rnd.shuffle(order)
        for p in order:
            n = rnd.randint(0, sizes[p])                    # a page may come before it is full
            rec.take_header({k: None for k in rec.head} | {"domain": "a", "topic_author": "x" if p == 1 else None})
            waiting[p] = max(n, waiting.get(p, 0))
            for w in sorted(waiting):
                if rec.may_read(w):
                    after = rec.read(w, waiting[w] - 1)
                    if after is not None:
                        taken.setdefault(w, []).extend(range(after + 1, waiting[w]))
                    del waiting[w]
            rec = topics.Record(rec.stored(), 5)
        assert all(posts == list(range(len(posts))) for posts in taken.values())     # each once, none left out
        assert sorted(taken) == list(range(1, len(taken) + 1)) and rec.read_to == 8 and not waiting
