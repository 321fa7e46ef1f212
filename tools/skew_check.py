"""Skew experiment: one topic holds a third of all posts.

Runs the selection + render plan and, for comparison, a naive plan that
ranks posts with a window partitioned by topic, with Spark's event log
written to a scratch folder; prints per-stage task balance (max / median
records read per task) from the log.

    python tools/skew_check.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from threadsmith.config import CurationConfig  # noqa: E402
from threadsmith.operators import render as R  # noqa: E402
from threadsmith.operators import select as SEL  # noqa: E402
from threadsmith.plans.adapters import document_posts, table  # noqa: E402
from threadsmith.session import build_session  # noqa: E402


def stage_balance(log_dir: str):
    """{stage id: (job group, [records read per task])} from the event log."""
    files = [f for f in glob.glob(f"{log_dir}/**/*", recursive=True) if os.path.isfile(f)]
    stages: dict[int, list[int]] = {}
    group: dict[int, str] = {}
    for f in sorted(files):
        for line in open(f):
            e = json.loads(line)
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                g = (e.get("Properties") or {}).get("spark.jobGroup.id", "")
                for sid in e.get("Stage IDs", []):
                    group[sid] = g
            elif ev == "SparkListenerTaskEnd":
                m = e.get("Task Metrics") or {}
                rec = (m.get("Input Metrics", {}).get("Records Read", 0)
                       + m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0))
                stages.setdefault(e["Stage ID"], []).append(rec)
    return {sid: (group.get(sid, "?"), recs) for sid, recs in stages.items()}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    # partition coalescing off: show the balance of the shuffle partitions
    spark = build_session("local[8]", 32, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                                 "spark.eventLog.compress": "false"})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = table(spark, sf, "documents")
    n = docs.count()
    # a third of the posts belong to one topic, the rest to their source
    posts = document_posts(docs, 20, "source").withColumn(
        "topic_id", F.when(F.col("page_no") <= (n // 3) // 20, F.lit("hot")).otherwise(F.col("topic_id")))
    cfg = CurationConfig(min_chars=200)
    topics = SEL.topic_authors(posts, cfg)
    spark.sparkContext.setJobGroup("ours", "ours")
    t0 = time.time()
    R.render_chunks(SEL.story_posts(SEL.select_story_posts(posts, topics, cfg))) \
        .write.format("noop").mode("overwrite").save()
    t_ours = time.time() - t0
    spark.sparkContext.setJobGroup("naive", "naive")
    t0 = time.time()
    w = Window.partitionBy("topic_id").orderBy("page_no", "pos")
    naive = posts.withColumn("rn", F.row_number().over(w)) \
        .withColumn("k", F.lower(F.substring("content_text", 1, 100))) \
        .withColumn("first", F.row_number().over(Window.partitionBy("topic_id", "k").orderBy("rn")) == 1)
    naive.write.format("noop").mode("overwrite").save()
    t_naive = time.time() - t0
    spark.stop()
    stages = stage_balance(log_dir)
    print(f"posts={n} hot_topic_share=1/3  ours={t_ours:.1f}s  naive_topic_window={t_naive:.1f}s  log={log_dir}")
    for sid in sorted(stages):
        tag, recs = stages[sid]
        if len(recs) < 8 or max(recs) == 0:     # skip scans of the single-row-group file
            continue
        med = statistics.median(recs) or 1
        print(f"{tag:5s} stage {sid:3d}: tasks={len(recs):3d} max_records={max(recs):8d} "
              f"median={int(statistics.median(recs)):8d} max/median={max(recs) / med:6.1f}")


if __name__ == "__main__":
    main()
