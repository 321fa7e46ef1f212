"""Plan-level properties: skew safety, pushdown, entry smoke; the
hierarchical rank against brute force."""

import random
import re

from pyspark.sql import functions as F

from threadsmith.operators.ordering import rank_in_topic
from threadsmith.plans import driver as D
from tests.conftest import SF0001


def test_rank_in_topic_blocks(spark):
    rnd = random.Random(11)
    rows = []
    for t in range(40):
        pages = rnd.sample(range(1, 60), rnd.randint(1, 25))
        for pg in pages:
            rows += [(t, pg, p) for p in rnd.sample(range(20), rnd.randint(1, 5))]
    df = spark.createDataFrame(rows, "topic_id long, page_no int, pos int")
    got = {(r.topic_id, r.page_no, r.pos): r.rank for r in rank_in_topic(df, block=4).collect()}
    by_topic = {}
    for t, pg, p in rows:
        by_topic.setdefault(t, []).append((pg, p))
    for t, keys in by_topic.items():
        for i, (pg, p) in enumerate(sorted(keys)):
            assert got[(t, pg, p)] == i


def _windows(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Window \[.*?\], \[([^\]]*)\]", plan)


def test_no_topic_sized_window(spark):
    """No window of the selection/dedup/render/resume plans is partitioned
    by the topic alone (a hot topic would land in one task)."""
    for name in ("story_posts", "story_render", "dedup_intent", "dedup_as_coded", "resume_filter",
                 "cursor_advance", "reject_reason_counts"):
        df = D.QUERIES[name](spark, SF0001)
        for part in _windows(df):
            keys = [k.split("#")[0].strip() for k in part.split(",") if k.strip()]
            assert keys not in (["topic_id"], ["lang"], ["conv_id"]), (name, part)
    # No window partitioned by the slug
    from threadsmith.operators.render import version_numbers
    new = spark.createDataFrame([("s", i) for i in range(50)], "slug string, link_no long")
    used = spark.createDataFrame([("s", 0), ("s", 1)], "slug string, version long")
    for part in _windows(version_numbers(new, used)):
        assert "slug" not in part, part


def test_pushdown_and_pruning(spark):
    df = D.QUERIES["short_posts"](spark, SF0001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [l for l in plan.splitlines() if "FileScan parquet" in l][0]
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in scan
    df = D.table(spark, SF0001, "documents").filter(F.col("lang") == "fr").select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,fr)]" in plan


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["story_key", "chunk_no", "html", "n_posts"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
