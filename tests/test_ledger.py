"""Keyed change log and page ledger against small models."""

import os
import random

from pyspark.sql import functions as F

from threadsmith.config import CurationConfig
from threadsmith.operators import dedup as D
from threadsmith.operators import ledger as L
from threadsmith.operators import state as ST
from threadsmith.operators.keyed_log import KeyedLog
from threadsmith.operators.ordering import order_key, order_parts


def _intervals(pages):
    out = []
    for p in sorted(set(pages)):
        if out and p <= out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [tuple(x) for x in out]


def test_islands_merge_and_gaps(spark):
    rnd = random.Random(4)
    one = {t: rnd.sample(range(1, 30), rnd.randint(1, 20)) for t in range(60)}
    two = {t: rnd.sample(range(1, 30), rnd.randint(0, 20)) for t in range(60)}
    df = lambda m: spark.createDataFrame([(t, p) for t, ps in m.items() for p in ps], "topic_id long, page_no int")
    a, b = L.islands(df(one)), L.islands(df(two)).withColumnRenamed("pages", "more")
    got = a.join(b, "topic_id", "left").withColumn("all", L.merged("pages", "more")) \
        .withColumn("to", L.read_to("all", F.lit(1))).withColumn("gap", L.gaps("all", F.lit(3), F.lit(25))).collect()
    assert len(got) == 60
    for r in got:
        every = set(one[r.topic_id]) | set(two[r.topic_id])
        assert [tuple(x) for x in r.pages] == _intervals(one[r.topic_id])
        assert [tuple(x) for x in r["all"]] == _intervals(every)
        to = 0
        while to + 1 in every:
            to += 1
        assert r.to == to
        assert [tuple(x) for x in r.gap] == _intervals(p for p in range(3, 26) if p not in every)
    t = spark.createDataFrame([(1, [(1, 2), (5, 5)], 1, 7), (2, None, 2, 3), (3, [(1, 9)], 1, 9)],
                              "topic_id long, pages array<struct<lo:int,hi:int>>, start_page int, total_pages int")
    assert sorted((r.topic_id, r.page_no) for r in L.missing_pages(t).collect()) == [(1, 3), (1, 4), (1, 6), (1, 7), (2, 2), (2, 3)]


def test_open_pages(spark):
    t = spark.createDataFrame([([(1, 3), (2, 4)], [(2, 19), (3, 7)])],
                              "a array<struct<page_no:int,last_pos:int>>, b array<struct<page_no:int,last_pos:int>>")
    assert [tuple(x) for x in t.select(L.open_pages("a", "b", 20)).first()[0]] == [(1, 3), (3, 7)]


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_log_reads_the_newest_row_of_each_key(spark, tmp_path):
    rnd = random.Random(8)
    log = KeyedLog(spark, str(tmp_path / "log"), ST.STATE_SCHEMA, ["topic_key"])
    row = lambda k, v: (str(k), "".join(rnd.choices("abcdefgh", k=200)), "l", "f", v, 0)
    want = {str(k): 0 for k in range(4000)}
    assert log.latest() is None and log.read().count() == 0
    log.replace(spark.createDataFrame([row(k, 0) for k in range(4000)], ST.STATE_SCHEMA), 0)
    compacted = 0
    for v in range(1, 7):
        keys = rnd.sample(range(4100), 20 if v < 5 else 3000)
        compacted += log.append(spark.createDataFrame([row(k, v) for k in keys], ST.STATE_SCHEMA), v)
        want |= {str(k): v for k in keys}
        got = {r.topic_key: r.total_pages for r in log.read().collect()}
        assert got == want and log.latest() == v
        if v < 5:  # the bytes of a version follow its rows
            assert _size(f"{tmp_path}/log/changes/version={v}") < 0.1 * _size(f"{tmp_path}/log/full/version=0")
    assert compacted >= 1
    assert {r.total_pages for r in log.read(at_most=1).collect()} == {0, 1}
    # a version that was not committed does not count; its retry replaces it
    before = log.read().count()
    log.append(spark.createDataFrame([row(9999, 7)], ST.STATE_SCHEMA), 7)
    os.remove(f"{tmp_path}/log/changes/version=7/_SUCCESS")
    assert log.read().count() == before and log.latest() == 6
    log.append(spark.createDataFrame([row(9998, 7), row(9997, 7)], ST.STATE_SCHEMA), 7)
    assert log.read().count() == before + 2
    state = sorted(map(tuple, log.read().collect()))
    assert log.vacuum() > 0 and sorted(map(tuple, log.read().collect()))[:3] == state[:3]


def test_log_in_buckets_reads_only_those(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), ST.STATE_SCHEMA, ["topic_key"], bucket_of=["topic_key"])
    rows = spark.createDataFrame([(f"k{i}", "t", "l", "f", 1, i) for i in range(300)], ST.STATE_SCHEMA)
    log.append(rows, 0)
    some = rows.filter("topic_key in ('k3', 'k4')")
    got = log.read(buckets=log.buckets(some))
    assert len(log.buckets(some)) <= 2 and got.count() < 40
    assert {"k3", "k4"} <= {r.topic_key for r in got.collect()}


def test_order_key_has_room_for_every_position(spark):
    rows = [(1, (1 << 20) + 5), (2, 0), (1, 7), (2, (1 << 31) - 1), ((1 << 31) - 1, 3), (0, 0)]
    df = spark.createDataFrame(rows, "page_no int, pos int").withColumn("ord", order_key())
    page, pos = order_parts("ord")
    got = [(r.p, r.q) for r in df.orderBy("ord").select(page.alias("p"), pos.alias("q")).collect()]
    assert got == sorted(rows)
    bad = spark.createDataFrame([(-1, 2)], "page_no int, pos int").select(order_key().alias("o"))
    try:
        bad.collect()
        raise AssertionError("a negative page must not sort in silence")
    except Exception as e:  # noqa: BLE001
        assert "out of range" in str(e)
    # duplicates are found in order beyond 2^20 positions
    c = spark.createDataFrame([(1, 1, (1 << 20) + 1, "same"), (1, 1, 1, "same"), (1, 2, 0, "same")],
                              "topic_id long, page_no int, pos int, content_text string") \
        .withColumn("content_html", F.col("content_text")).withColumn("img_post", F.lit(False))
    got = {(r.page_no, r.pos): r.is_dup for r in D.duplicate_verdicts(c, CurationConfig()).collect()}
    assert got == {(1, 1): False, (1, (1 << 20) + 1): True, (2, 0): True}
