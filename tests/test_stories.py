"""Story storage: chunk table append, per-story documents, stored-document
scan, big-document split into parts of 30 blocks."""

import os
import re
import shutil
from statistics import median

from pyspark.sql import functions as F

from threadsmith.config import STORY_FOOTER, STORY_HEADER, CurationConfig
from threadsmith.operators.render import render_chunks
from threadsmith.sources import links as L
from threadsmith.sources import stories as S


CHUNKS = "story_key string, chunk_no long, html string, n_posts long"
NAMES = "story_key string, file_path string, mode string"


def _document(spark, out, story):
    m = S.manifest(spark, out).filter(F.col("story") == story).orderBy("run_seq", "part").collect()
    parts = [open(r.path.replace("file:", ""), encoding="utf-8").read() for r in m]
    at = len(STORY_HEADER.encode())
    for r, p in zip(m, parts, strict=True):
        assert (r.at, r.n_bytes) == (at, len(p.encode()))
        at += r.n_bytes
    return STORY_HEADER + "".join(parts) + STORY_FOOTER


def test_append_commit_and_segments(spark, tmp_path):
    store, out = S.StoryStore(spark, str(tmp_path / "table")), str(tmp_path / "docs")
    names = spark.createDataFrame([("s1", "a-one-0", "create"), ("s2", "b-two-0", "create")], NAMES)
    c1 = spark.createDataFrame([("s1", 1, "<p>é</p>", 1), ("s1", 2, "<p>b</p>", 1), ("s2", 1, "<p>z</p>", 1)], CHUNKS)
    assert store.append(c1, names, "first") == 1
    S.write_segments(store, out, 1)
    before = _document(spark, out, "b-two-0")
    c2 = spark.createDataFrame([("s1", 3, "<p>c</p>", 1)], CHUNKS)
    for _ in range(2):      # the same run again replaces its own part
        assert store.append(c2, names.withColumn("mode", F.lit("append")), "second") == 2
        S.write_segments(store, out, 2)
    doc = _document(spark, out, "a-one-0")
    assert [doc.count(x) for x in ("é", "<p>b", "<p>c", "<!DOCTYPE")] == [1, 1, 1, 1]
    assert doc.index("é") < doc.index("<p>b") < doc.index("<p>c")
    assert _document(spark, out, "b-two-0") == before
    # a run that was ended before its commit isn't read, and its retry replaces it
    store.append(spark.createDataFrame([("s1", 4, "<p>d</p>", 1)], CHUNKS), names, "third")
    shutil.rmtree(tmp_path / "table" / "commits" / "run_seq=3")
    assert store.runs() == [1, 2] and store.chunks().count() == 4
    assert store.append(spark.createDataFrame([("s1", 4, "<p>D</p>", 1)], CHUNKS), names, "third") == 3
    assert sorted(r.html for r in store.chunks([3]).collect()) == ["<p>D</p>"]
    log = {(r.run_seq, r.story): (r.first_chunk, r.last_chunk, r.n_posts) for r in store.commits().collect()}
    assert log == {(1, "a-one-0"): (1, 2, 2), (1, "b-two-0"): (1, 1, 1), (2, "a-one-0"): (3, 3, 1), (3, "a-one-0"): (4, 4, 1)}


def test_hot_story_spans_tasks(spark, tmp_path):
    """One story has a third of all bytes: no task has over twice the median."""
    store = S.StoryStore(spark, str(tmp_path / "table"))
    chunks = spark.range(6000).select(
        F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("story_key"),
        F.col("id").alias("chunk_no"), F.rpad(F.col("id").cast("string"), 300, "x").alias("html"),
        F.lit(1).cast("long").alias("n_posts"))
    names = chunks.select("story_key").distinct().withColumn("file_path", F.concat("story_key", F.lit("-0"))) \
        .withColumn("mode", F.lit("create"))
    store.append(chunks, names)
    m = S.write_segments(store, str(tmp_path / "docs"), 1, parts=12).collect()
    per_task = {}
    for r in m:
        per_task[r.part] = per_task.get(r.part, 0) + r.n_bytes
    assert len(per_task) == 12 and max(per_task.values()) <= 2 * median(per_task.values())
    assert len({r.part for r in m if r.story == "hot-0"}) >= 4
    doc = _document(spark, str(tmp_path / "docs"), "hot-0")
    got = [int(x) for x in re.findall(r"(\d+)x+", doc)]
    assert got == list(range(2000))


def test_whole_documents_and_parts(spark, tmp_path):
    store = S.StoryStore(spark, str(tmp_path / "table"))
    posts = spark.createDataFrame([(f"t{i % 2}", 1 + i // 4, i % 4, f"<div>{i}</div>") for i in range(140)],
                                  "topic_id string, page_no int, pos int, content_html string")
    names = spark.createDataFrame([("t0", "a-t0-0", "create"), ("t1", "a-t1-0", "create")], NAMES)
    store.append(render_chunks(posts), names)
    size = {r.story: r.n_bytes for r in S.stories_of(store).collect()}
    whole = {r.name: r.html for r in S.whole_documents(store).collect()}
    assert {k: len(v.encode()) for k, v in whole.items()} == size
    assert re.findall(r"<div>(\d+)", whole["a-t1-0"]) == [str(i) for i in range(1, 140, 2)]
    named = posts.join(names.select(F.col("story_key").alias("topic_id"), F.col("file_path").alias("story")), "topic_id")
    parts = {r.name: r.html for r in S.big_parts(store, named, CurationConfig(), threshold=size["a-t0-0"]).collect()
             if r.name.startswith("a-t0-0")}
    assert {k: v.count("<div>") for k, v in parts.items()} == {
        "a-t0-0-part-0-to-30": 30, "a-t0-0-part-30-to-60": 30, "a-t0-0-part-60-to-90": 10}
    files = S.write_named(spark.createDataFrame(list(whole.items()), "name string, html string"), str(tmp_path / "out"))
    assert files.count() == 2 and sorted(os.listdir(tmp_path / "out")) == ["a-t0-0.html", "a-t1-0.html"]
    assert (tmp_path / "out" / "a-t0-0.html").read_text() == whole["a-t0-0"]


def test_big_split(spark, tmp_path):
    d = tmp_path / "html"
    d.mkdir()
    (d / "small.html").write_text("<html><body><div>x</div></body></html>")
    (d / "big.html").write_text("<html><body>" + "".join(f"<div><div>{i}</div></div>" for i in range(61))
                                + "</body></html>")
    stored = S.read_story_files(spark, str(d))
    normal, big = S.split_big(stored, threshold=os.path.getsize(d / "big.html"))
    assert [r.path.endswith("small.html") for r in normal.collect()] == [True]
    parts = sorted((r.part_no, r.n_blocks) for r in S.export_parts(big).collect())
    assert parts == [(0, 30), (1, 30), (2, 1)]


def test_links(spark, tmp_path):
    f = tmp_path / "links.txt"
    f.write_text("  https://a/1-2-3-4\n\n\thttps://b/1-2-3-4  \n   \n")
    got = [r.link for r in L.links_source(spark, [str(f)]).orderBy("link_no").collect()]
    assert got == ["https://a/1-2-3-4", "https://b/1-2-3-4"]
    assert [r.link for r in L.links_source(spark, ["https://c/1"]).collect()] == ["https://c/1"]
