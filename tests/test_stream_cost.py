"""What a micro-batch does per page, topic and story, and not more often."""

import os

from pyspark.sql import functions as F

from threadsmith.config import SITE_A, CurationConfig
from threadsmith.operators import state as ST
from threadsmith.plans import curate
from threadsmith.sources import stories as S
from threadsmith.streaming import topics


def _tasks(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    t = spark.sparkContext.statusTracker()
    return sum(t.getStageInfo(s).numTasks for j in t.getJobIdsForGroup(group) for s in t.getJobInfo(j).stageIds)


def test_a_story_more_is_no_task_more(spark, tmp_path):
    store, out = S.StoryStore(spark, str(tmp_path / "table")), str(tmp_path / "docs")
    odd = ["a%b=c-0", "x:y?z-1", "\u00e9t\u00e9 \u00e0-2"]
    n = 300
    names = spark.createDataFrame([(str(i), odd[i] if i < len(odd) else f"story-{i}", "create") for i in range(n)],
                                  "story_key string, file_path string, mode string").coalesce(2).cache()
    chunks = names.select("story_key", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("chunk_no"),
                          F.concat(F.lit("<p>\u00e9</p>"), "story_key").alias("html"), F.lit(1).cast("long").alias("n_posts"))
    store.append(chunks, names, "r")
    for again in range(2):      # the same run again replaces its own
        assert _tasks(spark, f"segments-{again}", lambda: S.write_segments(store, out, 1, parts=4)) < 60
    m = S.manifest(spark, out).collect()
    texts = {}
    for r in sorted(m, key=lambda r: r.part):
        at = r.path.replace("file:", "")
        assert os.path.getsize(at) == r.n_bytes
        texts[r.story] = texts.get(r.story, "") + open(at, encoding="utf-8").read()
    want = {r.file_path: f"<p>\u00e9</p>{r.story_key}\n" * 2 for r in names.collect()}
    assert texts == want
    # folders are named as Spark names those of a partition, and hold nothing else
    found = spark.read.text(f"{out}/segments/run_seq=1")
    assert {r.story for r in found.select("story").distinct().collect()} == set(want) and found.count() == 2 * n
    assert {f for _, _, names in os.walk(f"{out}/segments") for f in names if f.startswith(".attempt")} == set()


def test_segments_by_spark_are_the_same(spark, tmp_path, monkeypatch):
    store = S.StoryStore(spark, str(tmp_path / "table"))
    names = spark.createDataFrame([("1", "a-0", "create"), ("2", "b=c-0", "create")], "story_key string, file_path string, mode string")
    store.append(spark.createDataFrame([("1", 1, "x", 1), ("1", 2, "y", 1), ("2", 1, "z", 1)],
                                       "story_key string, chunk_no long, html string, n_posts long"), names, "r")
    got = []
    for own in (True, False):
        monkeypatch.setattr(S, "_arrow_opens", lambda root, own=own: own)
        got.append(sorted((r.story, r.n_bytes) for r in S.write_segments(store, str(tmp_path / f"d{own}"), 1, parts=1).collect()))
    assert got[0] == got[1] == [("a-0", 4), ("b=c-0", 2)]


class _Var:
    """A state variable that counts the messages to the JVM."""

    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def _of(self, name, value=None):
        self.calls.append(name)
        return value

    def exists(self):
        return self._of("exists", bool(self.held))

    def get(self):
        return self._of("get", self.held.get(()))

    def update(self, v):
        self.held[()] = self._of("update", v)

    def keys(self):
        return self._of("keys", iter(list(self.held)))

    def getValue(self, k):
        return self._of("getValue", self.held[k])

    def updateValue(self, k, v):
        self.held[k] = self._of("updateValue", v)

    def removeKey(self, k):
        self._of("removeKey")
        del self.held[k]


class _Handle:
    def __init__(self):
        self.calls = []

    def getValueState(self, *a):
        return _Var(self.calls)

    getMapState = getValueState


class _Page(dict):
    asDict = dict.copy


def _page(n):
    return _Page(kind="page", page_no=n, reason=None, last_pos=19, domain="d", link="l", topic_key="k",
                 topic_author="a" if n == 1 else None, total_pages=3, title="t", payload=f"p{n}")


def test_a_topic_asks_the_state_once():
    p, h = topics.TopicState(20, True, None), _Handle()
    p.init(h)
    batch = lambda *ns: [(r.kind, r.page_no, r.payload, r.domain, r.pages) for r in p.handleInputRows(
        ("t",), iter([_page(n) for n in ns]), None)]
    assert batch(3) == [("wait", 3, None, None, None), ("topic", None, None, "d", "3-3")]
    assert h.calls == ["get", "updateValue", "update"]
    h.calls.clear()
    assert batch(1) == [("read", 1, "p1", "d", None), ("topic", None, None, "d", "1-1,3-3")]
    assert h.calls == ["get", "keys", "update"]
    h.calls.clear()
    assert batch(2) == [("read", 2, "p2", "d", None), ("read", 3, "p3", "d", None), ("topic", None, None, "d", "1-3")]
    assert h.calls == ["get", "keys", "getValue", "removeKey", "update"]


def test_a_batch_reads_its_payloads_once(spark):
    """A page that comes twice in a batch, the second time with more, gives each
    post once; what a batch takes from the posts doesn't read the payloads again."""
    def payload(*pos):
        post = '{"pos":%d,"post_author":"w","post_text":"%s","content_text":"%s","content_html":"h","paragraphs":["x"]}'
        return "[" + ",".join(post % (i, f"{i}" * 300, f"{i}" * 300) for i in pos) + "]"
    head = {"domain": SITE_A, "link": "l", "topic_key": "k", "topic_author": "w", "total_pages": 1, "title": "t",
            "pages": "1-1", "open": "1:1", "read_to": 1}
    row, cfg = topics.TopicState._row, CurationConfig(min_chars=100)
    rows = [row("read", "t", 1, -1, record={"domain": SITE_A}, payload=payload(0)),
            row("read", "t", 1, 0, record={"domain": SITE_A}, payload=payload(0, 1)), row("topic", "t", record=head)]
    r = topics.reading(spark.createDataFrame([tuple(x) for x in rows], topics.RELEASED), ST.empty_state(spark), cfg)
    assert "from_json" not in r.posts._jdf.queryExecution().toString()
    verdict, kept = curate.select_and_edit(r, cfg, None, None, None)
    assert sorted((x.pos, x.kept) for x in verdict.collect()) == [(0, True), (1, True)]
    assert sorted(x.pos for x in kept.collect()) == [0, 1]
