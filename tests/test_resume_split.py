"""Any split of a topic's pages over runs loses none, and the state keeps one
row per topic key."""

from tests.test_pipeline import LONG, page, pages_df, post
from threadsmith.config import CurationConfig
from threadsmith.operators import state as ST
from threadsmith.plans import curate


def _page(n):
    return page([post("pogo12", f"<p>Chapitre {n}-{i} {i * 7}</p><p>{LONG}</p>") for i in range(20)], 3)


def _run(spark, state, numbers):
    out = curate.run(spark, pages_df(spark, [(n, _page(n)) for n in numbers]), CurationConfig(), state=state)
    kept = sorted((r.page_no, r.pos) for r in out.story_posts.collect())
    ask = sorted(r.page_no for r in out.frontier.collect())
    return kept, ask, spark.createDataFrame(out.state.collect(), out.state.schema)


def test_pages_in_order_over_runs(spark):
    kept, ask, st = _run(spark, None, [1])
    assert len(kept) == 20 and ask == [2, 3]
    kept, ask, st = _run(spark, st, [1, 2, 3])
    assert kept == [(p, i) for p in (2, 3) for i in range(20)] and ask == []


def test_page_after_a_gap_waits(spark):
    kept, ask, st = _run(spark, None, [1, 3])
    assert {p for p, _ in kept} == {1} and ask == [2, 3]
    kept, ask, st = _run(spark, st, [1, 2, 3])
    assert kept == [(p, i) for p in (2, 3) for i in range(20)] and ask == []


def test_state_has_one_row_per_key(spark):
    rows = [("k", "t", "l", "f", 1, 3), ("k", "t", "l", "f", 2, 0), (None, "t", "l", "f", 9, 9)]
    st = spark.createDataFrame(rows, ST.STATE_SCHEMA)
    got = [tuple(r) for r in ST.upsert_state(st, st).collect()]
    assert got == [("k", "t", "l", "f", 2, 0)]
    kept, _, _ = _run(spark, spark.createDataFrame(
        [("https://www.jeuxvideo.com/forums/42-51-67052724-", "t", "l", "f-0", 1, 5)] * 3, ST.STATE_SCHEMA), [1])
    assert kept == [(1, i) for i in range(6, 20)]


def test_pager_beyond_32_bits_is_quarantined(spark):
    out = curate.run(spark, pages_df(spark, [(1, page([post("a", "x")], 1).replace(
        "<span>1</span>", "<span>99999999999</span>"))]), CurationConfig())
    assert [r.reason for r in out.quarantine.collect()]
