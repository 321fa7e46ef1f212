"""Pages that land in any order, each once or again, through page_ingest."""

import pytest

from tests.test_pipeline import pages_df
from tests.test_resume_split import _page
from threadsmith.config import CurationConfig
from threadsmith.operators.state import read_state
from threadsmith.streaming import ingest


@pytest.mark.parametrize("landings,reasons", [
    ([[1, 3], [1, 2, 3]], {(3, "page_gap")}),
    ([[1], [1, 2]], set()),
    ([[3], [2], [1]], {(3, "header_page_missing"), (2, "header_page_missing")}),
    ([[2], [1]], {(2, "header_page_missing")}),
])
def test_no_page_is_lost(spark, tmp_path, landings, reasons):
    landing, base = str(tmp_path / "landing"), str(tmp_path / "out")
    for i, numbers in enumerate(landings):
        df = pages_df(spark, [(n, _page(n)) for n in numbers])
        df.coalesce(1).write.parquet(f"{landing}/b{i}")
        ingest.page_ingest(spark, landing + "/*", df.schema, base, CurationConfig())
    kept = sorted((r.page_no, r.pos) for r in spark.read.parquet(f"{base}/story_posts").collect())
    last = max(n for numbers in landings for n in numbers)
    assert kept == [(p, i) for p in range(1, last + 1) for i in range(20)]
    assert [(r.total_pages, r.post_cursor) for r in read_state(spark, f"{base}/state").collect()] == [(last, 19)]
    assert {(r.page_no, r.reason) for r in spark.read.parquet(f"{base}/quarantine").collect()} == reasons
    asked = {(r.batch_id, r.page_no) for r in spark.read.parquet(f"{base}/frontier").collect()}
    assert {p for b, p in asked if b == len(landings) - 1} == set(range(last + 1, 4))
