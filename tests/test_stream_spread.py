"""A landing is written, parsed and stored by all cores, whatever its bytes."""

import glob

from threadsmith.plans import driver_pages
from tests.conftest import SF0001


def test_landings_and_segments_span_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(driver_pages, "scratch_path", lambda spark, name: str(tmp_path / name))
    driver_pages.stream_pages(spark, SF0001)
    base = str(tmp_path / "stream-pages")
    cores = spark.sparkContext.defaultParallelism
    landings = [glob.glob(f"{d}/part-*.parquet") for d in glob.glob(f"{base}/landing/f*")]
    assert len(landings) == driver_pages.forum.LANDINGS and {len(files) for files in landings} == {cores}
    # each landing is one micro-batch
    assert len(glob.glob(f"{base}/out/_checkpoint/commits/[0-9]*")) == len(landings)
    manifest = spark.read.parquet(f"{base}/out/stories/manifest").groupBy("run_seq").agg({"part": "max"}).collect()
    assert manifest and all(r[1] > 0 for r in manifest)
