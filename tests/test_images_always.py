"""Image posts are shown at full size without a lookup table; half-given asset inputs are refused."""

import pytest

from tests.test_assets import IMGS
from tests.test_pipeline import page, pages_df, post
from threadsmith import cli
from threadsmith.config import CurationConfig
from threadsmith.plans import curate


def test_full_size_without_targets(spark):
    df = pages_df(spark, [(1, page([post("pogo12", f"<p>{IMGS}</p>")], 1))])
    row = [r for r in curate.run(spark, df, CurationConfig(use_state=False)).story_posts.collect() if r.is_image][0]
    assert [(i.src, i.width, i.height) for i in row.images][:3] == [
        ("https://www.noelshack.com/fichiers/a.png", None, None),
        ("https://image.noelshack.com/minis/b.png", None, None),
        ("https://image.noelshack.com/minis/c.png", None, "51")]
    assert "width=" not in row.content_html and "minis/a.png" not in row.content_html


def test_half_given_assets_are_refused(spark, tmp_path):
    df = pages_df(spark, [(1, page([post("pogo12", "<p>x</p>")], 1))])
    with pytest.raises(ValueError):
        curate.run(spark, df, CurationConfig(download_images=True))
    df.write.parquet(str(tmp_path / "in"))
    for cmd in (["run", "--pages"], ["stream", "--landing"]):
        for more in (["--download-images"], ["--asset-manifest", "m"], ["--download-images", "--snapshots", "s"]):
            with pytest.raises(SystemExit):
                cli.main([*cmd, str(tmp_path / "in"), "--out", str(tmp_path / "out"), *more], spark=spark)
