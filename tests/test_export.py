"""``export`` of the library's own output, by content."""

import os

import pytest

from tests.test_pipeline import P1, P2, page, pages_df
from threadsmith import cli
from threadsmith.sources import stories as SS


def test_export_of_a_run(spark, tmp_path):
    out, src = str(tmp_path / "out"), str(tmp_path / "crawl")
    pages_df(spark, [(1, page(P1, 2)), (2, page(P2, 2))]).write.parquet(src)
    cli.main(["run", "--pages", src, "--out", out], spark=spark)
    cli.main(["export", "--out", out], spark=spark)
    name = spark.read.parquet(f"{out}/touched").first().file_path
    assert name == "pogo12-mon-histoire-0" and os.listdir(f"{out}/export") == [f"{name}.html"]
    html = (tmp_path / "out" / "export" / f"{name}.html").read_text()
    assert html.count("<!DOCTYPE html>") == 1 and html.index("Chapitre 1") < html.index("Chapitre 3")


def test_export_of_stored_documents(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "stored.html").write_text("<body><div>b</div></body>")
    got = {r.name: r.html for r in SS.documents(spark, str(folder)).collect()}
    assert got == {"stored": "<body><div>b</div></body>"}
    cli.main(["export", "--out", str(tmp_path / "o"), "--html-dir", str(folder)], spark=spark)
    assert (tmp_path / "o" / "export" / "stored.html").read_text() == "<body><div>b</div></body>"
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        SS.documents(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        cli.main(["export", "--out", str(tmp_path / "nothing")], spark=spark)
