"""Image stage: full-size rewrite (U16/J5), asset cache and archive
fallback (A6, J3, J4), local sources (U15), image-host lookup (X12)."""

from threadsmith.config import CurationConfig
from threadsmith.operators import assets as A
from threadsmith.operators import extract as X
from threadsmith.plans import curate
from tests.test_pipeline import LONG, P1, page, pages_df, post

IMGS = ('<img class="img-shack" src="https://image.noelshack.com/minis/a.png" '
        'alt="https://www.noelshack.com/fichiers/a.png" width="68" height="51">'
        '<img class="img-shack" src="https://image.noelshack.com/minis/b.png" '
        'alt="https://www.noelshack.com/b-page" width="68" height="51">'
        '<img class="img-shack" src="https://image.noelshack.com/minis/c.png" '
        'alt="https://www.noelshack.com/c-page" height="51">'
        '<img src="https://other.example/smiley.gif" alt=":)">')
IMAGE_POST = post("pogo12", "<p>screen</p>" + IMGS)


def test_image_targets(spark):
    df = spark.createDataFrame([("https://www.noelshack.com/b-page", '<img id="elt_to_aff" src="https://full/b.png">'),
                                ("https://www.noelshack.com/c-page", "<p>gone</p>")], "url string, html string")
    got = {r.page_url: r.full_src for r in X.image_targets(df).collect()}
    assert got == {"https://www.noelshack.com/b-page": "https://full/b.png", "https://www.noelshack.com/c-page": None}


def test_fullsize_and_download(spark):
    pages = pages_df(spark, [(1, page(P1 + [IMAGE_POST], 1))])
    targets = spark.createDataFrame([("https://www.noelshack.com/b-page", "https://full/b.png"),
                                     ("https://www.noelshack.com/c-page", None)], "page_url string, full_src string")
    out = curate.run(spark, pages, CurationConfig(use_state=False), image_targets=targets)
    img_post = [r for r in out.story_posts.collect() if r.is_image][0]
    srcs = [(i.src, i.width, i.height) for i in img_post.images]
    assert srcs == [("https://www.noelshack.com/fichiers/a.png", None, None), ("https://full/b.png", None, None),
                    ("https://image.noelshack.com/minis/c.png", None, "51"),
                    ("https://other.example/smiley.gif", None, None)]
    html = img_post.content_html
    assert 'src="https://full/b.png"' in html and 'width="68"' not in html and html.count('height="51"') == 1

    manifest = spark.createDataFrame([("a.png", "u", 200, "u")], "file_name string, url string, status int, final_url string")
    fetch = spark.createDataFrame(
        [("https://full/b.png", 404, None, None), ("https://image.noelshack.com/minis/c.png", 200,
                                                    "https://image.noelshack.com/minis/c2.png", None),
         ("https://other.example/smiley.gif", None, None, "connection refused")],
        "url string, status int, final_url string, fetch_error string")
    snaps = spark.createDataFrame(
        [("https://full/b.png", "https://web.archive.org/web/1/https://full/b.png", "2001-01-01", 200),
         ("https://full/b.png", "https://web.archive.org/web/2/https://full/bb.png", "2002-01-01", 503)],
        "url string, archive_url string, snapshot_ts string, status int")
    assets = curate.AssetInputs(manifest, fetch, snaps)
    cfg = CurationConfig(use_state=False, download_images=True)
    out = curate.run(spark, pages, cfg, image_targets=targets, assets=assets)
    img_post = [r for r in out.story_posts.collect() if r.is_image][0]
    assert [i.src for i in img_post.images] == [
        "risitas-html/images/a.png", "risitas-html/images/b.png", "risitas-html/images/c2.png",
        "https://other.example/smiley.gif"]
    assert 'src="risitas-html/images/c2.png"' in img_post.content_html


def test_oldest_snapshot(spark):
    snaps = spark.createDataFrame(
        [("u1", "a1", "2001-01-01", 503), ("u1", "a2", "2002-01-01", 200), ("u2", "b1", "2003-01-01", 200)],
        "url string, archive_url string, snapshot_ts string, status int")
    got = {r.url: (r.archive_url, r.accepted) for r in A.oldest_snapshot(snaps).collect()}
    assert got == {"u1": ("a1", False), "u2": ("b1", True)}


def test_no_resize_keeps_size(spark):
    pages = pages_df(spark, [(1, page(P1 + [IMAGE_POST], 1))])
    targets = spark.createDataFrame([], "page_url string, full_src string")
    out = curate.run(spark, pages, CurationConfig(use_state=False, resize_images=False), image_targets=targets)
    img_post = [r for r in out.story_posts.collect() if r.is_image][0]
    assert [(i.width, i.height) for i in img_post.images][:2] == [("68", "51"), ("68", "51")]
    assert 'width="68"' in img_post.content_html
