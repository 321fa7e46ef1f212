"""Boundary cases of the column scalars (expected values from the rules)."""

from pyspark.sql import functions as F

from threadsmith.functions import slug as S
from threadsmith.functions import text as T
from threadsmith.functions import urls as U
from threadsmith.operators import select as SEL
from threadsmith.config import CurationConfig


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


LINK = "https://www.jeuxvideo.com/forums/42-51-67052724-1-0-1-0-titre-du-topic.htm"


def test_domain(spark):
    assert one(spark, U.domain("v"), LINK) == "jeuxvideo.com"
    assert one(spark, U.domain("v"), "https://m.awww1.example.com/x") == "m.a.example.com"  # 'www' + any char
    assert one(spark, U.domain("v"), "nohost") is None


def test_page_link_and_key(spark):
    assert one(spark, U.page_link("v", F.lit(9)), LINK) == LINK.replace("-67052724-1-", "-67052724-9-")
    assert one(spark, U.page_link("v", F.lit(12)), LINK) == LINK.replace("-67052724-1-", "-67052724-12-")
    assert one(spark, U.page_link("v", F.lit(2)), "https://x.com/42-51-3") is None       # 3 digit runs
    assert one(spark, U.topic_key("v"), LINK) == "https://www.jeuxvideo.com/forums/42-51-67052724-"
    assert one(spark, U.topic_key("v"), LINK.upper()) == "https://www.jeuxvideo.com/forums/42-51-67052724-"


def test_archive_links(spark):
    a = "https://web.archive.org/web/2019/https://topic.example/slug/"
    assert one(spark, U.archive_page_link("v", F.lit(1)), a) == a
    assert one(spark, U.archive_page_link("v", F.lit(2)), a) == a[:-1] + "/2/"
    assert one(spark, U.archive_page_link("v", F.lit(2)), a[:-1]) == "https://web.archive.org/web/2019/https://topic.example/2/"
    img = "https://web.archive.org/web/2019im_/https://image.noelshack.com/fichiers/a/b.png"
    assert one(spark, U.strip_archive("v"), img) == "https://image.noelshack.com/fichiers/a/b.png"
    assert one(spark, U.clean_asset_url("v"), "https://i.example/x.png") == "https://i.example/x.png"
    assert one(spark, U.asset_name("v"), "https://i.example/a/x.png") == "x.png"
    assert one(spark, U.asset_name("v"), "noslash") == ""


def test_video(spark):
    e = "https://www.youtube.com/embed/abc123?feature=oembed#t=5"
    assert one(spark, U.video_watch_url("v"), e) == "https://www.youtube.com/watch?v=abc123#t=5"
    assert one(spark, U.video_watch_url("v"), "https://y.com/embed/zz?x=1") == "https://y.com/watch?v=zz"


def test_slug(spark):
    assert one(spark, S.slugify("v", title=True), "[Risitas] L'Été à Paris™ !") == "lete-a-paristm"
    assert one(spark, S.slugify("v"), "__Straße--x  y_") == "strae-x-y"
    assert one(spark, S.slugify("v", title=True), "  a  [RISITAS]  b ") == "a-b"


def test_short_and_trim(spark):
    assert one(spark, T.is_short("v"), "x" * 999) is True
    assert one(spark, T.is_short("v"), "x" * 1000) is False
    assert one(spark, T.is_short("v"), "\t\n " + "x" * 500 + "\n" + "y" * 500 + " \n") is False
    assert one(spark, T.is_short("v"), "x" * 500 + "\n" * 10 + "y" * 499) is True
    assert one(spark, T.ws_trim("v"), "  a b \x1c") == "a b"


def test_identifier(spark):
    df = spark.createDataFrame([("x" * 192 + "Chapitre",), ("x" * 193 + "chapitre",), ("CHAPITRE 2",)], "v string")
    got = [r[0] for r in df.select(T.has_identifier("v", ["chapitre"])).collect()]
    assert got == [True, False, True]
    assert one(spark, T.has_identifier("v", [r"chapitre \d"]), "chapitre 3") is True
    assert one(spark, T.has_identifier("v", ["chapitre"]), None) is False


def test_excerpt(spark):
    e = T.excerpt(F.split("v", "\\|"))
    assert one(spark, e, "  |  second para  ") == "second para"
    assert one(spark, e, " |  ") is None
    assert one(spark, e, "x" * 60) == "x" * 50


def test_author_match(spark):
    df = spark.createDataFrame([(p,) for p in ["pogo", "pogo111", "POGO", "xpogo9", "other"]], "v string")
    auth = F.array(F.lit("pogo12"), F.lit("extra"))
    got = [r[0] for r in df.select(SEL.author_match("v", auth)).collect()]
    assert got == [True, True, False, True, False]
    exact = [r[0] for r in df.select(SEL.author_match("v", F.array(F.lit("pogo")), False)).collect()]
    assert exact == [True, False, False, False, False]
    # an all-digit author has an empty root and matches everyone
    assert one(spark, SEL.author_match("v", F.array(F.lit("1234"))), "anyone") is True


def test_image_post_closed_form(spark):
    cfg = CurationConfig()
    rows = [
        (["a", "screen 1"], 3, False, "short", "jeuxvideo.com", 0, True),
        (["screen", "text after"], 3, False, "short", "jeuxvideo.com", 0, True),   # keyword stops the fold
        (["text", " "], 3, False, "short", "jeuxvideo.com", 0, True),            # last blank
        ([" ", "text"], 3, False, "short", "jeuxvideo.com", 0, False),           # text after blank
        (["screen"], 2, False, "short", "jeuxvideo.com", 0, False),              # 2 images
        (["screen"], 3, True, "short", "jeuxvideo.com", 0, False),               # quote
        (["screen"], 3, False, "x" * 300, "jeuxvideo.com", 0, False),            # 300 chars
        (["screen"], 3, False, "x" * 299, "jeuxvideo.com", 0, True),
        ([], 0, False, "", "jvarchive.com", 1, True),                             # site B, links, no p
        ([], 0, False, "", "jeuxvideo.com", 1, False),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "p array<string>, n int, bq boolean, t string, d string, l int")
    got = [r[0] for r in df.select(SEL.image_post("p", "n", "bq", "t", "d", "l", cfg)).collect()]
    assert got == [r[6] for r in rows]
