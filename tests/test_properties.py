"""Column expressions vs small Python models of the same rules, on many
generated inputs (one Spark job per property)."""

import re
import unicodedata

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from threadsmith.config import CurationConfig
from threadsmith.functions import slug as S
from threadsmith.functions import text as T
from threadsmith.functions import urls as U
from threadsmith.operators import select as SEL

SETTINGS = settings(max_examples=1, deadline=None, database=None)


def model_page_link(link, n, page):
    runs = [m.span() for m in re.finditer(r"\d+", link)]
    if len(runs) < n:
        return None
    a, b = runs[n - 1]
    return link[:a] + str(page) + link[b:]


def model_key(link, n):
    runs = [m.span() for m in re.finditer(r"\d+", link)]
    return None if len(runs) < n else link[:runs[n - 1][0]].lower()


def model_slug(s, title):
    if title:
        s = re.sub(r"\[risitas\]", "", s, flags=re.IGNORECASE).strip().replace(" ", "-")
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    s = re.sub(r"[^\w\s-]", "", s.lower())
    return re.sub(r"[-\s]+", "-", s).strip("-_")


def model_image(paras, n_hosted, quote, text):
    gate = n_hosted >= 3 and not quote and len(text.strip()) < 300
    ret = False
    for p in paras:
        if re.search(r"screen|repost|supprime", p):
            if gate:
                ret = True
                break
        elif not p.strip():
            if gate:
                ret = True
        else:
            ret = False
    return ret


URLISH = st.lists(st.sampled_from(list("ab-/_.:?=0123456789٣") + ["42", "-1-", "www."]), max_size=25).map("".join)
TITLE = st.lists(st.sampled_from(list("aZé ß-_!'’[]™ﬁ\t") + ["[Risitas]", "Été", "ÀÇ", "  "]), max_size=15).map("".join)
PARAS = st.lists(st.sampled_from(["", "  ", "screen", "a repost", "text", "supprime!", "\n"]), max_size=5)


@SETTINGS
@given(st.lists(st.tuples(URLISH, st.integers(1, 4), st.integers(1, 300)), min_size=300, max_size=300))
def test_page_links_and_keys(spark, rows):
    df = spark.createDataFrame(rows, "l string, n int, p int")
    exprs = [U.page_link("l", F.col("p"), k).alias(f"pl{k}") for k in (1, 2, 4)] + \
            [U.topic_key("l", k).alias(f"tk{k}") for k in (1, 2, 4)]
    for (l, _, p), r in zip(rows, df.select(*exprs).collect()):
        for k in (1, 2, 4):
            assert r[f"pl{k}"] == model_page_link(l, k, p), (l, k, p)
            assert r[f"tk{k}"] == model_key(l, k), (l, k)


@SETTINGS
@given(st.lists(TITLE, min_size=300, max_size=300))
def test_slugs(spark, titles):
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = df.select(S.slugify("t").alias("a"), S.slugify("t", title=True).alias("b")).collect()
    for t, r in zip(titles, got):
        assert r.a == model_slug(t, False), t
        assert r.b == model_slug(t, True), t


@SETTINGS
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \t\n\x0b\x1c\xa0 　ab")), max_size=12),
                min_size=300, max_size=300))
def test_strip_and_short(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(T.ws_trim("t").alias("s"), T.stripped_len("t").alias("n"), T.is_short("t", 5).alias("sh")).collect()
    for t, r in zip(texts, got):
        m = t.strip().replace("\n", "")
        assert (r.s, r.n, r.sh) == (t.strip(), len(m), len(m) < 5), repr(t)


@SETTINGS
@given(st.lists(st.tuples(PARAS, st.integers(0, 4), st.booleans(), st.integers(0, 400)), min_size=300, max_size=300))
def test_image_fold_closed_form(spark, rows):
    data = [(p, n, q, "x" * k) for p, n, q, k in rows]
    df = spark.createDataFrame(data, "p array<string>, n int, q boolean, t string")
    got = [r[0] for r in df.select(SEL.image_post("p", "n", "q", "t", F.lit("jeuxvideo.com"), F.lit(0),
                                                  CurationConfig())).collect()]
    assert got == [model_image(*d) for d in data]
