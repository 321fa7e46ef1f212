"""HTML parse job: site profiles A, B and archive; parser edge cases."""

from pyspark.sql import functions as F

from threadsmith.functions import html as H
from threadsmith.operators import extract as X


def run(spark, rows):
    df = spark.createDataFrame(rows, "topic_id string, link string, page_no int, html string")
    return X.split(X.extract(df))


def test_parser_edge_cases():
    r = H.parse('<div><p>a <b>bold<p>b &amp; c<!-- hidden --><script>var x="</p>";</script><br>d</div><p>e')
    assert [p.text() for p in H.select(r, "p")] == ["a bold", "b & cd", "e"]
    assert H.select_one(r, "div").html().startswith("<div><p>a <b>bold</b></p><p>b &amp; c")
    assert H.parse("<ul><li>1<li>2</ul>").text() == "12"
    assert len(H.select(H.parse("<ul><li>1<li>2</ul>"), "ul > li")) == 2
    nested = H.parse("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>")
    assert [li.text() for li in H.select(nested, "ul > li")] == ["abc", "b", "c", "d"]
    t = H.parse("<table><tr><td>1<td>2<tr><td>3</table>")
    assert [len(H.select(tr, "td")) for tr in H.select(t, "tr")] == [2, 1]


A_PAGE = ('<html><head><title>pt</title></head><body><div id="bloc-title-forum"> T </div>'
          '<div class="bloc-liste-num-page"><span>1</span><span>2</span><span>3</span><span>»</span></div>'
          '<div class="conteneur-message"><div class="bloc-header"><div class="bloc-pseudo-msg">Pseudo supprimé</div></div>'
          '<div class="txt-msg text-enrichi-forum"><p>hello</p></div></div></body></html>')
B_PAGE = ('<html><head><title>pt</title></head><body><span class="h2 text-white d-inline align-middle mb-0 mr-2">TB</span>'
          '<ul><li class="page-item">1</li><li class="page-item">7</li><li class="page-item">»</li></ul>'
          '<div class="card-body pb-0 px-3 px-md-4 pt-3"><div class="h4 text-truncate min-width-0 mb-0 text-primary">'
          '<a>auteur</a></div><div class="conteneur-message"><p>x</p></div></div>'
          '<div class="card-body pb-0 px-3 px-md-4 pt-3"><div class="h4 text-truncate min-width-0 mb-0">gone</div>'
          '<div class="conteneur-message"><a href="i">img</a></div></div></body></html>')
W_PAGE = ('<html><head><title>pt</title></head><body>'
          '<div class="entry-content"><h2>Archived title</h2><p><a>writer</a></p>'
          '<div class="txt-msg text-enrichi-forum"><p>one</p>'
          '<span class="embed-youtube"><iframe src="https://web.archive.org/web/1/https://www.youtube.com/embed/vid1?rel=0"></iframe></span></div></div>'
          '<div class="entry-content"><h2>x</h2><div><p>two</p></div></div>'
          '<div class="entry-content"><h2>x</h2><p>early</p><h2>y</h2><p>three</p><p>four</p></div>'
          '<div class="entry-content"><h2>x</h2></div>'
          '</body></html>')


def test_site_a_header(spark):
    topics, posts, q = run(spark, [("a", "https://www.jeuxvideo.com/forums/42-51-1-1-0-1-0-t.htm", 1, A_PAGE)])
    t = topics.first()
    assert (t.topic_author, t.total_pages, t.title) == ("Pseudo supprimé", 3, "T")
    assert posts.first().post_author == "Pseudo supprimé"


def test_site_b(spark):
    topics, posts, q = run(spark, [("b", "https://jvarchive.com/forums/42-51-1-1-0-1-0-t", 1, B_PAGE)])
    t = topics.first()
    assert (t.topic_author, t.total_pages, t.title) == ("auteur", 7, "TB")
    p = posts.orderBy("pos").collect()
    assert [x.post_author for x in p] == ["auteur", "gone"]
    assert (p[1].n_links, p[1].paragraphs) == (1, [])


def test_archive_fallbacks_and_frames(spark):
    topics, posts, q = run(spark, [("w", "https://web.archive.org/web/2019/https://x.org/story/", 1, W_PAGE)])
    t = topics.first()
    assert (t.topic_author, t.total_pages, t.title) == ("writer", 1, "Archived title")
    p = posts.orderBy("pos").collect()
    assert [x.paragraphs for x in p] == [["one"], ["two"], ["three", "four"]]
    assert p[2].content_html == '<div class="txt-msg text-enrichi-forum"><p>three</p><p>four</p></div>'
    assert [(r.pos, r.reason) for r in q.collect()] == [(3, "no_content")]
    out = posts.filter("pos = 0").select(X.replace_video_frames().alias("h")).first().h
    assert '<p><a href="https://www.youtube.com/watch?v=vid1">https://www.youtube.com/watch?v=vid1</a></p>' in out
    assert "iframe" not in out


def test_bad_pager_quarantined(spark):
    page = A_PAGE.replace("<span>»</span>", "<span>x</span>")
    topics, posts, q = run(spark, [("a", "https://www.jeuxvideo.com/forums/42-51-1-1-0-1-0-t.htm", 1, page)])
    assert topics.count() == 0 and [r.reason for r in q.collect()] == ["bad_pager"]


def test_deep_nesting_is_handled():
    deep = "<div>" * 5000 + "<p>x</p>" + "</div>" * 5000
    r = H.parse(deep)
    assert r.text() == "x" and len(H.select(r, "div > p")) == 1 and r.html().count("<div>") == 5000


def test_hosted_count_matches_parse(spark):
    from threadsmith.operators.select import hosted_count
    from tests.test_assets import IMAGE_POST
    from tests.test_pipeline import page
    _, posts, _ = run(spark, [("a", "https://www.jeuxvideo.com/forums/42-51-1-1-0-1-0-t.htm", 1, page([IMAGE_POST], 1))])
    r = posts.select("content_n_hosted", hosted_count("images").alias("n")).first()
    assert r.content_n_hosted == r.n == 3
