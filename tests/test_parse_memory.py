"""What a parsing worker holds does not follow the number of its pages."""

import gc

from threadsmith.functions import html as H
from threadsmith.operators import extract as X
from threadsmith.sources.profiles import profile_dict

PAGE = "<article>" + "".join(f"<p>post {i}<p>" for i in range(50)) + "</article>"


def _row(n):
    return dict(topic_id=str(n), page_no=1, src=0, attempt=None, domain="x", link=None, topic_key=None, html=PAGE)


def test_trees_go_with_their_page():
    profiles = profile_dict(X.TEST_LAYOUT_ROWS)
    gc.collect()
    gc.disable()
    try:
        before = sum(isinstance(o, H.Node) for o in gc.get_objects())
        found = [list(X._found_on_page(_row(n), profiles)) for n in range(20)]
        after = sum(isinstance(o, H.Node) for o in gc.get_objects())
    finally:
        gc.enable()
    assert all(len(rows) == 101 for rows in found) and after == before


def test_weight_counts_every_text():
    texts = ["x" * 100] * 50
    assert X._weight(dict(post_paragraphs=texts, contents=[dict(html="", text="", paragraphs=texts)])) > 10_000


def test_batches_are_small(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        pages = spark.createDataFrame([(str(n), 1, "x", PAGE) for n in range(300)], "topic_id string, page_no int, domain string, html string")
        assert X.extract(pages.coalesce(1), X.TEST_LAYOUT_ROWS).filter("kind = 'post'").count() == 300 * 100
        assert int(spark.conf.get(key)) <= X.PAGE_ROWS
    finally:
        spark.conf.set(key, old)
