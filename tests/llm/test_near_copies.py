"""Which rows stay when one row of each group of near copies is kept."""

from collections import Counter

from tests.llm.test_operators import _text
from threadsmith.llm import jaccard

SCHEMA = "doc_id long, text string, source string"


def _kept(spark, rows):
    return Counter(tuple(r) for r in jaccard.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect())


def test_null_and_repeated_ids_with_different_texts(spark):
    own = [(None, _text(60), "a") for _ in range(5)] + [(7, _text(60), "a"), (7, _text(60), "b"), (7, _text(60), None)]
    assert _kept(spark, own) == Counter(own)


def test_a_row_stays_for_its_own_group_only(spark):
    base, other = _text(200), _text(200)
    near = base + " tail"
    for a, b in ((other, near), ("zz " + other, "aa " + near), ("aa " + other, "zz " + near)):
        rows = [(3, base, "s"), (5, a, "s"), (5, b, "s")]
        assert _kept(spark, rows) == Counter([rows[0], rows[1]])


def test_one_row_of_each_component(spark):
    a, b, c = (_text(80) + " alpha beta" for _ in range(3))
    rows = [(None, a, "x"), (4, a, "x"), (2, a.replace("alpha", "ALPHA"), "x"), (2, a, "y"),      # one component, smallest id 2
            (9, b, "x"), (9, b, "x"), (9, b, "x"),                              # a repeated row
            (None, c, "x"), (None, c.replace("beta", "BETA"), "x"), (None, c, "x"), (None, c, None)]
    got = _kept(spark, rows)
    for part, ok in ((rows[:4], rows[2:4]), (rows[4:7], rows[4:7]), (rows[7:], rows[7:])):
        assert sum(got[r] for r in set(part)) == 1 and sum(got[r] for r in set(ok)) == 1
    assert sum(got.values()) == 3


def test_texts_without_words_stay(spark):
    rows = [(None, None, "x"), (None, None, "x"), (1, "", "x"), (1, "", "x"), (1, " \n\t\v", "x"), (1, "w", "x")]
    assert _kept(spark, rows) == Counter(rows)
    assert _kept(spark, []) == Counter()
