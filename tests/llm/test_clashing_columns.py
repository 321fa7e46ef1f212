"""Columns of the input may have the names that operators use inside."""

from threadsmith.llm import jaccard, suffixes

NAMES = ["_row", "n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256", "_spans", "_ask", "_doc", "cls", "label"]


def test_rows_keep_their_own_columns(spark):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(i, t, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate([long, "other text here", long, None, "", long[:400]])]
    d = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES))
    want = {r[0]: r[2:] for r in rows}
    one = jaccard.one_of_each(d).collect()
    assert sorted(r.doc_id for r in one) == [0, 1, 3, 4, 5]
    kept = suffixes.without_repeats(d, length=60, window=16)
    assert kept.columns == d.columns
    kept = kept.collect()
    assert {r.doc_id for r in kept} >= {1, 3, 4}
    for r in [*one, *kept]:
        assert tuple(r)[2:] == want[r.doc_id]
