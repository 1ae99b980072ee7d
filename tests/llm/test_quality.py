import numpy as np
import pytest

from tessella.llm import quality as Q

COMMON = frozenset("the of and is a to in".split())
PROSE = "The owner of the farm is asked to answer in full. The teacher of the village is absent, and the list is read again. "
LIST = "- the market\n- the seed\n- fuel and water\n- household\n" * 4
TABLE = "item,price,share\nseed,12.5,n/a\nfuel,,33.1%\nwater,4,5.5\n" * 5
JUNK = "kq|w; v~mfgq; ~~c !blm..j tx|spfs| nrkg! k~bxd;nfwc\n" * 6


@pytest.mark.parametrize("text, form", [(PROSE * 4, "prose"), (LIST, "list"), (TABLE, "table"), (JUNK, "junk"), ("." * 400, "junk"), ("Qz9" * 120, "junk"), ("[ ][ ][ ][ ][ ][ ]\n" * 9, "junk"), ("x menu close save " * 30, "junk"), (PROSE * 6 + LIST[:40], "prose"), ("The list is here.\n" + LIST, "list")])
def test_weak_forms(text, form):
    assert Q.FORMS[Q.weak_forms(np.array([Q.statistics(text, COMMON)]))[0]] == form


def test_statistics_of_nothing():
    for text in (None, "", " \n  "):
        s = Q.statistics(text, COMMON)
        assert s[1:] == [0.0] * (len(Q.STATISTICS) - 1) and s[0] == len(text or "")
    assert all(np.isfinite(Q.statistics(t, COMMON)).all() for t in ("...", "a", "\r\n\r\n.", "|", "1 2 3", "́", "🌾"))


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.random((1500, len(Q.STATISTICS)))
    y = np.where(x[:, 2] > 0.6, 1, np.where(x[:, 5] + x[:, 7] > 1.2, 2, 0))
    trees = Q.Trees().fit(x[:1000], y[:1000])
    before = trees.probabilities(x[1000:])
    assert (before.argmax(1) == y[1000:]).mean() > 0.95
    trees.calibrate(x[1000:1250], y[1000:1250])
    p = trees.probabilities(x[1250:])
    loss = lambda q: -np.log(np.maximum(q[np.arange(250), y[1250:]], 1e-9)).mean()
    assert np.allclose(p.sum(1), 1) and loss(p) < loss(before[250:]) + 0.05


def test_held_out_accuracy(spark, sf):
    """Against hand labels of documents; some labels are wrong, so 0.95 is near their own accuracy."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    forms = Q.document_forms(read("documents"), read("doc_labels"), read("word_list"))
    labels = read("doc_labels").filter("doc_form is not null").select("doc_id", "doc_form").distinct().withColumnRenamed("doc_form", "label")
    rows = forms.filter("doc_form is not null").join(labels, "doc_id").collect()
    assert sum(r.doc_form == r.label for r in rows) / len(rows) > 0.93
    assert all(abs(r.prose + r.list + r.table + r.junk - 1) < 1e-6 for r in rows)


def test_operator_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, PROSE * 3), (4, PROSE * 3), (5, LIST * 3000), (6, TABLE)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as form", "1 as draw", "2 as prose")
    labels = spark.createDataFrame([(4, "prose"), (4, "list"), (5, None), (6, "odd"), (6, "table")], "doc_id long, doc_form string")
    words = spark.createDataFrame([("the", "en", True), (None, "en", True)], "word string, lang string, is_common boolean")
    out = sorted((r.doc_id, r.doc_form or "") for r in Q.document_forms(documents, labels, words).collect())
    assert out == [(1, ""), (2, ""), (3, ""), (4, "prose"), (4, "prose"), (5, "list"), (6, "table")]
    assert Q.document_forms(documents.limit(0), labels, words).count() == 0
    assert Q.text_statistics(documents, words.limit(0)).count() == len(rows)


def test_trees_do_not_see_what_the_weak_label_is_made_of():
    import numpy as np

    x = np.random.default_rng(1).random((400, len(Q.STATISTICS)))
    y = x[:, Q.STATISTICS.index("digit_ratio")] > 0.5
    trees = Q.Trees().fit(x[:, Q.FEATURES], y.astype(int))
    other = x.copy()
    other[:, [Q.STATISTICS.index(s) for s in Q.TOLD]] = 0
    assert (trees.probabilities(x[:, Q.FEATURES]) == trees.probabilities(other[:, Q.FEATURES])).all()
    assert len(Q.FEATURES) == len(Q.STATISTICS) - len(Q.TOLD)
