import numpy as np

from phasewright.llm.quality import FEATURES, Trees, fit_trees, keep_good, quality_scores, statistics

DOCS = "doc_id long, text string, score string, source string"


def slow_scores(model: Trees, x):
    out = []
    for row in x:
        total = model.prior
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        out.append(1 / (1 + np.exp(-total)))
    return np.array(out)


def test_trees_learn_and_flat_traversal_agrees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = fit_trees(x[:2000], y[:2000], trees=40, depth=3)
    assert ((model.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    assert np.allclose(model.scores(x[:50]), slow_scores(model, x[:50]))


def test_statistics_of_edge_texts():
    s = statistics([None, "", " \n ", "a", "x" * 10**6, "\ud800 odd"])
    assert s.shape == (6, len(FEATURES)) and np.isfinite(s).all() and not s[:2].any()


def good(i):
    return f"The {i} river runs past the old town and over the hill number {i * 7}. It was seen by many of them.\nA second line follows."


def test_table(spark):
    junk = "BUY NOW!! CLICK!! " * 5
    rows = [(i, good(i) if i % 2 else f"{junk}{i}!!", "x", "s") for i in range(400)] + [(None, good(1), None, None), (900, None, "", ""), (901, "", "", ""), (902, good(5) * 3000, "", "")]
    docs = spark.createDataFrame([*rows, rows[3]], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (3, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == 405 and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got)
    held = [g for g in got if g.held_out]
    assert len(held) > 80 and all(g.predicted == g.doc_id % 2 for g in held if g.doc_id < 400)
    assert next(g for g in got if g.doc_id is None).held_out is False
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id and r.doc_id < 400} == {*range(1, 400, 2)}
    assert quality_scores(docs.limit(0), labels).count() == 0
    assert {g.score for g in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
