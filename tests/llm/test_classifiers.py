import zlib

import numpy as np
from helpers import SF, awkward, empty

from corpusrisk.llm import language_id as li
from corpusrisk.llm import quality_classifier as qc
from corpusrisk.llm.common import load


def out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def plain_grams(text):
    t = f" {text} ".lower()
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_kernel_is_shared_presence():
    texts = ["Hello there", "hello hello", "日本 \U0001f600x", "a"]
    for t in texts:
        assert len(li.grams(t)) == len(plain_grams(t)) and (np.diff(li.grams(t)) > 0).all()
    model = li.fit(texts, ["x", "x", "y", "y"], landmarks=2)
    k = model.kernel(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):  # landmarks are x's two, then y's two
            want = len(plain_grams(a) & plain_grams(b)) / np.sqrt(len(plain_grams(a)) * len(plain_grams(b)))
            assert abs(k[i, j] - want) < 1e-5


def test_language_held_out_accuracy(spark):
    docs = load(spark, SF, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = li.language_id(docs).collect()
    assert len(got) == len(truth) and all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert np.mean(right) >= 0.95


def test_language_edges(spark):
    got = li.language_id(awkward(spark)).collect()
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (3, 4, 5)} == {("und", 0.0)}
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "und"}
    assert all(r.held_out == (r.doc_id is not None and out(r.doc_id)) for r in got)
    assert li.language_id(empty(spark)).collect() == []
    unlabelled = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in li.language_id(unlabelled).collect()] == [("und", 0.0)]


def test_training_never_sees_held_out_rows(spark):
    docs = load(spark, SF, "documents")
    assert not any(out(r.doc_id) for r in li.training_sample(docs).collect())
    stats = qc.document_statistics(docs.limit(300))
    assert not any(out(r.doc_id) for r in qc.training_rows(stats, load(spark, SF, "labels"), "quality").collect())


def test_trees_walk_equals_rules():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(800, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    t = qc.fit(x, y, trees=30, depth=3)
    score = t.score(x)
    assert ((score >= 0.5) == y).mean() > 0.95

    def walk(row):
        total = t.base
        for f, c, v in zip(t.feature, t.threshold, t.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > c[node])
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(score[:50], [walk(r) for r in x[:50]])
    assert np.allclose(qc.fit(x[:0], y[:0]).score(x[:3]), 0.5)
    assert (qc.fit(x[:9], np.ones(9)).score(x[:3]) > 0.9).all()


def test_quality_held_out_accuracy(spark):
    labels = load(spark, SF, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = qc.quality_scores(load(spark, SF, "documents"), labels).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    judged = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in judged]) >= 0.95


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (8, 0), (None, 1), (5, None)], "doc_id long, quality int")
    df = awkward(spark)
    got = qc.quality_scores(df, labels).collect()
    assert len(got) == df.count() and all(r.score is not None for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in qc.quality_scores(df, none).collect()} == {0.5}
    assert qc.quality_scores(empty(spark), none).collect() == []
