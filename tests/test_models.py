"""Models on a separable fixture, search tables, MDL discretisation, NB parameters, n-gram LM."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusrisk.operators import discretise as ds
from corpusrisk.operators import models as md
from corpusrisk.operators import ngram
from corpusrisk.operators import pooling as pl


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        y = i % 2
        x = rng.normal(2.0 * y, 0.5, size=4).tolist()
        rows.append((f"f{i}", x, y))
    df = spark.createDataFrame(rows, "file string, v array<double>, y int")
    mf = md.model_frame(df, "v", "y", pos_class_weight=2.0)
    train = F.substring("file", -1, 1).isin("0", "1", "2", "3", "4", "5")
    return mf.filter(train), mf.filter(~train)


@pytest.mark.parametrize(
    "spec",
    [
        {"type": "NaiveBayes"},
        {"type": "LR", "C": 1.0, "penalty": "l2"},
        {"type": "LR", "C": 1.0, "penalty": "l1"},
        {"type": "RandomForest", "n_estimators": 10, "criterion": "gini"},
        {"type": "SVM", "C": 1.0, "kernel": {"type": "RBF", "gamma": 0.5}, "n_fourier": 64},
        {"type": "SVM", "C": 1.0, "kernel": {"type": "linear"}},
        {"type": "AdaBoost", "n_estimators": 3},
        {"type": "GBT", "n_estimators": 5},
    ],
)
def test_estimators_separate(spark, frames, spec):
    tr, te = frames
    m, ex = md.train_and_evaluate(tr, te, spec)
    r = m.first()
    assert r["roc_auc"] > 0.9 and 0.0 <= r["average_precision"] <= 1.0
    s = [x["score"] for x in ex.collect()]
    assert all(0.0 <= v <= 1.0 for v in s)


def test_same_seed_same_predictions(spark, frames):
    tr, te = frames
    spec = {"type": "RandomForest", "n_estimators": 5, "criterion": "entropy"}
    a = sorted(tuple(r) for r in md.fit_predict(tr, te, spec, seed=3).collect())
    b = sorted(tuple(r) for r in md.fit_predict(tr, te, spec, seed=3).collect())
    assert a == b


def test_invalid_spec_raises():
    with pytest.raises(ValueError):
        md.make_estimator({"type": "Perceptron"})


def test_mdl_finds_separating_cut(spark):
    rows = [(float(v), "A" if v < 50 else "B", float(v % 7)) for v in range(100)]
    df = spark.createDataFrame(rows, "x double, y string, noise double")
    cuts = {(r["feature"], r["cut"]) for r in ds.fit_cuts(df, ["x", "noise"], "y").collect()}
    assert ("x", 49.5) in cuts and not any(f == "noise" for f, _ in cuts)
    out = ds.apply_cuts(df, ds.fit_cuts(df, ["x"], "y"))
    assert "x_gt_49.5" in out.columns
    assert ds.useless_columns(out.withColumn("k", F.lit(1)), ["k", "x"]) == ["k"]


def test_log2_factorial_matches_lgamma(spark):
    import math

    df = spark.range(0, 400).select(F.col("id").alias("n"))
    got = [r[1] for r in df.select("n", ds.log2_factorial(F.col("n"))).orderBy("n").collect()]
    exp = [math.lgamma(n + 1) / math.log(2) for n in range(400)]
    assert np.allclose(got, exp, rtol=1e-12, atol=1e-9)


def test_nb_params_match_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3))
    y = (rng.random(60) < 0.4).astype(int)
    w = np.where(y == 1, 2.0, 1.0)
    df = spark.createDataFrame([(x[i].tolist(), int(y[i]), float(w[i])) for i in range(60)], "v array<double>, y int, w double")
    got = {(r["y"], r["dim"]): r for r in pl.gaussian_nb_params(df, "y", "v", "w").collect()}
    eps = 1e-9 * x.var(axis=0).max()
    for c in (0, 1):
        m = y == c
        mu = np.average(x[m], axis=0, weights=w[m])
        var = np.average((x[m] - mu) ** 2, axis=0, weights=w[m]) + eps
        for d in range(3):
            assert got[(c, d)]["theta"] == pytest.approx(mu[d]) and got[(c, d)]["sigma"] == pytest.approx(var[d])
        assert got[(c, 0)]["prior"] == pytest.approx(w[m].sum() / w.sum())


def test_ngram_lm_prefers_seen_bigrams(spark):
    # doc_ord 0..99: training except 0..4 (validation); every document is 1 2 1 2 ...
    rows = [(d, p, 1 + p % 2, (1 + (p + 1) % 2) if p < 9 else 0) for d in range(100) for p in range(10)]
    ids = spark.createDataFrame(rows, "doc_ord long, pos int, id int, next_id int")
    model = ngram.fit(ids, vocab_size=4)
    ce = {r["doc_ord"]: r["cross_entropy"] for r in ngram.document_cross_entropy(model, ids).collect()}
    assert set(ce) == {0, 1, 2, 3, 4} and all(v < 1.0 for v in ce.values())
    top = {r["v"]: r["top_next"] for r in ngram.top_next(model).collect()}
    assert top[1] == 2 and top[2] == 1


def test_objective_history(spark, frames):
    from pyspark.ml.classification import LogisticRegression, NaiveBayes

    tr, _ = frames
    h = md.objective_history(spark, LogisticRegression(featuresCol=md.FEATURES, labelCol=md.LABEL, maxIter=5).fit(tr))
    assert h.columns == ["iteration", "loss"] and h.count() >= 1
    assert md.objective_history(spark, NaiveBayes(modelType="gaussian", featuresCol=md.FEATURES, labelCol=md.LABEL).fit(tr)).count() == 0


def test_learning_curve_refuses_a_size_above_the_rows(spark, frames):
    with pytest.raises(ValueError, match="1000 rows"):
        md.learning_curve(*frames, {"type": "LR", "C": 1.0}, sizes=[30, 1000], runs=1)


def test_learning_curve_draws_a_sample_per_run(spark, frames):
    tr, _ = frames
    got = md.run_samples(tr, [10, 40], 2).select("run", "file", "_r").collect()
    first = [sorted(r["file"] for r in got if r["run"] == k) for k in (0, 1)]
    assert len(first[0]) == len(first[1]) == 40 and first[0] != first[1]
    assert sorted(r["_r"] for r in got if r["run"] == 0) == list(range(1, 41))


def test_learning_curve_fits_in_tasks_agree_with_the_estimator(spark, frames):
    tr, te = frames
    spec = {"type": "LR", "C": 1.0, "penalty": "l2"}
    curve = {(r["run"], r["training_examples"], r["metric"]): r["score"] for r in md.learning_curve(tr, te, spec, sizes=[30, 200], runs=2).collect()}
    assert len(curve) == 8
    sample = md.run_samples(tr, [30, 200], 2).filter("run = 1 AND _r <= 30").drop("run", "_r")
    m = md.train_and_evaluate(sample, te, spec)[0].first()
    assert abs(curve[(1, 30, "precision")] - m["precision"]) < 1e-9 and abs(curve[(1, 30, "recall")] - m["recall"]) < 1e-9


def test_forest_rows_remember_their_nodes():
    assert md.make_estimator({"type": "RandomForest"}).getCacheNodeIds()


def test_large_forest_is_fitted_in_groups(spark, frames, monkeypatch):
    train, test = frames
    test, made, plain = test.unionByName(test), [], md.make_estimator
    monkeypatch.setattr(md, "FOREST_NODES", 2 * train.count() * 3)  # three trees a group
    monkeypatch.setattr(md, "make_estimator", lambda spec, *a, **k: made.append((spec["n_estimators"], k["seed"])) or plain(spec, *a, **k))
    got = md.fit_predict(train, test, {"type": "RandomForest", "n_estimators": 8, "criterion": "gini"}, seed=5)
    rows = got.collect()
    assert [n for n, _ in made] == [3, 3, 2] and len({s for _, s in made}) == 3
    assert len(rows) == test.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert sum((r["score"] > 0.5) == (r["label"] == 1) for r in rows) > 0.8 * len(rows)
