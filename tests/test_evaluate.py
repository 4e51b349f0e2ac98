"""Evaluation operators on the hand-written six-row case (AP = 0.7556) and edge cases."""

import pytest
from pyspark.sql import functions as F

from corpusrisk.operators import evaluate as ev
from corpusrisk.operators import report as rp

SIX = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6), (1, 0.2), (0, 0.1)]


def _df(spark, rows, run="r"):
    return spark.createDataFrame([(run, i, y, s) for i, (y, s) in enumerate(rows)], "run string, id int, label int, score double")


def test_average_precision_and_auc(spark):
    pts = ev.curve_points(_df(spark, SIX), ["run"])
    m = ev.ranking_metrics(pts, ["run"]).first()
    assert m["average_precision"] == pytest.approx((1 / 3) * 1 + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 5), abs=1e-9)
    assert round(m["average_precision"], 4) == 0.7556
    # AUC: positive/negative pairs ranked correctly: (0.9>all 3), (0.7>0.6,0.1), (0.2>0.1) = 6 of 9
    assert m["roc_auc"] == pytest.approx(6 / 9)


def test_ties_counted_half(spark):
    rows = [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)]
    m = ev.ranking_metrics(ev.curve_points(_df(spark, rows), ["run"]), ["run"]).first()
    assert m["roc_auc"] == pytest.approx((1 + 0.5 + 1 + 1) / 4)


def test_one_class(spark):
    m = ev.ranking_metrics(ev.curve_points(_df(spark, [(0, 0.3), (0, 0.7)]), ["run"]), ["run"]).first()
    assert m["roc_auc"] is None and m["average_precision"] == 0.0


def test_pr_curve_and_end_point(spark):
    c = ev.pr_curve(ev.curve_points(_df(spark, SIX), ["run"]), ["run"]).orderBy("is_end", "threshold").collect()
    assert [r["threshold"] for r in c] == [0.1, 0.2, 0.6, 0.7, 0.8, 0.9, 1.0]
    assert c[-1]["precision"] == 1.0 and c[-1]["recall"] == 0.0
    assert c[0]["recall"] == 1.0 and c[0]["precision"] == 0.5
    cut = ev.pr_curve(ev.curve_points(_df(spark, SIX), ["run"]), ["run"], drop_after_full_recall=True).filter(~F.col("is_end"))
    assert sorted(r["threshold"] for r in cut.collect()) == [0.2, 0.6, 0.7, 0.8, 0.9]


def test_prediction_half_is_negative(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,)], "score double")
    assert [r[0] for r in df.select(ev.predicted_class("score")).collect()] == [0, 1]


def test_prf_zero_division(spark):
    df = _df(spark, [(1, 0.1), (0, 0.2)]).withColumn("pred", ev.predicted_class("score"))
    r = ev.prf(ev.confusion(df, ["run"])).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (0, 0, 1, 1)
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0 and r["accuracy"] == 0.5


def test_unknown_class_raises(spark):
    df = _df(spark, [(2, 0.1)]).withColumn("pred", F.lit(0))
    with pytest.raises(Exception):
        ev.confusion(df, ["run"]).collect()


def test_value_at_reference_ties_lowest_threshold(spark):
    # recall 0.5 holds at thresholds 0.9 (precision 1) and 0.8 (precision 0.5): the lower wins
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)]
    curve = ev.pr_curve(ev.curve_points(_df(spark, rows), ["run"]), ["run"])
    ref = spark.createDataFrame([("r", 0.4)], "run string, reference_score double")
    v = ev.value_at_reference(curve, ["run"], ref, ["run"], "recall").first()
    assert v["metric"] == "precision" and v["value"] == pytest.approx(0.5)
    # an exact tie between recall 0.5 and 1.0 also goes to the lowest threshold (0.6)
    ref2 = spark.createDataFrame([("r", 0.75)], "run string, reference_score double")
    assert ev.value_at_reference(curve, ["run"], ref2, ["run"], "recall").first()["value"] == pytest.approx(0.5)
    ref3 = spark.createDataFrame([("r", 0.6)], "run string, reference_score double")
    v3 = ev.value_at_reference(curve, ["run"], ref3, ["run"], "precision").first()
    assert v3["metric"] == "recall" and v3["value"] == pytest.approx(1.0)


def test_alert_volume_and_means(spark):
    curve = spark.createDataFrame([("a", 0.5, 0.4, 0.5, False), ("b", 0.5, 0.8, 0.25, False)], "run string, threshold double, precision double, recall double, is_end boolean")
    v = rp.alert_volume(curve, vulnerable_files=100.0)
    rows = {r["run"]: r for r in v.collect()}
    assert rows["a"]["true_positives"] is None
    assert rows["b"]["true_positives"] == pytest.approx(25.0) and rows["b"]["false_positives"] == pytest.approx(25.0 * 0.25)
    m = rp.threshold_means(v).first()
    assert m["precision"] == pytest.approx(0.6) and m["true_positives"] == pytest.approx(25.0)


def test_exact_quantiles_match_percentile(spark):
    import numpy as np

    vals = [float(x) for x in np.random.default_rng(3).integers(0, 50, 101)]
    df = spark.createDataFrame([("g", v) for v in vals] + [("h", 1.0), ("h", 3.0)], "g string, v double")
    q = {r["g"]: r for r in rp.exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75]).collect()}
    assert q["g"]["q0"] == pytest.approx(np.percentile(vals, 25)) and q["g"]["q2"] == pytest.approx(np.percentile(vals, 75))
    assert q["h"]["q1"] == pytest.approx(2.0)


def test_best_run_ties_and_zero(spark):
    df = spark.createDataFrame([("s", "b", 0.5), ("s", "a", 0.5), ("t", "x", 0.0)], "split string, run string, average_precision double")
    out = {r["split"]: r["best_run"] for r in rp.best_run(df, ["split"]).collect()}
    assert out == {"s": "a"}


def _brute(labels, scores):
    """Step-wise AP and tie-aware AUC by brute force over all thresholds and pairs."""
    import numpy as np

    y, s = np.asarray(labels), np.asarray(scores)
    P, N = y.sum(), len(y) - y.sum()
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        sel = s >= t
        tp = (y[sel] == 1).sum()
        r = tp / P
        ap += (r - prev_r) * tp / sel.sum()
        prev_r = r
    pos, neg = s[y == 1], s[y == 0]
    auc = sum(((p > neg).sum() + 0.5 * (p == neg).sum()) for p in pos) / (P * N)
    return ap, auc


def test_metrics_on_hot_run_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    n = 3000
    runs = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b"], n))
    y = (rng.random(n) < 0.3).astype(int)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)  # many ties
    df = spark.createDataFrame([(str(r), int(i), int(a), float(b)) for i, (r, a, b) in enumerate(zip(runs, y, s))], "run string, id int, label int, score double")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r["run"]: r for r in ev.ranking_metrics(ev.curve_points(df, ["run"]), ["run"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for run in ("hot", "a", "b"):
        m = runs == run
        ap, auc = _brute(y[m], s[m])
        assert got[run]["average_precision"] == pytest.approx(ap, abs=1e-9)
        assert got[run]["roc_auc"] == pytest.approx(auc, abs=1e-9)
