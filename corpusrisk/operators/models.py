"""Classifiers, evaluation runs and searches (job F) on Spark ML.

A model spec is the reference's dict (``{"type": "RandomForest", "n_estimators": 100,
"criterion": "gini"}`` ...).  Every estimator trains distributed with a ``weightCol``
(``w = y * pos_class_weight + 1 - y``) and is scored with the exact ranking metrics of
:mod:`corpusrisk.operators.evaluate`.  Custom pieces: AdaBoost (weighted stumps, weights
updated by column expressions) and kernel SVMs, exact by a cascade or approximate by random Fourier
features (Rahimi & Recht 2007), with Platt scaling (Platt 1999).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusrisk.functions import rand
from corpusrisk.operators import evaluate as ev
from corpusrisk.operators import svm
from corpusrisk.session import pin

FEATURES, LABEL, WEIGHT = "features", "label", "weight"

# Defaults; every one is a spec entry or an argument.  A forest grows to the greatest depth Spark
# builds; boosted trees stay small, as each only mends what the others leave.
FOREST_TREES, FOREST_DEPTH, BOOSTED_DEPTH, TREE_BINS = 100, 30, 5, 32
FOREST_NODES = 2_000_000  # the driver holds the trees of one fit: a tree has fewer than two nodes per distinct vector
BOOSTING_ROUNDS = 50
MAX_ITER = 200  # of the linear models, unless the spec has ``max_iter``
SEARCH_TRIALS = 100
RUNS_PER_SPLIT = 10
LEARNING_CURVE_RUNS, LEARNING_CURVE_SIZES = 50, (100, 500, 1000, 2000, 5000, 10000)


# ---------------------------------------------------------------------------------------------- data


def model_frame(df: DataFrame, vector: str | Column, label: str = "y", pos_class_weight: float = 1.0, id_col: str = "file", keep: Sequence[str] = ()) -> DataFrame:
    """``(file, features VECTOR, label DOUBLE, weight)`` and the columns ``keep``, from an ARRAY<DOUBLE/FLOAT> column
    (``fn_stack``: all rows must have the same width, checked by the caller's assertion)."""
    v = F.col(vector) if isinstance(vector, str) else vector
    y = F.col(label).cast("double")
    return df.select(
        F.col(id_col).alias("file"),
        array_to_vector(F.transform(v, lambda x: x.cast("double"))).alias(FEATURES),
        y.alias(LABEL),
        ev.sample_weight(y, pos_class_weight).alias(WEIGHT),
        *keep,
    )


def assert_equal_width(df: DataFrame, vector: str) -> int:
    """``fn_stack`` width check: one distinct vector width or an error."""
    widths = df.select(F.size(vector).alias("w")).distinct().limit(2).collect()
    if len(widths) != 1:
        raise ValueError(f"vectors of different widths: {[r['w'] for r in widths]}")
    return widths[0]["w"]


# ---------------------------------------------------------------------------------------------- estimators


def make_estimator(spec: dict, n_rows: float | None = None, seed: int = 1):
    """``ml_fit_eval`` factory: spec -> Spark ML estimator; an unknown type raises."""
    t = spec.get("type")
    common = dict(featuresCol=FEATURES, labelCol=LABEL)
    tree = dict(maxDepth=int(spec.get("max_depth", FOREST_DEPTH if t == "RandomForest" else BOOSTED_DEPTH)), maxBins=int(spec.get("max_bins", TREE_BINS)))
    if t == "NaiveBayes":
        return NaiveBayes(modelType="gaussian", weightCol=WEIGHT, **common)
    if t == "LR":
        # C * sum(loss) + penalty  ==  (1/n) sum(loss) + (1/(C n)) penalty
        reg = 1.0 / (float(spec["C"]) * float(n_rows or 1.0))
        l1 = spec.get("penalty", "l2") == "l1"
        return LogisticRegression(regParam=reg, elasticNetParam=1.0 if l1 else 0.0, standardization=False, weightCol=WEIGHT, maxIter=int(spec.get("max_iter", MAX_ITER)), **common)
    if t == "RandomForest":
        # a row remembers its node of each tree, else every pass over the rows goes down all deep trees from their roots
        return RandomForestClassifier(numTrees=int(spec.get("n_estimators", FOREST_TREES)), impurity=spec.get("criterion", "gini"), weightCol=WEIGHT, seed=seed, cacheNodeIds=True, **tree, **common)
    if t == "GBT":
        extra = {"validationIndicatorCol": spec["validation_col"]} if spec.get("validation_col") else {}
        return GBTClassifier(maxIter=int(spec.get("n_estimators", FOREST_TREES)), weightCol=WEIGHT, seed=seed, **tree, **extra, **common)
    if t in ("SVM", "AdaBoost"):
        return spec  # trained by fit_svm / fit_adaboost below
    raise ValueError(f"invalid classifier type in spec: {spec}")


def _p1(pred: DataFrame) -> DataFrame:
    return pred.withColumn("score", vector_to_array("probability")[1])


def _forest_by_groups(train: DataFrame, test: DataFrame, spec: dict, seed: int, trees: int, group: int) -> DataFrame:
    """Scores of a forest of ``trees`` trees, fitted and scored ``group`` at a time, so that the driver and a task
    hold one group's nodes.  A forest's probability is the mean of its trees' ones, each grown from its own draw
    of rows: the groups' mean, weighted by their trees, is that of the whole forest."""
    train, rows = pin(train), pin(test.withColumn("_row", F.monotonically_increasing_id()))
    votes = None
    for k, start in enumerate(range(0, trees, group)):
        n = min(group, trees - start)
        model = make_estimator({**spec, "n_estimators": n}, seed=seed + 1_000_003 * k).fit(train)
        one = pin(_p1(model.transform(rows)).select("_row", (F.col("score") * F.lit(n / trees)).alias("score")))
        votes = one if votes is None else votes.unionByName(one)
    return rows.join(votes.groupBy("_row").agg(F.sum("score").alias("score")), "_row").select("file", LABEL, "score")


def fit_predict(train: DataFrame, test: DataFrame, spec: dict, seed: int = 1) -> DataFrame:
    """Fit on ``train`` (weighted), return ``test`` with ``score`` = P(class 1)."""
    t = spec.get("type")
    if t == "SVM":
        return fit_svm(train, test, spec, seed)
    if t == "AdaBoost":
        return fit_adaboost(train, test, int(spec.get("n_estimators", BOOSTING_ROUNDS)), seed)
    if t == "RandomForest":
        trees = int(spec.get("n_estimators", FOREST_TREES))
        leaves = min(train.select(F.xxhash64(FEATURES).alias("h")).distinct().count(), 2 ** int(spec.get("max_depth", FOREST_DEPTH)))
        group = max(1, FOREST_NODES // max(1, 2 * leaves))
        if group < trees:
            return _forest_by_groups(train, test, spec, seed, trees, group)
    n = train.agg(F.sum(WEIGHT)).first()[0] if t == "LR" else None
    model = make_estimator(spec, n, seed).fit(train)
    return _p1(model.transform(test)).select("file", LABEL, "score")


def evaluate_scores(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Test metrics of ``(keys, label, score)``: roc_auc, average_precision, precision, recall,
    f1, accuracy, confusion counts (prediction = score > 0.5)."""
    keys = list(keys) or ["_all"]
    s = scored.withColumn("_all", F.lit(1)) if keys == ["_all"] else scored
    s = s.withColumn("y", F.col(LABEL).cast("int")).withColumn("pred", ev.predicted_class("score"))
    conf = ev.prf(ev.confusion(s, keys, label="y", pred="pred"))
    rank = ev.ranking_metrics(ev.curve_points(s, keys, label="y", score="score"), keys)
    out = conf.join(rank, keys)
    return out.drop("_all") if keys == ["_all"] else out


def train_and_evaluate(train: DataFrame, test: DataFrame, spec: dict, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """``ml_fit_eval``: ``(metrics, examples)``; examples = ``ev_examples`` (file, label, score)."""
    scored = pin(fit_predict(train, test, spec, seed))
    return evaluate_scores(scored), scored


# ---------------------------------------------------------------------------------------------- SVM


def random_fourier_features(df: DataFrame, dim_in: int, n_features: int, gamma: float, seed: int = 1) -> DataFrame:
    """RBF kernel map ``z(x) = sqrt(2/D) cos(Wx + b)``, W ~ N(0, 2 gamma), b ~ U(0, 2 pi).  The
    D x d matrix is a fixed parameter (shipped in the closure); the product runs per Arrow batch."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(dim_in, n_features))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_features)
    scale = math.sqrt(2.0 / n_features)
    arr = df.withColumn("_x", vector_to_array(FEATURES))
    out_schema = T.StructType([f for f in arr.schema.fields if f.name not in (FEATURES, "_x")] + [T.StructField("_z", T.ArrayType(T.DoubleType()))])

    def _map(batches):
        for pdf in batches:
            x = np.stack(pdf["_x"].to_numpy()) if len(pdf) else np.zeros((0, dim_in))
            z = scale * np.cos(x @ w + b)
            res = pdf.drop(columns=[FEATURES, "_x"])
            res["_z"] = list(z)
            yield res

    return arr.mapInPandas(_map, out_schema).withColumn(FEATURES, array_to_vector("_z")).drop("_z")


def fit_svm(train: DataFrame, test: DataFrame, spec: dict, seed: int = 1) -> DataFrame:
    """``ml_svm``: a kernel machine by a cascade (:mod:`corpusrisk.operators.svm`), or with ``n_fourier`` in the
    spec an approximate one of linear size: a linear SVM on random Fourier features.  The linear kernel
    is Spark's own.  Probability by a logistic fit on the training margins (Platt scaling).  As in the
    reference, gamma is used only when the kernel type is spelled ``'RBF'``; otherwise ``'auto'`` = 1 /
    n_features."""
    kernel = spec.get("kernel", {"type": "linear"})
    if kernel.get("type", "linear").lower() == "rbf":
        d = len(train.select(FEATURES).first()[0])
        gamma = float(kernel.get("gamma") if kernel.get("type") == "RBF" else 1.0 / d)
        if "n_fourier" not in spec:
            dense = lambda df: df.select("*", vector_to_array(FEATURES).alias("x"))
            both = svm.margins(dense(train).drop(FEATURES), dense(test).drop(FEATURES), float(spec.get("C", 1.0)), "rbf", gamma, label=LABEL, weight=WEIGHT)
            return _platt(*(df.withColumn("m", array_to_vector(F.array("f"))) for df in both))
        nf = int(spec["n_fourier"])
        train, test = random_fourier_features(train, d, nf, gamma, seed), random_fourier_features(test, d, nf, gamma, seed)
    n = train.agg(F.sum(WEIGHT)).first()[0]
    model = LinearSVC(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, regParam=1.0 / (float(spec.get("C", 1.0)) * n), maxIter=int(spec.get("max_iter", MAX_ITER))).fit(train)
    margin = lambda df: model.transform(df).withColumn("m", array_to_vector(F.array(vector_to_array("rawPrediction")[1])))
    return _platt(margin(train), margin(test))


def _platt(train: DataFrame, test: DataFrame) -> DataFrame:
    """Scores of ``test`` from a logistic fit on the margins ``m`` of ``train``."""
    platt = LogisticRegression(featuresCol="m", labelCol=LABEL, weightCol=WEIGHT, regParam=0.0).fit(train.select("m", LABEL, WEIGHT))
    return _p1(platt.transform(test.select("file", LABEL, "m"))).select("file", LABEL, "score")


# ---------------------------------------------------------------------------------------------- AdaBoost


def _stump_rule(model) -> tuple[int, float, float, float]:
    """Feature, threshold, class up to the threshold and class above it, of a depth-1 tree."""
    root = model._java_obj.rootNode()
    if model.depth == 0:
        return 0, math.inf, root.prediction(), root.prediction()
    return root.split().featureIndex(), root.split().threshold(), root.leftChild().prediction(), root.rightChild().prediction()


def _stump_class(rule: tuple[int, float, float, float]) -> Column:
    feature, threshold, low, high = rule
    return F.when(F.col("_x")[feature] <= F.lit(threshold), F.lit(low)).otherwise(F.lit(high))


def fit_adaboost(train: DataFrame, test: DataFrame, n_estimators: int, seed: int = 1) -> DataFrame:
    """``ml_ada``: discrete AdaBoost (SAMME, two classes) of weighted depth-1 trees.  A fitted stump
    is one threshold, so a row's weight is an expression over the stumps so far: the training rows
    are pinned once, no round writes anything, and the plan stays one projection deep.
    P(class 1) = sigmoid(sum_m alpha_m h_m(x) / sum_m alpha_m), h in {-1, 1}."""
    rows = pin(train.withColumn("_x", vector_to_array(FEATURES)))
    rules: list[tuple[float, tuple]] = []
    boost = F.lit(0.0)
    for m in range(n_estimators):
        weighed = rows.withColumn("_w", F.col(WEIGHT) * F.exp(boost))
        rule = _stump_rule(DecisionTreeClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol="_w", maxDepth=1, seed=seed + m).fit(weighed))
        miss = (_stump_class(rule) != F.col(LABEL)).cast("double")
        err = weighed.agg(F.sum(F.col("_w") * miss) / F.sum("_w")).first()[0]
        if err >= 0.5:
            break
        alpha = math.log((1.0 - err) / err) if err > 0 else 1.0
        rules.append((alpha, rule))
        if err <= 0:
            break
        boost = boost + F.lit(alpha) * miss
    if not rules:
        return test.select("file", LABEL, F.lit(0.5).alias("score"))
    vote = sum((F.lit(alpha) * (_stump_class(rule) * 2 - 1) for alpha, rule in rules), F.lit(0.0))
    total = sum(alpha for alpha, _ in rules)
    scored = test.withColumn("_x", vector_to_array(FEATURES))
    return scored.select("file", LABEL, (F.lit(1.0) / (F.lit(1.0) + F.exp(-vote / F.lit(total)))).alias("score"))


# ---------------------------------------------------------------------------------------------- search and runs


def reweighted(frame: DataFrame, pos_class_weight: float) -> DataFrame:
    """``frame`` with its weight column drawn anew for another weight of class 1."""
    return frame.withColumn(WEIGHT, ev.sample_weight(LABEL, float(pos_class_weight)))


def tried_specs(data: dict[str, tuple[DataFrame, DataFrame]], to_spec, seed: int = 1, parallelism: int = 8, data_key: str = "pooling"):
    """An ``evaluate`` for :func:`corpusrisk.operators.tpe.search`: the loss ``1 - average precision`` of
    every trial of a batch.

    ``data`` maps the trial's ``data_key`` to its pinned ``(train, valid)`` frames.  Every trial trains on
    the cluster, ``parallelism`` of them at a time, and the scores of all trials of the batch go into
    one table keyed by trial, which is evaluated at once.  A trial's ``pos_class_weight`` weighs its
    training rows.  A spec that no estimator takes is recorded with its error; any other failure - a
    lost executor, memory - ends the search.  A batch is a few rows: the driver goes through them,
    never through the data."""
    from functools import reduce
    from multiprocessing.pool import ThreadPool

    def one(row) -> tuple:
        try:
            spec = to_spec(row.asDict())
            train, valid = data[row[data_key]] if data_key in row else next(iter(data.values()))
            weighed = reweighted(train, spec["pos_class_weight"]) if "pos_class_weight" in spec else train
            return row["trial"], fit_predict(weighed, valid, spec, seed).select(F.lit(row["trial"]).alias("trial"), LABEL, "score"), None
        except (ValueError, KeyError, TypeError) as e:
            return row["trial"], None, str(e)

    def evaluate(trials: DataFrame) -> DataFrame:
        spark = trials.sparkSession
        with ThreadPool(parallelism) as pool:
            out = pool.map(one, trials.collect())
        errors = spark.createDataFrame([(t, e) for t, _, e in out], "trial long, error string")
        scored = [s for _, s, _ in out if s is not None]
        if not scored:
            return errors.select("trial", F.lit(None).cast("double").alias("loss"), "error")
        rank = ev.ranking_metrics(ev.curve_points(pin(reduce(DataFrame.unionByName, scored)).withColumn("y", F.col(LABEL).cast("int")), ["trial"], label="y", score="score"), ["trial"])
        return errors.join(rank.select("trial", (1 - F.col("average_precision")).alias("loss")), "trial", "left").select("trial", "loss", "error")

    return evaluate


def repeat_runs(train: DataFrame, test: DataFrame, spec: dict, runs: int = RUNS_PER_SPLIT, split: str = "") -> tuple[DataFrame, DataFrame]:
    """``ml_repeat_runs``: k runs of one spec on prepared (pinned) data, seed = run number;
    ``(metrics per run, examples per run)`` with a reproducible run id."""
    from corpusrisk.operators.report import run_id

    tr, te = pin(train), pin(test)
    metrics, examples = [], []
    for k in range(runs):
        m, ex = train_and_evaluate(tr, te, spec, seed=k + 1)
        rid = run_id(F.lit(split), F.lit(k))
        metrics.append(m.withColumn("split", F.lit(split)).withColumn("run", rid))
        examples.append(ex.withColumn("split", F.lit(split)).withColumn("run", rid))
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    return union(metrics), union(examples)


def run_samples(train: DataFrame, sizes: Sequence[int], runs: int, seed: int = 1) -> DataFrame:
    """``train`` rows with ``run`` and ``_r``, the 1-based rank of the row in that run's own random
    order, up to the largest size.

    Only rows whose hash lies below a generous threshold are ranked, so a run's window holds about
    the largest size of rows, not the table; if that ever left a run short, all rows are ranked."""
    n, most = train.count(), max(sizes)
    keyed = train.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("_u", rand.uniform(seed, F.col("run"), F.col("file").cast("string")))
    by_run = Window.partitionBy("run").orderBy("_u", "file")
    share = min(1.0, (1.5 * most + 1000) / max(1, n))
    near = keyed.filter(F.col("_u") < share) if share < 1.0 else keyed
    if share < 1.0 and near.groupBy("run").count().filter(F.col("count") < most).count():
        near = keyed
    return near.withColumn("_r", F.row_number().over(by_run)).filter(F.col("_r") <= most).drop("_u")


def _newton_lr(x: np.ndarray, y: np.ndarray, w: np.ndarray, reg: float) -> np.ndarray:
    """Weighted logistic regression with an L2 penalty on all but the intercept (last entry)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], reg)
    penalty[-1] = 0.0
    beta, total = np.zeros(x.shape[1]), w.sum()
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -35, 35)))
        grad = x.T @ (w * (p - y)) / total + penalty * beta
        if np.abs(grad).max() < 1e-9:
            break
        hess = (x * (w * p * (1 - p))[:, None]).T @ x / total + np.diag(penalty + 1e-10)
        beta = beta - np.linalg.solve(hess, grad)
    return beta


LEARNING_CURVE_TEST_ROWS = 20_000


def learning_curve(
    train: DataFrame,
    test: DataFrame,
    spec: dict,
    sizes: Sequence[int] = LEARNING_CURVE_SIZES,
    runs: int = LEARNING_CURVE_RUNS,
    seed: int = 1,
    test_rows: int = LEARNING_CURVE_TEST_ROWS,
) -> DataFrame:
    """``ml_learning_curve``: for every run and training size, an exact seeded sample of that size
    -> fit -> precision and recall on a test sample of at most ``test_rows`` rows.  Each run draws
    its own sample (nested across the sizes of a run: the smallest hashes).

    A size above the number of rows raises: no smaller sample goes by its name.  Samples are bounded by
    ``sizes``, so with L2 logistic regression every (run, size) is one group
    of one Spark job, fitted in its task; other estimators are fitted one after another."""
    n = train.count()
    if not sizes:
        return train.sparkSession.createDataFrame([], "run int, training_examples int, metric string, score double")
    if max(sizes) > n:
        raise ValueError(f"a sample of {max(sizes)} rows was asked of {n}")
    samples = run_samples(train, sizes, runs, seed)
    held = test.withColumn("_u", rand.uniform(seed, F.lit("test"), F.col("file").cast("string"))).orderBy("_u", "file").limit(test_rows).drop("_u")
    if spec.get("type") == "LR" and spec.get("penalty", "l2") == "l2":
        rows = held.select(vector_to_array(FEATURES).alias("x"), LABEL).collect()  # at most ``test_rows``
        data = train.sparkSession.sparkContext.broadcast((np.array([r["x"] for r in rows], dtype=float), np.array([r[LABEL] for r in rows])))
        c = float(spec["C"])

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            tx, ty = data.value
            w = pdf[WEIGHT].to_numpy(dtype=float)
            beta = _newton_lr(np.stack(pdf["x"].to_numpy()), pdf[LABEL].to_numpy(dtype=float), w, 1.0 / (c * w.sum()))
            hit = tx @ beta[:-1] + beta[-1] > 0 if len(tx) else np.zeros(0, dtype=bool)
            tp, pos, found = float((hit & (ty == 1)).sum()), float(hit.sum()), float((ty == 1).sum())
            return pd.DataFrame({"run": [pdf["run"].iloc[0]], "training_examples": [pdf["n"].iloc[0]], "precision": [tp / pos if pos else 0.0], "recall": [tp / found if found else 0.0]})

        fits = F.array(*[F.lit(int(n)) for n in sizes])
        each = samples.select("run", F.explode(F.filter(fits, lambda n: n >= F.col("_r"))).alias("n"), vector_to_array(FEATURES).alias("x"), LABEL, WEIGHT)
        res = each.groupBy("run", "n").applyInPandas(fit, "run int, training_examples int, precision double, recall double")
    else:
        res = None
        samples, held = pin(samples), pin(held)
        for run in range(runs):
            for n in sizes:
                sample = samples.filter((F.col("run") == run) & (F.col("_r") <= n)).drop("_r", "run")
                m, _ = train_and_evaluate(sample, held, spec, seed=run + 1)
                one = m.select(F.lit(run).alias("run"), F.lit(n).alias("training_examples"), "precision", "recall")
                res = one if res is None else res.unionByName(one)
    return res.unpivot(["run", "training_examples"], ["precision", "recall"], "metric", "score")


def objective_history(spark, model) -> DataFrame:
    """``ml_history`` of a Spark model: ``(iteration, loss)`` of its training; no rows for a model that keeps
    no summary.  (The trained network's history comes from :mod:`corpusrisk.operators.neural`.)"""
    losses = model.summary.objectiveHistory if getattr(model, "hasSummary", False) else []
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "iteration int, loss double")
