"""Evaluation operators (job F/G): confusion counts, precision/recall/F1/accuracy, ROC AUC,
step-wise average precision and precision-recall curves, per group of ``keys`` (split, run, ...).

Scores are first grouped by ``(keys, score)`` (partial aggregation), so ties are handled before
any running sum and a run holding a third of all rows collapses to its distinct scores.  The
running sums over descending scores use :func:`running_sum`, which spreads one hot run over
many partitions instead of one window task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusrisk.operators.prefix import running_sum


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def label_to_num(label="label", strict: bool = False) -> Column:
    """``prj_label_num``: VULNERABLE -> 1, anything else -> 0; ``strict``: NOT_VULNERABLE -> 0,
    anything else -> null."""
    lab = _c(label)
    if strict:
        return F.when(lab == "VULNERABLE", F.lit(1)).when(lab == "NOT_VULNERABLE", F.lit(0))
    return F.when(lab == "VULNERABLE", F.lit(1)).otherwise(F.lit(0))


def predicted_class(score="score", threshold: float = 0.5) -> Column:
    """``prj_pred``: round(prob) with half-to-even, i.e. 0.5 -> 0: ``score > 0.5``."""
    return (_c(score) > F.lit(threshold)).cast("int")


def sample_weight(label="label", pos_class_weight=1.0) -> Column:
    """``prj_weight``: ``w = y * pos_class_weight + 1 - y``."""
    y = _c(label).cast("double")
    w = F.lit(pos_class_weight) if isinstance(pos_class_weight, (int, float)) else _c(pos_class_weight)
    return y * w + F.lit(1.0) - y


def _checked_label(label) -> Column:
    lab = _c(label)
    return F.when(lab.isin(0, 1), lab).otherwise(F.raise_error(F.concat(F.lit("unknown class: "), lab.cast("string"))))


def confusion(df: DataFrame, keys: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """``agg_confusion``: tp, fp, tn, fn per group; a label or prediction outside {0, 1} raises."""
    y, p = _checked_label(label), _checked_label(pred)
    return df.groupBy(*keys).agg(
        F.count_if((y == 1) & (p == 1)).cast("long").alias("tp"),
        F.count_if((y == 0) & (p == 1)).cast("long").alias("fp"),
        F.count_if((y == 0) & (p == 0)).cast("long").alias("tn"),
        F.count_if((y == 1) & (p == 0)).cast("long").alias("fn"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(conf: DataFrame) -> DataFrame:
    """``ev_prf``: precision, recall, F1, accuracy from confusion counts; 0/0 -> 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision = _ratio(tp, tp + fp)
    recall = _ratio(tp, tp + fn)
    return (
        conf.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", _ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .withColumn("accuracy", _ratio(tp + tn, tp + fp + tn + fn))
    )


def confusion_matrix(conf: DataFrame) -> Column:
    """``[[tn, fp], [fn, tp]]``."""
    return F.array(F.array("tn", "fp"), F.array("fn", "tp"))


def curve_points(df: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """Per ``(keys, distinct score)``: ``pos``, ``neg`` at that score, ``tp``/``fp`` = positives /
    negatives scoring >= it, and the group totals ``P``, ``N``."""
    keys = list(keys)
    if not keys:
        raise ValueError("curve_points needs at least one group key (use a constant column for one group)")
    y = _checked_label(label)
    by_score = df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(y).cast("double").alias("pos"), F.sum(F.lit(1) - y).cast("double").alias("neg")
    )
    cum = running_sum(by_score, keys, [F.desc("score")], ["pos", "neg"])
    totals = by_score.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return cum.withColumnRenamed("cum_pos", "tp").withColumnRenamed("cum_neg", "fp").join(totals, keys)


def ranking_metrics(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``ev_avg_precision`` and ``ev_roc_auc`` per group from :func:`curve_points`.

    AP = sum over distinct scores of (pos_i / P) * precision_i (the step sum, not an
    interpolated area); AUC = sum pos_i * (N - fp_i + neg_i / 2) / (P * N), ties counted half.
    AUC is null when only one class is present."""
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    return points.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum(F.col("pos") * prec), F.first("P")), F.lit(0.0)).alias("average_precision"),
        F.try_divide(F.sum(F.col("pos") * (F.col("N") - F.col("fp") + F.col("neg") / 2.0)), F.first("P") * F.first("N")).alias("roc_auc"),
    )


def pr_curve(points: DataFrame, keys: Sequence[str], drop_after_full_recall: bool = False, end_threshold: float | None = 1.0) -> DataFrame:
    """``ev_pr_curve``: ``(keys, threshold, precision, recall, idx_order)`` for every distinct
    score plus the end point (precision 1, recall 0) at ``end_threshold``.

    Recall is 1 everywhere when a group has no positives.  ``drop_after_full_recall`` keeps
    only thresholds from the highest one reaching full recall upward (older library output).
    ``is_end`` orders the end point after every threshold (the curve's index order)."""
    keys = list(keys)
    recall = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(F.lit(1.0))
    pts = points.select(*keys, F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), recall.alias("recall"), F.col("tp"), F.col("P"))
    if drop_after_full_recall:
        full = pts.filter(F.col("tp") >= F.col("P")).groupBy(*keys).agg(F.max("threshold").alias("_cut"))
        pts = pts.join(full, keys, "left").filter(F.col("_cut").isNull() | (F.col("threshold") >= F.col("_cut"))).drop("_cut")
    pts = pts.select(*keys, "threshold", "precision", "recall", F.lit(False).alias("is_end"))
    end = points.select(*keys).distinct().select(*keys, F.lit(end_threshold).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(True).alias("is_end"))
    return pts.unionByName(end)


def value_at_reference(curve: DataFrame, keys: Sequence[str], reference: DataFrame, ref_keys: Sequence[str], reference_metric: str) -> DataFrame:
    """``rep_pr_at_ref``: per group the other metric at the point whose ``reference_metric`` is
    nearest the reference value; ties go to the lowest curve index (lowest threshold, the end
    point last).  ``reference`` has ``ref_keys`` + ``reference_score``."""
    variable = "precision" if reference_metric == "recall" else "recall"
    j = curve.join(reference, list(ref_keys))
    dist = F.abs(F.col(reference_metric) - F.col("reference_score"))
    return j.groupBy(*keys).agg(
        F.min_by(F.col(variable), F.struct(dist.alias("d"), F.col("is_end").alias("e"), F.col("threshold").alias("t"))).alias("value")
    ).withColumn("metric", F.lit(variable))


# Dataset document types and the labels they translate to
VULNERABLE_FILE, PATCHED_VULNERABLE_FILE = "VULNERABLE_FILE", "PATCHED_VULNERABLE_FILE"


def translate_label(doc_type="doc_type") -> Column:
    """``prj_label_translate``: VULNERABLE_FILE -> VULNERABLE; PATCHED_VULNERABLE_FILE raises;
    any other type -> NOT_VULNERABLE."""
    t = _c(doc_type)
    return (
        F.when(t == VULNERABLE_FILE, F.lit("VULNERABLE"))
        .when(t == PATCHED_VULNERABLE_FILE, F.raise_error(F.concat(F.lit("cannot generate label for "), t)))
        .otherwise(F.lit("NOT_VULNERABLE"))
    )


def strict_lookup(df: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """``jn_strict_lookup``: left join a label lookup; a key without an entry raises."""
    j = df.join(lookup.select(key, F.col(value).alias("_lv")), key, "left")
    return j.withColumn(value, F.coalesce(F.col("_lv"), F.raise_error(F.concat(F.lit("no entry for "), F.col(key).cast("string"))))).drop("_lv")
