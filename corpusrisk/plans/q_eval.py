"""Query catalogue, jobs F/G: evaluation and report tables on scored examples (``orders``),
label projections and samples (``labels``), box statistics and time splits (``lineitem``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrisk.functions import rand
from corpusrisk.operators import evaluate as ev
from corpusrisk.operators import report as rp
from corpusrisk.operators import sampling as sm
from corpusrisk.operators.prefix import dense_index
from corpusrisk.plans.tables import label_text, load
from corpusrisk.session import broadcast_if_small

KEYS = ["split", "run"]
V = rp.VULNERABLE_SHARE * rp.ALERT_UNIVERSE_FILES
BOOT_SEED, BOOT_REPS = 7, 1000
POS_CLASS_WEIGHT = 3.5
TRIM_BATCH, TRIM_SEED = 32, 14
MAX_TRAIN_ROWS = 60000


def scored(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", F.lit(1)).otherwise(F.lit(0)).alias("label"),
        ((F.floor("o_totalprice").cast("bigint") % 1000).cast("double") / 1000.0).alias("score"),
        F.col("o_orderpriority").alias("run"),
        F.year("o_orderdate").cast("string").alias("split"),
    )


SQL_SCORED = """
scored AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
                  CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS score,
                  o_orderpriority AS run, CAST(year(o_orderdate) AS VARCHAR) AS split FROM orders)
"""
SQL_POINTS = f"""
{SQL_SCORED},
bys AS (SELECT split, run, score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM scored GROUP BY split, run, score),
pts AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
               sum(pos) OVER (PARTITION BY split, run) AS P, sum(neg) OVER (PARTITION BY split, run) AS N
        FROM bys WINDOW w AS (PARTITION BY split, run ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
curve AS (SELECT split, run, score AS threshold, tp / (tp + fp) AS precision, CASE WHEN P > 0 THEN tp / P ELSE 1.0 END AS recall, false AS is_end FROM pts
          UNION ALL SELECT DISTINCT split, run, 1.0 AS threshold, 1.0 AS precision, 0.0 AS recall, true AS is_end FROM pts),
rank_m AS (SELECT split, run, coalesce(sum(pos * tp / (tp + fp)) / nullif(first(P), 0), 0.0) AS average_precision,
                  sum(pos * (N - fp + neg / 2)) / nullif(first(P) * first(N), 0) AS roc_auc FROM pts GROUP BY split, run),
conf AS (SELECT split, run, count(*) FILTER (WHERE label = 1 AND score > 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND score > 0.5) AS fp,
                count(*) FILTER (WHERE label = 0 AND score <= 0.5) AS tn, count(*) FILTER (WHERE label = 1 AND score <= 0.5) AS fn FROM scored GROUP BY split, run),
prf AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS recall,
               coalesce((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 0.0) AS accuracy FROM conf),
prf2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM prf),
releases AS (SELECT split, dense_rank() OVER (ORDER BY split) AS release FROM (SELECT DISTINCT split FROM scored)),
base_conf AS (SELECT split, count(*) FILTER (WHERE label = 1 AND score > 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND score > 0.5) AS fp,
                     count(*) FILTER (WHERE label = 1 AND score <= 0.5) AS fn FROM scored GROUP BY split),
baseline AS (SELECT split, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS ref_precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS ref_recall FROM base_conf),
at_ref AS (
  SELECT split, run, 'precision' AS metric, precision AS score FROM (SELECT c.*, b.ref_recall FROM curve c JOIN baseline b USING (split))
  QUALIFY row_number() OVER (PARTITION BY split, run ORDER BY abs(recall - ref_recall), is_end, threshold) = 1
  UNION ALL
  SELECT split, run, 'recall' AS metric, recall AS score FROM (SELECT c.*, b.ref_precision FROM curve c JOIN baseline b USING (split))
  QUALIFY row_number() OVER (PARTITION BY split, run ORDER BY abs(precision - ref_precision), is_end, threshold) = 1)
"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    return ev.curve_points(scored(spark, sf), KEYS)


def q_prj_pred(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    return s.select("id", "label", "score", ev.predicted_class("score").alias("pred"))


SQL_PRJ_PRED = f"WITH {SQL_SCORED} SELECT id, label, score, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred FROM scored"


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).withColumn("pred", ev.predicted_class("score"))
    return ev.confusion(s, KEYS)


def q_agg_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return confusion(spark, sf)


SQL_AGG_CONFUSION = f"WITH {SQL_POINTS} SELECT split, run, tp, fp, tn, fn FROM conf"


def q_ev_prf(spark: SparkSession, sf: str) -> DataFrame:
    return ev.prf(confusion(spark, sf)).select(*KEYS, "precision", "recall", "f1", "accuracy")


SQL_EV_PRF = f"WITH {SQL_POINTS} SELECT split, run, precision, recall, f1, accuracy FROM prf2"


def q_ev_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """``ev_roc_auc`` and ``ev_avg_precision`` per split and run."""
    return ev.ranking_metrics(points(spark, sf), KEYS)


SQL_EV_RANKING = f"WITH {SQL_POINTS} SELECT split, run, average_precision, roc_auc FROM rank_m"


def curve(spark: SparkSession, sf: str) -> DataFrame:
    return ev.pr_curve(points(spark, sf), KEYS)


def q_ev_pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    return curve(spark, sf)


SQL_EV_PR_CURVE = f"WITH {SQL_POINTS} SELECT split, run, threshold, precision, recall, is_end FROM curve"


def q_fn_alert_volume(spark: SparkSession, sf: str) -> DataFrame:
    """``fn_alert_volume`` + ``flt_min_precision`` on every run's curve."""
    return rp.alert_volume(curve(spark, sf)).select(*KEYS, "threshold", "true_positives", "false_positives")


SQL_ALERT = f"""
vol AS (SELECT *, CASE WHEN precision >= {rp.MIN_PRECISION} THEN recall * {V!r} END AS true_positives FROM curve),
vol2 AS (SELECT *, CASE WHEN precision >= {rp.MIN_PRECISION} THEN true_positives * (1.0 / precision - 1.0) END AS false_positives FROM vol)
"""
SQL_FN_ALERT_VOLUME = f"WITH {SQL_POINTS}, {SQL_ALERT} SELECT split, run, threshold, true_positives, false_positives FROM vol2"


def _mean(c: str) -> str:
    """The exact mean of ``report.exact_mean`` in SQL."""
    return f"(sum(CAST(round({c} * {rp.MEAN_UNIT!r}) AS DECIMAL(38, 0)))::DOUBLE / count({c}) / {rp.MEAN_UNIT!r})"


def q_rep_alert_volume(spark: SparkSession, sf: str) -> DataFrame:
    """``rep_alert_volume`` (+ ``agg_threshold_mean``): mean curve and volumes per threshold over runs."""
    return rp.threshold_means(rp.alert_volume(curve(spark, sf)), ["split"])


SQL_REP_ALERT_VOLUME = f"""WITH {SQL_POINTS}, {SQL_ALERT}
SELECT split, threshold, {_mean('precision')} AS precision, {_mean('recall')} AS recall, {_mean('true_positives')} AS true_positives, {_mean('false_positives')} AS false_positives
FROM vol2 GROUP BY split, threshold"""


def q_win_release(spark: SparkSession, sf: str) -> DataFrame:
    return rp.release_numbers(scored(spark, sf))


SQL_WIN_RELEASE = f"WITH {SQL_POINTS} SELECT split, release::INTEGER AS release FROM releases"


def baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in for the baseline's per-release stats file: precision/recall at 0.5 over all runs."""
    s = scored(spark, sf).withColumn("pred", ev.predicted_class("score"))
    return ev.prf(ev.confusion(s, ["split"])).select("split", "precision", "recall")


def pr_at_ref(spark: SparkSession, sf: str) -> DataFrame:
    c = curve(spark, sf)
    b = baseline(spark, sf)
    out = None
    for ref_metric in ("recall", "precision"):
        ref = b.select("split", F.col(ref_metric).alias("reference_score"))  # jn_reference_metric
        v = ev.value_at_reference(c, KEYS, ref, ["split"], ref_metric).select(*KEYS, "metric", F.col("value").alias("score"))
        out = v if out is None else out.unionByName(v)
    return out


def q_rep_pr_at_ref(spark: SparkSession, sf: str) -> DataFrame:
    """``rep_pr_at_ref`` / ``jn_reference_metric``: per run, precision at the baseline's recall
    and recall at the baseline's precision."""
    return pr_at_ref(spark, sf)


SQL_REP_PR_AT_REF = f"WITH {SQL_POINTS} SELECT split, run, metric, score FROM at_ref"


def q_set_union_all(spark: SparkSession, sf: str) -> DataFrame:
    """``set_union_all``: model rows and baseline rows in one long report keyed by release."""
    rel = rp.release_numbers(scored(spark, sf))
    model = pr_at_ref(spark, sf).select("split", F.lit("LM").alias("model"), "metric", "score")
    base = rp.unpivot_metrics(baseline(spark, sf), ["split"], ["precision", "recall"]).select("split", F.lit("BASE").alias("model"), "metric", "score")
    return model.unionByName(base).join(broadcast_if_small(rel), "split").select("release", "model", "metric", "score")


SQL_SET_UNION_ALL = f"""WITH {SQL_POINTS}
SELECT r.release::INTEGER AS release, u.model, u.metric, u.score FROM (
  SELECT split, 'LM' AS model, metric, score FROM at_ref
  UNION ALL SELECT split, 'BASE', 'precision', ref_precision FROM baseline
  UNION ALL SELECT split, 'BASE', 'recall', ref_recall FROM baseline) u JOIN releases r USING (split)"""


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return ev.prf(confusion(spark, sf)).join(ev.ranking_metrics(points(spark, sf), KEYS), KEYS)


def q_rep_split_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """``rep_split_metrics``: per release and run every metric in long form."""
    rel = rp.release_numbers(scored(spark, sf))
    m = run_metrics(spark, sf)
    long = rp.unpivot_metrics(m, KEYS, ["precision", "recall", "f1", "accuracy", "average_precision", "roc_auc"])
    return long.join(broadcast_if_small(rel), "split").select("release", "run", "metric", "score")


SQL_REP_SPLIT_METRICS = f"""WITH {SQL_POINTS},
m AS (SELECT p.split, p.run, p.precision, p.recall, p.f1, p.accuracy, r.average_precision, r.roc_auc FROM prf2 p JOIN rank_m r USING (split, run)),
l AS (UNPIVOT m ON precision, recall, f1, accuracy, average_precision, roc_auc INTO NAME metric VALUE score)
SELECT rl.release::INTEGER AS release, l.run, l.metric, l.score FROM l JOIN releases rl USING (split)"""


def q_agg_best_run(spark: SparkSession, sf: str) -> DataFrame:
    return rp.best_run(ev.ranking_metrics(points(spark, sf), KEYS), ["split"], run="run")


SQL_AGG_BEST_RUN = f"""WITH {SQL_POINTS}
SELECT split, run AS best_run, average_precision AS best_average_precision FROM rank_m WHERE average_precision > 0
QUALIFY row_number() OVER (PARTITION BY split ORDER BY average_precision DESC, run) = 1"""


def q_fn_run_id(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select(*KEYS).distinct().withColumn("run_id", rp.run_id("split", "run"))


SQL_FN_RUN_ID = f"WITH {SQL_SCORED} SELECT split, run, substr(md5(concat_ws('|', split, run)), 1, 8) AS run_id FROM (SELECT DISTINCT split, run FROM scored)"


def q_rep_mean_ci(spark: SparkSession, sf: str) -> DataFrame:
    """``rep_mean_ci``: mean average precision over runs per release with a 95 % bootstrap interval."""
    ap = ev.ranking_metrics(points(spark, sf), KEYS)
    return rp.bootstrap_mean_ci(ap, ["split"], "average_precision", replicates=BOOT_REPS, seed=BOOT_SEED)


SQL_REP_MEAN_CI = f"""WITH {SQL_POINTS},
num AS (SELECT split, average_precision AS v, row_number() OVER (PARTITION BY split ORDER BY average_precision) - 1 AS i FROM rank_m),
sizes AS (SELECT split, count(*) AS n, avg(average_precision) AS mean FROM rank_m GROUP BY split),
reps AS (SELECT split, n, unnest(range({BOOT_REPS})) AS b FROM sizes),
draws AS (SELECT split, n, b, unnest(range(n)) AS j FROM reps),
picks AS (SELECT split, b, floor(CAST({rand.sql_hash32(BOOT_SEED, "concat_ws('|', split)", 'b', 'j')} AS DOUBLE) / 4294967296.0 * n)::INTEGER AS i FROM draws),
m AS (SELECT p.split, p.b, avg(num.v) AS m FROM picks p JOIN num USING (split, i) GROUP BY p.split, p.b)
SELECT s.split, s.mean, quantile_cont(m.m, 0.025) AS ci_low, quantile_cont(m.m, 0.975) AS ci_high FROM sizes s JOIN m USING (split) GROUP BY s.split, s.mean"""


def q_rep_box(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return rp.box_stats(li, ["l_returnflag", "l_linestatus"], "l_quantity")


SQL_REP_BOX = """
WITH q AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median,
                  quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY ALL)
SELECT q.l_returnflag, q.l_linestatus, q.q1, q.median, q.q3,
       min(l_quantity) FILTER (WHERE l_quantity >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
       max(l_quantity) FILTER (WHERE l_quantity <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
       count(*) FILTER (WHERE l_quantity < q1 - 1.5 * (q3 - q1) OR l_quantity > q3 + 1.5 * (q3 - q1))::BIGINT AS n_outliers
FROM lineitem JOIN q USING (l_returnflag, l_linestatus) GROUP BY q.l_returnflag, q.l_linestatus, q.q1, q.median, q.q3
"""


def q_rep_train_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """``rep_train_fraction`` / ``agg_count_rows``: per release year of ``lineitem``, rows of
    earlier years train, rows of the year test; fraction used for training."""
    li = load(spark, sf, "lineitem")
    return sm.release_train_fraction(li, "l_shipdate")


SQL_REP_TRAIN_FRACTION = """
WITH y AS (SELECT year(l_shipdate) AS yr, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT yr, n, coalesce(sum(n) OVER (ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM y)
SELECT CAST(yr AS VARCHAR) AS split, dense_rank() OVER (ORDER BY CAST(yr AS VARCHAR))::INTEGER AS release, before::BIGINT AS train_rows, n::BIGINT AS test_rows,
       before / (before + n) AS train_fraction FROM c
"""


def q_ml_time_split(spark: SparkSession, sf: str) -> DataFrame:
    """``ml_time_split``: for each release year, earlier orders train and the year's orders test."""
    o = load(spark, sf, "orders")
    return sm.time_split(o.select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey", "split", "part")


SQL_ML_TIME_SPLIT = """
WITH r AS (SELECT DISTINCT year(o_orderdate) AS yr FROM orders)
SELECT o.o_orderkey, CAST(r.yr AS VARCHAR) AS split, CASE WHEN year(o.o_orderdate) < r.yr THEN 'train' ELSE 'test' END AS part
FROM orders o JOIN r ON year(o.o_orderdate) <= r.yr
"""


def q_flt_position_split(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select("o_orderkey")
    return sm.position_split(o, ["o_orderkey"]).select("o_orderkey", "part")


SQL_FLT_POSITION_SPLIT = """
SELECT o_orderkey, CASE WHEN i < floor(CAST(0.6 AS DOUBLE) * n) THEN 'train' WHEN i < floor(CAST(0.8 AS DOUBLE) * n) THEN 'valid' ELSE 'test' END AS part
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
"""


def q_lim_train(spark: SparkSession, sf: str) -> DataFrame:
    """``lim_train``: the first 60,000 training rows (training = first 60 % by position)."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    parts = sm.position_split(li, ["l_orderkey", "l_linenumber"], keep_index=True)
    return sm.first_rows(parts.filter(F.col("part") == "train"), "_row", MAX_TRAIN_ROWS).select("l_orderkey", "l_linenumber")


SQL_LIM_TRAIN = f"""
SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS i, count(*) OVER () AS n FROM lineitem)
WHERE i < floor(CAST(0.6 AS DOUBLE) * n) AND i < {MAX_TRAIN_ROWS}
"""


def q_prj_docid(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", sm.doc_id_hex("o_orderkey").alias("doc_id"))


SQL_PRJ_DOCID = "SELECT o_orderkey, lpad(lower(printf('%x', o_orderkey % 4294967296)), 16, '0') AS doc_id FROM orders"


def q_fn_time(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", sm.iso_timestamp("o_orderdate").alias("committed_timestamp"), sm.epoch_seconds("o_orderdate").alias("epoch_seconds"))


SQL_FN_TIME = """
SELECT o_orderkey,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(o_orderdate) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(o_orderdate) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS committed_timestamp,
       epoch(date_trunc('second', o_orderdate))::BIGINT AS epoch_seconds
FROM orders
"""


# ---------------------------------------------------------------------------------------------- labels


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "labels").select("doc_id", label_text(F.col("quality")).alias("label"))


SQL_LABELS = "lab AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'VULNERABLE' ELSE 'NOT_VULNERABLE' END AS label FROM labels)"


def q_prj_label_num(spark: SparkSession, sf: str) -> DataFrame:
    lb = labels(spark, sf)
    return lb.select("doc_id", "label", ev.label_to_num("label").alias("y"), ev.label_to_num("label", strict=True).alias("y_strict"))


SQL_PRJ_LABEL_NUM = f"WITH {SQL_LABELS} SELECT doc_id, label, CASE WHEN label = 'VULNERABLE' THEN 1 ELSE 0 END AS y, CASE WHEN label = 'VULNERABLE' THEN 1 WHEN label = 'NOT_VULNERABLE' THEN 0 END AS y_strict FROM lab"


def q_flt_positive(spark: SparkSession, sf: str) -> DataFrame:
    return labels(spark, sf).filter(F.col("label") == "VULNERABLE")


SQL_FLT_POSITIVE = f"WITH {SQL_LABELS} SELECT doc_id, label FROM lab WHERE label = 'VULNERABLE'"


def q_prj_weight(spark: SparkSession, sf: str) -> DataFrame:
    lb = labels(spark, sf).withColumn("y", ev.label_to_num("label"))
    return lb.select("doc_id", "y", ev.sample_weight("y", POS_CLASS_WEIGHT).alias("weight"))


SQL_PRJ_WEIGHT = f"WITH {SQL_LABELS} SELECT doc_id, y, CAST(y AS DOUBLE) * {POS_CLASS_WEIGHT} + 1 - y AS weight FROM (SELECT doc_id, CASE WHEN label = 'VULNERABLE' THEN 1 ELSE 0 END AS y FROM lab)"


def q_smp_trim_majority(spark: SparkSession, sf: str) -> DataFrame:
    """``smp_trim_majority`` / ``set_relabel_union``: all positives plus enough negatives that
    the row count is a multiple of the batch size (negatives kept in seeded hash order)."""
    lb = labels(spark, sf).withColumn("y", ev.label_to_num("label"))
    return sm.trim_majority(lb, "doc_id", "y", TRIM_BATCH, TRIM_SEED).select("doc_id", "y")


SQL_SMP_TRIM_MAJORITY = f"""WITH {SQL_LABELS},
y AS (SELECT doc_id, CASE WHEN label = 'VULNERABLE' THEN 1 ELSE 0 END AS y FROM lab),
cnt AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = 0) AS neg FROM y),
neg AS (SELECT doc_id, y, row_number() OVER (ORDER BY md5(concat_ws('|', '{TRIM_SEED}', CAST(doc_id AS VARCHAR))), doc_id) AS r FROM y WHERE y = 0)
SELECT doc_id, y FROM y WHERE y = 1
UNION ALL SELECT doc_id, y FROM neg, cnt WHERE r <= cnt.neg - (cnt.n % {TRIM_BATCH})"""


def q_smp_exact(spark: SparkSession, sf: str) -> DataFrame:
    """``smp_exact``: exactly n = a quarter of the labelled documents, without replacement,
    seeded (the sample size follows the table so the query runs at every scale)."""
    lb = labels(spark, sf)
    return sm.sample_exact(lb, "doc_id", lb.count() // 4, seed=1).select("doc_id", "label")


SQL_SMP_EXACT = f"""WITH {SQL_LABELS}
SELECT doc_id, label FROM lab QUALIFY row_number() OVER (ORDER BY md5(concat_ws('|', '1', CAST(doc_id AS VARCHAR))), doc_id) <= (SELECT count(*) // 4 FROM lab)"""


def q_smp_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """``smp_shuffle``: seeded full shuffle, as the shuffled position of every row."""
    return sm.shuffle_positions(labels(spark, sf), "doc_id", seed=3).select("doc_id", "shuffle_pos")


SQL_SMP_SHUFFLE = f"WITH {SQL_LABELS} SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '3', CAST(doc_id AS VARCHAR))), doc_id) - 1 AS shuffle_pos FROM lab"


QUERIES = {
    "prj_pred": (q_prj_pred, SQL_PRJ_PRED),
    "agg_confusion": (q_agg_confusion, SQL_AGG_CONFUSION),
    "ev_prf": (q_ev_prf, SQL_EV_PRF),
    "ev_roc_auc_avg_precision": (q_ev_ranking, SQL_EV_RANKING),
    "ev_pr_curve": (q_ev_pr_curve, SQL_EV_PR_CURVE),
    "fn_alert_volume": (q_fn_alert_volume, SQL_FN_ALERT_VOLUME),
    "rep_alert_volume": (q_rep_alert_volume, SQL_REP_ALERT_VOLUME),
    "win_release": (q_win_release, SQL_WIN_RELEASE),
    "rep_pr_at_ref": (q_rep_pr_at_ref, SQL_REP_PR_AT_REF),
    "set_union_all": (q_set_union_all, SQL_SET_UNION_ALL),
    "rep_split_metrics": (q_rep_split_metrics, SQL_REP_SPLIT_METRICS),
    "agg_best_run": (q_agg_best_run, SQL_AGG_BEST_RUN),
    "fn_run_id": (q_fn_run_id, SQL_FN_RUN_ID),
    "rep_mean_ci": (q_rep_mean_ci, SQL_REP_MEAN_CI),
    "rep_box": (q_rep_box, SQL_REP_BOX),
    "rep_train_fraction": (q_rep_train_fraction, SQL_REP_TRAIN_FRACTION),
    "ml_time_split": (q_ml_time_split, SQL_ML_TIME_SPLIT),
    "flt_position_split": (q_flt_position_split, SQL_FLT_POSITION_SPLIT),
    "lim_train": (q_lim_train, SQL_LIM_TRAIN),
    "prj_docid": (q_prj_docid, SQL_PRJ_DOCID),
    "fn_time": (q_fn_time, SQL_FN_TIME),
    "prj_label_num": (q_prj_label_num, SQL_PRJ_LABEL_NUM),
    "flt_positive": (q_flt_positive, SQL_FLT_POSITIVE),
    "prj_weight": (q_prj_weight, SQL_PRJ_WEIGHT),
    "smp_trim_majority": (q_smp_trim_majority, SQL_SMP_TRIM_MAJORITY),
    "smp_exact": (q_smp_exact, SQL_SMP_EXACT),
    "smp_shuffle": (q_smp_shuffle, SQL_SMP_SHUFFLE),
}
