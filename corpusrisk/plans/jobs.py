"""End-to-end jobs (the reference's three entry points), composed from the operators.

E1 ``feed_to_relational``: advisory feeds -> fix commits -> changed lines -> blamed commits ->
   ``fix_commits``, ``commit_affected_lines``, ``commit_details`` (+ the nested tree).
E2 ``documents_to_scores``: dataset index + content -> cleaned tokens -> token vectors ->
   pooled document vectors -> weighted classifier runs per split -> metrics and scored examples.
E3 ``results_to_report``: scored examples per split and run + the baseline's stats -> release
   numbers -> curves -> precision at the baseline's recall and recall at its precision, in
   long form next to the baseline rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrisk.functions import text as tx
from corpusrisk.functions import vectors as vx
from corpusrisk.operators import evaluate as ev
from corpusrisk.operators import lineage as ln
from corpusrisk.operators import models as md
from corpusrisk.operators import report as rp
from corpusrisk.operators import sequence_model as sqm
from corpusrisk.operators.linediff import sequential_changed_lines
from corpusrisk.session import broadcast_if_small, pin
from corpusrisk.sinks import writers as wr
from corpusrisk.sources import readers as rd


def feed_to_relational(
    spark: SparkSession, feed_dir: str, commits: DataFrame, file_versions: DataFrame, blame: DataFrame, out_dir: str | None = None, max_fix_commits: int = ln.MAX_FIX_COMMITS
) -> dict[str, DataFrame]:
    """E1.  ``commits``/``file_versions``/``blame`` are tables exported from version control."""
    advisories = pin(ln.drop_many_commits(ln.latest_advisories(ln.advisory_records(ln.feed_items(rd.read_feeds(spark, feed_dir)))), max_fix_commits))
    valid, _missing = ln.valid_fix_commits(advisories, commits)
    fixes = valid.select(F.col("fix_commit_hash").alias("commit_hash")).distinct()
    changed = sequential_changed_lines(file_versions.join(fixes, "commit_hash", "left_semi"))
    tables = ln.relational_tables(valid, ln.blame_lines(changed, commits, blame), commits)
    if out_dir:
        wr.write_relational(tables, f"{out_dir}/relational")
        wr.write_blame_tree(ln.blame_tree(tables, advisories), f"{out_dir}/cve_blame")
    return tables


def documents_to_scores(
    index: DataFrame, content: DataFrame, spec: dict, runs: int = 1, pooling: str = "mean+sd", pos_class_weight: float = 1.0, vector_size: int = sqm.VECTOR_SIZE
) -> tuple[DataFrame, DataFrame]:
    """E2.  ``index``: ``(split, part, file, label)`` with part in {train, test}; ``content``:
    ``(file, content)``.  Returns ``(metrics per split and run, scored examples)``."""
    docs = pin(content.select("file", tx.denoise_tokens("content").alias("tokens")))
    vectors = sqm.document_vectors(docs, "file", "tokens", sqm.token_vectors(docs.filter(F.size("tokens") > 0), "tokens", size=vector_size), vector_size)
    # jn_index_vectors: index rows without a vector drop out silently
    data = pin(index.join(vectors, "file").withColumn("y", ev.label_to_num("label")).withColumn("vec", vx.pooled(pooling)))
    frame = md.model_frame(data, "vec", "y", pos_class_weight, "file", keep=["split", "part"])
    metrics, examples = None, None
    for row in rd.splits(index).collect():  # the split names (a handful of releases)
        s = row["split"]
        part = frame.filter(F.col("split") == s)
        m, e = md.repeat_runs(part.filter(F.col("part") == "train"), part.filter(F.col("part") == "test"), spec, runs, s)
        metrics = m if metrics is None else metrics.unionByName(m)
        examples = e if examples is None else examples.unionByName(e)
    return metrics, examples


def results_to_report(examples: DataFrame, baseline_stats: DataFrame, model: str = "MODEL") -> DataFrame:
    """E3.  ``examples``: ``(split, run, id, label, score)``; ``baseline_stats``: ``(split, key,
    value)`` with keys precision / recall.  Output ``(release, model, metric, score)``."""
    rel = rp.release_numbers(examples.select("split"))
    pts = ev.curve_points(examples, ["split", "run"])
    curve = ev.pr_curve(pts, ["split", "run"])
    out = None
    for ref_metric in ("recall", "precision"):
        ref = baseline_stats.filter(F.col("key") == ref_metric).select("split", F.col("value").alias("reference_score"))
        v = ev.value_at_reference(curve, ["split", "run"], ref, ["split"], ref_metric).select("split", F.lit(model).alias("model"), "metric", F.col("value").alias("score"))
        out = v if out is None else out.unionByName(v)
    base = baseline_stats.filter(F.col("key").isin("precision", "recall")).select("split", F.lit("BASELINE").alias("model"), F.col("key").alias("metric"), F.col("value").alias("score"))
    return out.unionByName(base).join(broadcast_if_small(rel), "split").select("release", "model", "metric", "score")
