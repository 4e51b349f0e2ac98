"""Writers: relational tables, nested blame tree, datasets, corpora, sparse features,
predictions, stats files and run results (attempts that a manifest commits)."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_relational(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """``snk_relational``: one parquet table per name (``fix_commits``, ``commit_affected_lines``,
    ``commit_details``)."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def write_blame_tree(tree: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``snk_blame_json``: the nested tree as JSON lines (one advisory per line)."""
    tree.write.mode(mode).json(path)


def write_dataset(index: DataFrame, content: DataFrame, path: str, mode: str = "overwrite", metadata: DataFrame | None = None) -> None:
    """``snk_dataset``: index CSVs partitioned by ``split, part``; content as parquet keyed by
    ``file`` (not one file per document)."""
    index.select("split", "part", "file", "label").write.mode(mode).partitionBy("split", "part").option("header", True).csv(f"{path}/index")
    content.select("file", "content").write.mode(mode).parquet(f"{path}/content")
    if metadata is not None:
        metadata.select("id", "label", "commit hash", "path", "commit time").write.mode(mode).option("header", True).csv(f"{path}/metadata")


def write_corpus(corpus: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``snk_corpus``: cleaned lines with their explicit ``doc_ord`` (never relies on file order)."""
    corpus.select("doc_ord", "line").write.mode(mode).parquet(path)


def write_sparse(rows: DataFrame, attributes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``snk_sparse``: row strings plus the attribute table beside them."""
    rows.write.mode(mode).parquet(f"{path}/rows")
    attributes.write.mode(mode).parquet(f"{path}/attributes")


def write_predictions(pred: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``snk_predictions``: ``prediction,label`` CSV."""
    pred.select("prediction", "label").write.mode(mode).option("header", True).csv(path)


def stats_lines(prf: DataFrame) -> DataFrame:
    """``snk_stats``: TP TN FP FN precision recall F1 as ``key: value`` lines (7 rows per group)."""
    keys = [c for c in prf.columns if c not in {"tp", "tn", "fp", "fn", "precision", "recall", "f1", "accuracy"}]
    long = prf.select(
        *keys,
        F.expr("stack(7, 'TP', CAST(tp AS DOUBLE), 'TN', CAST(tn AS DOUBLE), 'FP', CAST(fp AS DOUBLE), 'FN', CAST(fn AS DOUBLE), 'precision', precision, 'recall', recall, 'F1', f1) AS (key, v)"),
    )
    val = F.when(F.col("key").isin("TP", "TN", "FP", "FN"), F.col("v").cast("long").cast("string")).otherwise(F.col("v").cast("string"))
    return long.select(*keys, F.concat(F.col("key"), F.lit(": "), val).alias("value"))


def write_stats(prf: DataFrame, path: str, mode: str = "overwrite") -> None:
    stats_lines(prf).write.mode(mode).partitionBy(*[c for c in prf.columns if c not in {"tp", "tn", "fp", "fn", "precision", "recall", "f1", "accuracy"}]).text(path)


def stage_attempt(results: DataFrame, examples: DataFrame, path: str, history: DataFrame | None = None) -> str:
    """Write one attempt's run metrics, scored examples and, where given, training history ``(split,
    run, iteration, loss)`` to folders of its own, and return the attempt's name.  Nothing reads them
    until :func:`commit_attempt` names the attempt.  (One document per run would hold all of a run's
    examples in one row.)"""
    attempt = f"a{uuid.uuid4().hex}"
    for name, df in (("history", history), ("results", results), ("examples", examples)):
        if df is not None:
            df.write.parquet(f"{path}/{name}/attempt={attempt}")
    return attempt


def commit_attempt(results: DataFrame, path: str, attempt: str) -> None:
    """Add the attempt's rows ``(split, run, attempt, committed_at)`` to the manifest, as one file,
    whose appearance is the commit.  Of several attempts at a run the one committed first counts
    (``readers.saved_run_list``), so a retry or a rival never adds to a run that is there."""
    spark = results.sparkSession
    now = datetime.now(timezone.utc).isoformat()
    listed = spark.read.parquet(f"{path}/results/attempt={attempt}").select(F.col("split").cast("string"), F.col("run").cast("string")).distinct()
    listed.withColumn("attempt", F.lit(attempt)).withColumn("committed_at", F.lit(now)).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def write_runs(results: DataFrame, examples: DataFrame, path: str, history: DataFrame | None = None) -> str:
    """``snk_runs``: one attempt, staged and then committed; its rows of the manifest come last."""
    attempt = stage_attempt(results, examples, path, history)
    commit_attempt(results, path, attempt)
    return attempt


def pending_splits(planned: DataFrame, finished: DataFrame) -> DataFrame:
    """``snk_resume``: splits without a finished run list (left-anti join)."""
    return planned.join(finished.select("split").distinct(), "split", "left_anti")
