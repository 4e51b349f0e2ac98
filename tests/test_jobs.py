"""The three end-to-end jobs on small fixtures."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from corpusrisk.operators import synth as sy
from corpusrisk.plans import jobs


def test_feed_to_relational(spark, tmp):
    d = os.path.join(tmp, "feeds")
    os.makedirs(d)
    item = {"cve": {"CVE_data_meta": {"ID": "CVE-7"}, "references": {"reference_data": [{"url": "https://github.com/torvalds/linux/commit/abc", "refsource": "CONFIRM"}]}, "description": {"description_data": [{"value": "in x.c"}]}}}
    with gzip.open(os.path.join(d, "2017.json.gz"), "wt") as f:
        json.dump({"CVE_Items": [item]}, f)
    commits = spark.createDataFrame([("abc", "2017-01-01T00:00:00+00:00", ["p"]), ("p", "2016-01-01T00:00:00+00:00", []), ("o1", "2010-01-01T00:00:00+00:00", [])], "commit_hash string, committed_timestamp string, parents array<string>")
    fv = spark.createDataFrame([("abc", "M", "x.c", "x.c", "a\nb", "a\nB")], "commit_hash string, change_type string, a_path string, b_path string, a_text string, b_text string")
    blame = spark.createDataFrame([("p", "x.c", 1, "o1"), ("p", "x.c", 2, "o1")], "commit_hash string, path string, line_no int, blame_commit string")
    t = jobs.feed_to_relational(spark, d, commits, fv, blame, out_dir=os.path.join(tmp, "out"))
    assert [tuple(r) for r in t["commit_affected_lines"].collect()] == [("abc", "x.c", 2, "o1")]
    assert sorted(r["commit_hash"] for r in t["commit_details"].collect()) == ["abc", "o1"]
    assert spark.read.parquet(os.path.join(tmp, "out", "relational", "fix_commits")).count() == 1


def test_documents_to_scores(spark):
    idx, stmts = sy.generate_simple(spark.range(120).withColumnRenamed("id", "k"), "k")
    code = sy.render(stmts).join(idx.select("example", "file"), "example").select("file", F.col("code").alias("content"))
    index = idx.select(F.lit("r1").alias("split"), F.when(F.col("part") == "train", "train").otherwise("test").alias("part"), "file", "label")
    metrics, examples = jobs.documents_to_scores(index, code, {"type": "RandomForest", "n_estimators": 10, "criterion": "gini"}, runs=2)
    m = metrics.collect()
    assert len(m) == 2 and all(0.0 <= r["average_precision"] <= 1.0 for r in m)
    assert examples.count() == 2 * index.filter("part = 'test'").count()


def test_results_to_report(spark):
    ex = spark.createDataFrame(
        [("1500", "r1", f"f{i}", y, s) for i, (y, s) in enumerate([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)])] + [("1400", "r1", "g", 1, 0.5), ("1400", "r1", "h", 0, 0.4)],
        "split string, run string, id string, label int, score double",
    )
    stats = spark.createDataFrame([("1500", "precision", 0.6), ("1500", "recall", 0.4), ("1400", "precision", 1.0), ("1400", "recall", 1.0)], "split string, key string, value double")
    rows = {(r["release"], r["model"], r["metric"]): r["score"] for r in jobs.results_to_report(ex, stats).collect()}
    assert rows[(2, "MODEL", "precision")] == pytest.approx(0.5)  # recall 0.5 nearest 0.4, lowest threshold
    assert rows[(2, "BASELINE", "recall")] == 0.4 and rows[(1, "MODEL", "recall")] == pytest.approx(1.0)
