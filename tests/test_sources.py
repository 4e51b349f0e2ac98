"""Readers and writers on small files written by the tests."""

import io
import json
import os
import tarfile
import zipfile

import pytest

from corpusrisk.sinks import writers as wr
from corpusrisk.sources import readers as rd


def _w(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


def test_index_names_and_splits(spark, tmp):
    _w(f"{tmp}/idx/train.csv", "file,label\n00000001.c,VULNERABLE\n")
    _w(f"{tmp}/idx/1500000000_train.csv", "file,label\na,NOT_VULNERABLE\n")
    _w(f"{tmp}/idx/1500000000_test.csv", "file,label\nb,VULNERABLE\n")
    _w(f"{tmp}/idx/1400000000_train.csv", "file,label\nc,VULNERABLE\n")
    idx = rd.read_index(spark, f"{tmp}/idx")
    rows = sorted((r["split"] or "", r["part"], r["file"]) for r in idx.collect())
    assert rows == [("", "train", "00000001.c"), ("1400000000", "train", "c"), ("1500000000", "test", "b"), ("1500000000", "train", "a")]
    assert [r["split"] for r in rd.splits(idx).collect()] == ["1400000000", "1500000000"]


def test_content_strict_join(spark, tmp):
    _w(f"{tmp}/content/a", "int x;")
    _w(f"{tmp}/content/b", "")
    idx = spark.createDataFrame([("a", "VULNERABLE"), ("b", "NOT_VULNERABLE")], "file string, label string")
    got = {r["file"]: r["content"] for r in rd.attach_content(idx, rd.read_content(spark, f"{tmp}/content")).collect()}
    assert got["a"] == "int x;"
    missing = spark.createDataFrame([("zz", "VULNERABLE")], "file string, label string")
    with pytest.raises(Exception):
        rd.attach_content(missing, rd.read_content(spark, f"{tmp}/content")).collect()


def test_tree_and_archives(spark, tmp):
    _w(f"{tmp}/tree/a/x.c", "int a;")
    _w(f"{tmp}/tree/b/y.h", "int b;")
    _w(f"{tmp}/tree/b/bad.c", b"\xff\xfe\x00bad", mode="wb")
    tree = {os.path.basename(r["path"]): r["content"] for r in rd.read_tree(spark, f"{tmp}/tree").collect()}
    assert tree == {"x.c": "int a;"}
    os.makedirs(f"{tmp}/arch")
    with zipfile.ZipFile(f"{tmp}/arch/p.zip", "w") as z:
        z.writestr("p/m.c", "m();")
        z.writestr("p/r.txt", "no")
    buf = io.BytesIO(b"t();")
    with tarfile.open(f"{tmp}/arch/q.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("q/t.c")
        info.size = 4
        t.addfile(info, buf)
    got = sorted((os.path.basename(r["archive"]), r["path"], r["content"]) for r in rd.read_archives(spark, f"{tmp}/arch").collect())
    assert got == [("p.zip", "p/m.c", "m();"), ("q.tar.gz", "q/t.c", "t();")]
    _w(f"{tmp}/arch2/x.rar", "junk")
    with pytest.raises(Exception):
        rd.read_archives(spark, f"{tmp}/arch2").collect()


def test_runs_stats_curves_config(spark, tmp):
    ex = [["f1", 1, 0.9], ["f2", 0, 0.2]]
    _w(f"{tmp}/res/s1/results_r1.json", json.dumps({"test": {"roc_auc": 1.0, "average_precision": 1.0, "precision": 1, "recall": 1, "f1": 1, "accuracy": 1, "confusion_matrix": [[1, 0], [0, 1]], "examples": ex}}))
    _w(f"{tmp}/res/s1/run_ids.txt", "r1\n")
    _w(f"{tmp}/res/s1/results_r2.json", json.dumps({"test": {"examples": [["f9", 1, 0.5]]}}))  # unfinished: not listed
    runs = sorted(tuple(r) for r in rd.read_runs(spark, f"{tmp}/res").collect())
    assert runs == [("s1", "r1", "f1", 1, 0.9), ("s1", "r1", "f2", 0, 0.2)]
    assert rd.read_runs(spark, f"{tmp}/res", finished_only=False).count() == 3
    assert [tuple(r) for r in rd.finished_runs(spark, f"{tmp}/res").collect()] == [("s1", "r1")]
    _w(f"{tmp}/stats/s1/stats.txt", "TP: 3\nprecision: 0.75\nF1: NaN\n")
    st = {r["key"]: r["value"] for r in rd.read_stats(spark, f"{tmp}/stats/*/stats.txt").collect()}
    assert st["TP"] == 3.0 and st["precision"] == 0.75
    _w(f"{tmp}/lc/learning_curve_ab.json", json.dumps([{"training_examples": 100, "results": {"test": {"precision": 0.5, "recall": 0.25}}}]))
    lc = sorted(tuple(r) for r in rd.read_learning_curve(spark, f"{tmp}/lc").collect())
    assert lc == [("ab", 100, "precision", 0.5), ("ab", 100, "recall", 0.25)]
    _w(f"{tmp}/cfg/best.json", json.dumps({"pos_class_weight": 2.0, "class_weight": {"0": 1.0, "1": 2.0}}))
    cfg = rd.read_config(spark, f"{tmp}/cfg/best.json").first()
    assert cfg["class_weight"] == {0: 1.0, 1: 2.0}


def test_vocabulary_file_ids(spark, tmp):
    _w(f"{tmp}/vocab.txt", "int\n;\nfoo\n")
    assert [tuple(r) for r in rd.read_vocabulary(spark, f"{tmp}/vocab.txt").orderBy("id").collect()] == [("int", 1), (";", 2), ("foo", 3)]


def test_stats_lines_and_resume(spark):
    prf = spark.createDataFrame([("s", 3, 1, 2, 4, 0.75, 0.5, 0.6)], "split string, tp long, tn long, fp long, fn long, precision double, recall double, f1 double")
    lines = [r["value"] for r in wr.stats_lines(prf).collect()]
    assert lines == ["TP: 3", "TN: 1", "FP: 2", "FN: 4", "precision: 0.75", "recall: 0.5", "F1: 0.6"]
    planned = spark.createDataFrame([("a",), ("b",)], "split string")
    finished = spark.createDataFrame([("a", "r1")], "split string, run string")
    assert [r["split"] for r in wr.pending_splits(planned, finished).collect()] == ["b"]


def test_dataset_and_corpus_round_trip(spark, tmp):
    idx = spark.createDataFrame([("1500", "train", "a", "VULNERABLE"), ("1500", "test", "b", "NOT_VULNERABLE")], "split string, part string, file string, label string")
    content = spark.createDataFrame([("a", "int a;"), ("b", "")], "file string, content string")
    wr.write_dataset(idx, content, f"{tmp}/ds")
    i2, c2 = rd.read_dataset(spark, f"{tmp}/ds")
    assert sorted(map(tuple, i2.collect())) == sorted(map(tuple, idx.collect()))
    assert sorted(map(tuple, c2.collect())) == [("a", "int a;"), ("b", "")]
    corpus = spark.createDataFrame([(0, "x <EOF>"), (1, " <EOF>")], "doc_ord long, line string")
    wr.write_corpus(corpus, f"{tmp}/corpus")
    assert sorted(map(tuple, rd.read_corpus(spark, f"{tmp}/corpus").collect())) == [(0, "x <EOF>"), (1, " <EOF>")]


def test_predictions_writer_and_time_key(spark, tmp):
    from pyspark.sql import functions as F

    from corpusrisk.operators.sampling import time_key

    pred = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "prediction double, label double")
    wr.write_predictions(pred, f"{tmp}/pred")
    back = spark.read.option("header", True).csv(f"{tmp}/pred")
    assert back.columns == ["prediction", "label"] and back.count() == 2
    df = spark.createDataFrame([("Time_1500000000",), ("x",)], "k string")
    assert [r[0] for r in df.select(time_key("k")).collect()] == ["1500000000", "x"]


def test_index_name_with_more_underscores_and_vocab_whitespace(spark, tmp):
    _w(f"{tmp}/i2/a_b_c.csv", "file,label\nx,VULNERABLE\n")
    r = rd.read_index(spark, f"{tmp}/i2").first()
    assert (r["split"], r["part"]) == ("a", "b")
    _w(f"{tmp}/v2.txt", "\tint \r\n;\n\n")
    got = [tuple(x) for x in rd.read_vocabulary(spark, f"{tmp}/v2.txt").orderBy("id").collect()]
    assert got[:3] == [("int", 1), (";", 2), ("", 3)]


def test_corpus_order_from_archive_members(spark):
    from corpusrisk.functions import text as tx
    from corpusrisk.operators.corpus import with_doc_ord

    members = spark.createDataFrame([("b.zip", "x/2.c", "int b;"), ("a.zip", "z/9.c", "/* c */ f();"), ("a.zip", "y/1.c", "")], "archive string, path string, content string")
    corpus = with_doc_ord(members.select("archive", "path", tx.corpus_line("content").alias("line")), ["archive", "path"])
    got = [(r["doc_ord"], r["path"], r["line"]) for r in corpus.orderBy("doc_ord").collect()]
    assert got == [(0, "y/1.c", " <EOF>"), (1, "z/9.c", "f ( ) ; <EOF>"), (2, "x/2.c", "int b ; <EOF>")]


def test_saved_runs_round_trip(spark, tmp):
    results = spark.createDataFrame([("s1", "r1", 0.5), ("s2", "r1", 0.7)], "split string, run string, average_precision double")
    examples = spark.createDataFrame([("s1", "r1", "f1", 1.0, 0.9), ("s2", "r1", "f2", 0.0, 0.1)], "split string, run string, file string, label double, score double")
    history = spark.createDataFrame([("s1", "r1", 0, 0.69), ("s1", "r1", 1, 0.4)], "split string, run string, iteration int, loss double")
    wr.write_runs(results, examples, f"{tmp}/saved", history)
    assert sorted(map(tuple, rd.read_saved_runs(spark, f"{tmp}/saved").collect())) == [("s1", "r1", "f1", 1, 0.9), ("s2", "r1", "f2", 0, 0.1)]
    assert spark.read.parquet(f"{tmp}/saved/history").count() == 2
    planned = spark.createDataFrame([("s1",), ("s3",)], "split string")
    assert [r["split"] for r in wr.pending_splits(planned, rd.saved_run_list(spark, f"{tmp}/saved")).collect()] == ["s3"]


def _run_tables(spark, runs, examples=3):
    results = spark.createDataFrame([(s, r, 0.5) for s, r in runs], "split string, run string, average_precision double")
    ex = spark.createDataFrame([(s, r, f"f{i}", float(i % 2), i / 10) for s, r in runs for i in range(examples)], "split string, run string, file string, label double, score double")
    history = spark.createDataFrame([(s, r, k, 1.0 / (k + 1)) for s, r in runs for k in range(2)], "split string, run string, iteration int, loss double")
    return results, ex, history


def test_killed_and_repeated_attempts_are_read_once(spark, tmp):
    path = f"{tmp}/runs"
    runs = [("007", "r1"), ("007", "r2")]
    results, ex, history = _run_tables(spark, runs)
    wr.stage_attempt(results, ex, path, history)  # killed before its commit
    wr.write_runs(results, ex, path, history)  # repeated
    wr.write_runs(results, ex, path, history)  # and, by mistake, once more
    got = sorted((r["split"], r["run"], r["id"]) for r in rd.read_saved_runs(spark, path).collect())
    assert got == [(s, r, f"f{i}") for s, r in runs for i in range(3)]  # split names keep their zeros
    assert rd.read_saved_history(spark, path).count() == 4 and rd.read_saved_metrics(spark, path).count() == 2
    assert rd.read_saved_runs(spark, path, finished_only=False).count() == 18


def test_concurrent_attempts_and_the_first_commit_stays(spark, tmp):
    path = f"{tmp}/runs"
    one, two = _run_tables(spark, [("s", "r1"), ("s", "r2")]), _run_tables(spark, [("s", "r2"), ("s", "r3")], examples=5)
    a, b = (wr.stage_attempt(*t[:2], path, t[2]) for t in (one, two))  # both at work
    wr.commit_attempt(two[0], path, b)
    wr.commit_attempt(one[0], path, a)
    count = {r["run"]: r["count"] for r in rd.read_saved_runs(spark, path).groupBy("run").count().collect()}
    assert count == {"r1": 3, "r2": 5, "r3": 5}
    assert {r["run"]: r["attempt"] for r in rd.saved_run_list(spark, path).collect()} == {"r1": a, "r2": b, "r3": b}
    wr.write_runs(*one[:2], path)
    assert {r["run"]: r["attempt"] for r in rd.saved_run_list(spark, path).collect()} == {"r1": a, "r2": b, "r3": b}


def test_metadata_round_trip(spark, tmp):
    meta = spark.createDataFrame([("000000000000000a", "VULNERABLE", "c1", "a.c", 1500000000)], rd.METADATA_SCHEMA)
    index = spark.createDataFrame([("s", "train", "a.c", "VULNERABLE")], "split string, part string, file string, label string")
    wr.write_dataset(index, spark.createDataFrame([("a.c", "int x;")], "file string, content string"), f"{tmp}/ds", metadata=meta)
    assert [tuple(r) for r in rd.read_metadata(spark, f"{tmp}/ds/metadata").collect()] == [tuple(r) for r in meta.collect()]


def test_archive_member_that_is_not_text_is_left_out(spark, tmp):
    import zipfile

    os.makedirs(f"{tmp}/z")
    with zipfile.ZipFile(f"{tmp}/z/a.zip", "w") as z:
        z.writestr("ok.c", "int été;")
        z.writestr("bad.c", b"\xff\xfe\xc3")
    assert [(r["path"], r["content"]) for r in rd.read_archives(spark, f"{tmp}/z").collect()] == [("ok.c", "int été;")]
