"""Arrays to ids and counts by slices of a batch; regrouping whole arrays; batches numbered without vectors."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusrisk.operators import arrays as ar
from corpusrisk.operators import batching, ngram, vocab

ROWS = [(0, ["a", "b", "a"]), (1, None), (2, []), (3, ["c", None, "b"]), (4, ["a"] * 9), (4, ["b", "c"])]


def test_ranges_hold_few_elements_or_one_row():
    edges = np.array([0, 3, 3, 3, 6, 15, 17])
    assert list(ar._ranges(edges, 4)) == [(0, 3), (3, 4), (4, 5), (5, 6)]
    assert list(ar._ranges(edges, 100)) == [(0, 6)] and list(ar._ranges(np.array([0]), 4)) == []


def test_a_batch_is_gone_through_in_slices(spark, monkeypatch):
    vocab_ = spark.createDataFrame([("a", 7), ("b", 1)], "token string, id int")
    df = spark.createDataFrame(ROWS, "doc long, t array<string>").coalesce(1)
    want = sorted([(0, [7, 1, 7]), (1, None), (2, []), (3, [5, 5, 1]), (4, [7] * 9), (4, [1, 5])], key=str)

    class Frame:  # takes the place of a table: the tasks' function runs here
        sparkSession, schema, columns = spark, df.schema, df.columns

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_pylist([{"doc": d, "t": t} for d, t in ROWS], schema=pa.schema([("doc", pa.int64()), ("t", pa.list_(pa.string()))]))
            return list(run(iter([batch.slice(0)])))

    for most in (1, 4, 1 << 18):
        monkeypatch.setattr(ar._ranges, "__defaults__", (most,))
        made = ar.token_ids(Frame(), "t", vocab_, 5)
        assert len(made) == {1: 5, 4: 4, 1 << 18: 1}[most]
        assert sorted([(r["doc"], r["ids"]) for b in made for r in b.to_pylist()], key=str) == want
    ids = ar.token_ids(df, "t", vocab_, 5)
    assert sorted([(r["doc"], r["ids"]) for r in ids.collect()], key=str) == want
    counts = ar.term_counts(ids, "ids", "doc", ignore=5).collect()
    assert sorted(map(tuple, counts)) == [(0, 1, 1), (0, 7, 2), (3, 1, 1), (4, 1, 1), (4, 7, 9)]


def test_regrouped_arrays_equal_regrouped_elements(spark):
    df = spark.createDataFrame([(0, [3, 1]), (1, None), (2, []), (4, [5, 9]), (4, [2, 9, 9])], "doc long, ids array<int>")
    each = df.select("doc", F.posexplode("ids").alias("pos", "id"))
    rows = lambda d: sorted((r["doc"], r["v"]) for r in d.collect())
    whole = vocab.regroup_arrays(df, out="v")
    assert rows(whole) == rows(vocab.regroup(each, out="v")) == [(0, [3, 1]), (4, [2, 5, 9, 9, 9])]
    # elements are not exploded before they are exchanged
    assert "Generate" not in whole._jdf.queryExecution().executedPlan().toString()


def test_batches_are_numbered_without_vectors(spark, monkeypatch):
    seen, real = [], batching.dense_index
    monkeypatch.setattr(batching, "dense_index", lambda df, *a, **k: (seen.append(df.columns), real(df, *a, **k))[1])
    df = spark.createDataFrame([(i, i % 2, [i] * (i + 1)) for i in range(6)], "file long, label int, vectors array<int>")
    out = batching.make_batches(df, 2, 3, pad=-1, order="file").orderBy("batch", "slot").collect()
    assert [(r["batch"], r["slot"], r["file"]) for r in out] == [(i // 2, i % 2, i) for i in range(6)]
    assert [[x for c in r["chunks"] for x in c] for r in out] == [[i] * (i + 1) + [-1] * ((3 if i < 2 else 6) - i - 1) for i in range(6)]
    assert seen and all("vectors" not in c for c in seen)


def test_ngram_rows_keep_the_arrays_type(spark):
    wide, narrow = (ngram.ngram_rows(spark.createDataFrame([(0, [4, 5]), (1, [])], f"doc_ord long, ids array<{t}>"), 3) for t in ("bigint", "int"))
    assert [c[1] for c in narrow.dtypes] == ["bigint", "int", "int", "int", "int"]
    assert wide.collect() == narrow.collect()
