"""Batching, vector helpers, and the streaming corpus cleaner."""

import os

from pyspark.sql import functions as F

from corpusrisk.functions import text as tx
from corpusrisk.functions import vectors as vx
from corpusrisk.operators import batching
from corpusrisk.streaming.corpus_stream import clean_corpus_stream

_ = None


def test_make_batches_pads_to_the_longest_of_a_batch(spark):
    docs = [(10, [5, 5, 6], 0), (11, [40], 1), (12, [21, 22, 23, 24, 25], 0), (13, [31, 32], 0), (14, [], 0), (15, [9, 8], 1)]
    df = spark.createDataFrame(docs, "file int, vectors array<int>, label int")
    b = batching.make_batches(df, batch_size=3, steps=2, pad=-7, order="file").orderBy("batch", "slot").collect()
    assert [(r["batch"], r["file"], r["chunks"]) for r in b] == [
        (0, 10, [[5, 5], [6, -7], [-7, -7]]),
        (0, 11, [[40, -7], [-7, -7], [-7, -7]]),
        (0, 12, [[21, 22], [23, 24], [25, -7]]),
        (1, 13, [[31, 32]]),
        (1, 14, [[-7, -7]]),
        (1, 15, [[9, 8]]),
    ]


def test_trim_keeps_positives(spark):
    docs = [(i, [i], 1 if i < 3 else 0) for i in range(7)]
    df = spark.createDataFrame(docs, "file int, vectors array<int>, label int")
    b = batching.make_batches(df, batch_size=2, steps=1, pad=0).collect()
    assert len(b) == 6 and sum(r["label"] for r in b) == 3


def test_vector_helpers(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "v array<int>")
    r = df.select(vx.pad_front("v", 5).alias("a"), vx.pad_front("v", 2).alias("b"), vx.pad_right("v", 4, 9).alias("c"), vx.front_padded_rows("v", 2).alias("d")).collect()
    assert r[0]["a"] == [0, 0, 1, 2, 3] and r[0]["b"] == [2, 3] and r[0]["c"] == [1, 2, 3, 9] and r[0]["d"] == [[0, 1], [2, 3]]
    assert r[1]["d"] == [[0, 0]]


def test_stream_cleaner(spark, tmp):
    src = os.path.join(tmp, "src")
    os.makedirs(src)
    with open(os.path.join(src, "a.c"), "w") as f:
        f.write('int x = 1; /* c */ puts("s");\n')
    q = clean_corpus_stream(spark, src, os.path.join(tmp, "out"), os.path.join(tmp, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(tmp, "out")).collect()
    assert [r["line"] for r in out] == ["int x = <NUM> ; puts ( <STR> ) ; <EOF>"]
    exp = spark.createDataFrame([('int x = 1; /* c */ puts("s");\n',)], "s string").select(tx.corpus_line("s")).first()[0]
    assert out[0]["line"] == exp
