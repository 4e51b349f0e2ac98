import os
import sys

from helpers import DOCS, awkward, empty, words

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as cp  # noqa: E402


def through(spark, docs, tmp):
    """Every stage's output by name, written and read again as the pipeline does."""
    out = {}
    for name, step in cp.STAGES:
        path = f"{tmp}/{name}"
        step(spark, docs, tmp).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]


def test_decisions_take_effect(spark, tmp):
    w = [words(s, 400, "abcdefghijklmnop") for s in range(6)]
    text = [" ".join(x) for x in w]
    passage = " ".join(words(77, 40, "qrstuvw"))
    rows = [
        (1, text[0], "en", "a", 0),
        (2, text[0].replace(" ", "  "), "en", "a", 0),  # equal up to white space
        (3, text[0].replace(w[0][200], w[0][201], 1), "en", "a", 0),  # near copy
        (4, text[1] + " " + passage, "en", "a", 0),
        (5, text[2] + " " + passage + " " + text[3], "en", "a", 0),  # shares a passage
        (6, "12345 !!!", "en", "a", 0),  # no letter
        (7, None, "en", "a", 0),
        (8, text[4], "en", "a", 0),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    out = through(spark, docs, tmp)
    ids = {k: sorted(r.doc_id for r in v.select("doc_id").distinct().collect()) for k, v in out.items()}
    assert ids["language_id"] == [1, 2, 3, 4, 5, 8]
    assert ids["exact_dedup"] == [1, 3, 4, 5, 8]
    assert ids["simhash_near_dedup"] == [1, 4, 5, 8]
    assert ids["suffix_array_dedup"] == [1, 4, 5, 8] and ids["best_fit_packing"] == [1, 4, 5, 8]
    cut = {r.doc_id: r for r in out["suffix_array_dedup"].collect()}
    assert passage in cut[4].text and passage not in cut[5].text and cut[5].text.startswith(text[2]) and cut[5].text.endswith(text[3])
    assert cut[5].n_chars == len(cut[5].text) and cut[1].text == text[0]
    assert all(v.columns == docs.columns for k, v in out.items() if k != "best_fit_packing")


def test_awkward_rows_keep_columns(spark, tmp):
    docs = awkward(spark)
    out = through(spark, docs, tmp)
    assert out["suffix_array_dedup"].columns == docs.columns
    assert {r.doc_id for r in out["exact_dedup"].collect()} == {1, None, 6, 7, 8}


def test_empty_table(spark, tmp):
    assert through(spark, empty(spark), tmp)["best_fit_packing"].count() == 0


def test_run_reads_documents(spark, tmp):
    spark.createDataFrame([(1, "some words of text", "en", "a", 18)], DOCS).write.parquet(f"{tmp}/documents.parquet")
    assert [(r.doc_id, r.piece, r.offset) for r in cp.run(spark, tmp).collect()] == [(1, 0, 0)]
