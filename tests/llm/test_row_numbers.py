"""Rows keep their numbers when the file splits of ``docs`` change between an operator's jobs."""

import itertools
import os
import sys

import pytest
from helpers import words

from corpusrisk.llm import exact_dedup, simhash, suffix_dedup

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as cp  # noqa: E402

SPLITS = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def docs(spark, tmp, monkeypatch):
    """Documents in many files; each staged table changes how a later scan cuts them into partitions."""
    text = [" ".join(words(s, 80, "abcdefghijklmnop")) for s in range(24)]
    for i in range(8):
        mine = [(8 * k + i, text[(8 * k + i) // 2] * (1 + i % 3), "en", "a", 0) for k in range(6)]
        df = spark.createDataFrame(mine, "doc_id long, text string, lang string, source string, n_chars long")
        df.coalesce(1).write.mode("append").parquet(f"{tmp}/docs")
    sizes = itertools.cycle(["1k", "128m"])

    def moving(stage):
        def run(*args, **named):
            out = stage(*args, **named)
            spark.conf.set(SPLITS, next(sizes))
            return out

        return run

    for module in (exact_dedup, simhash, suffix_dedup):
        monkeypatch.setattr(module, "stage", moving(module.stage))
    if hasattr(cp, "numbered"):
        monkeypatch.setattr(cp, "numbered", moving(cp.numbered))
        monkeypatch.setattr(suffix_dedup, "numbered", moving(suffix_dedup.numbered))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set(SPLITS, "128m")
    yield spark.read.parquet(f"{tmp}/docs")
    spark.conf.unset(SPLITS)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df, spark, splits):
    spark.conf.set(SPLITS, splits)
    return sorted(map(tuple, df.collect()))


def least(docs):
    """Of equal texts the smallest doc_id."""
    first = {}
    for r in sorted(docs.collect()):
        first.setdefault(r.text, r)
    return sorted(map(tuple, first.values()))


@pytest.mark.parametrize("splits", ["1k", "128m"])
@pytest.mark.parametrize("step", ["exact_stage", "near_stage"])
def test_pipeline_keeps_the_rows_the_verdicts_name(spark, docs, step, splits):
    want = least(docs)
    out = getattr(cp, step)(spark, docs, "")
    if step == "near_stage":
        kept = {r[0] for r in rows(out, spark, splits)}
        spark.conf.set(SPLITS, "128m")
        assert kept == {r.doc_id for r in simhash.simhash_near_dedup(docs.coalesce(1)).filter("kept").collect()}
    else:
        assert rows(out, spark, splits) == want


@pytest.mark.parametrize("splits", ["1k", "128m"])
def test_repeats_are_cut_from_the_rows_that_have_them(spark, docs, splits):
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    cut = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    after = {r[0]: r[1] for r in rows(suffix_dedup.without_repeats(docs), spark, splits)}
    for i, raw in texts.items():
        had = [texts[j] for j in texts if j < i]
        gone = {p for s in range(len(raw) - 49) if any(raw[s : s + 50] in t for t in had) for p in range(s, s + 50)}
        assert cut[i].n_bytes == len(raw) and cut[i].n_removed == len(gone)
        assert after[i].encode() == bytes(b for p, b in enumerate(raw) if p not in gone)


@pytest.mark.parametrize("splits", ["1k", "128m"])
def test_shared_hashes_rank_the_rows_that_have_them(spark, docs, splits):
    want = {r[0] for r in least(docs)}
    out = exact_dedup.exact_dedup(docs, min_chunk=8, max_chunk=64, hash_bits=2).filter("kept").select("doc_id")
    assert {r[0] for r in rows(out, spark, splits)} == want
