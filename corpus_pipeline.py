"""The corpus pipeline: each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.

language_id        documents without a language (null text, or no letter in it) go
exact_dedup        of texts equal up to white space the smallest doc_id stays
simhash_near_dedup of linked fingerprints one document stays, the smallest doc_id
suffix_array_dedup byte strings of 50 or more that an earlier document has are cut out of the text
                   (whole characters; ``n_chars`` is counted anew); a document that loses all of its
                   text stays with an empty one
best_fit_packing   all documents that are left, as packed pieces

All but the last return the columns of ``docs``, whichever those are: the operators look at doc_id,
text and lang alone, and extra columns pass through.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrisk.llm.common import begin_scratch, numbered, stage
from corpusrisk.llm.exact_dedup import exact_dedup
from corpusrisk.llm.language_id import UNKNOWN, language_id
from corpusrisk.llm.packing import best_fit_packing
from corpusrisk.llm.queries import tokenizer_path
from corpusrisk.llm.simhash import simhash_near_dedup
from corpusrisk.llm.suffix_dedup import without_repeats


def _keep(docs: DataFrame, operator, kept) -> DataFrame:
    """The rows of ``docs`` whose verdict by ``operator`` is ``kept``.  Row numbers are written once,
    before the operator reads them, and all its jobs and the join read that table."""
    rows, rid = numbered(docs)
    verdicts = operator(rows, rid_col=rid).filter(kept)
    return rows.join(verdicts.select(F.col("rid").alias(rid)), rid, "left_semi").select(*docs.columns)


def _stage(step):
    """A stage that first deletes the tables which the stage before it staged: its ``docs`` are that
    stage's result, written and read again, so nothing reads them any more."""

    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        begin_scratch(spark)
        return step(spark, docs, sf_dir)

    return run


@_stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, language_id, F.col("lang_pred") != UNKNOWN)


@_stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, exact_dedup, F.col("kept"))


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, simhash_near_dedup, F.col("kept"))


@_stage
def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs, length_col="n_chars")


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("suffix_array_dedup", suffix_stage),
    ("best_fit_packing", packing_stage),
]

# no SQL: the classifier, the fingerprints' XXH64 and the tokenizer have no SQL spelling
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name, keep=True)
    return docs
