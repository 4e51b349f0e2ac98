"""Driver tables and the stand-ins the query catalogue maps them to.

Stand-ins (SURVEY §5): source files = ``documents.text`` / ``pages.html``; labels = ``labels``
(``quality = 0`` -> VULNERABLE); document vectors = ``embeddings``; statements = ``events``;
scored examples = ``orders``; blame = ``lineitem`` joined to ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrisk.functions import rand
from corpusrisk.session import spread

DEV_SEED = 1  # flt_dev_group seed
DEV_TRAIN_GROUPS = 80  # groups < 80 train, >= 80 validation (of 100)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_text(spark: SparkSession, sf_dir: str, name: str, cols: list[str]) -> DataFrame:
    """A text table for regex-heavy work: only the needed columns, spread over the task slots."""
    return spread(load(spark, sf_dir, name).select(*cols))


def label_text(quality) -> F.Column:
    return F.when(quality == 0, F.lit("VULNERABLE")).otherwise(F.lit("NOT_VULNERABLE"))


def dev_group(col: str = "doc_id", seed=DEV_SEED) -> F.Column:
    """``flt_dev_group``: one of 100 seeded groups per id."""
    return rand.bucket(seed, 100, col)


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``jn_semi_labels``: documents that have a label row, with label text and dev part."""
    docs = load_text(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        "text",
        label_text(F.col("quality")).alias("label"),
        F.when(dev_group() < DEV_TRAIN_GROUPS, F.lit("train")).otherwise(F.lit("valid")).alias("part"),
    )


# SQL spellings of the same stand-ins (DuckDB oracle)
SQL_DEV_GROUP = f"({rand.sql_hash32(DEV_SEED, 'd.doc_id')} % 100)"
SQL_LABELLED_DOCS = f"""
SELECT d.doc_id, d.text,
       CASE WHEN l.quality = 0 THEN 'VULNERABLE' ELSE 'NOT_VULNERABLE' END AS label,
       CASE WHEN {SQL_DEV_GROUP} < {DEV_TRAIN_GROUPS} THEN 'train' ELSE 'valid' END AS part
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""
