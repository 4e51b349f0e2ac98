"""Query catalogue: given tables written by the library's writers inside the query and read back by its
readers, compared with SQL on the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrisk.operators import corpus
from corpusrisk.operators import lineage as ln
from corpusrisk.plans.q_inputs import feed
from corpusrisk.plans.q_text import LM_VOCAB_SIZE, SQL_LM_CORPUS, lm_corpus
from corpusrisk.plans.tables import SQL_LABELLED_DOCS, labelled_docs, load
from corpusrisk.session import ensure_checkpoint_dir
from corpusrisk.sinks import writers as wr
from corpusrisk.sources import readers as rd


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------------------------------------- runs


def run_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Scored orders as run results: split = year, run = priority."""
    o = load(spark, sf, "orders").select(F.year("o_orderdate").cast("string").alias("split"), F.col("o_orderpriority").alias("run"), F.col("o_orderkey").cast("string").alias("file"), (F.col("o_orderstatus") == "F").cast("double").alias("label"), (F.col("o_totalprice").cast("double") / F.lit(600000.0)).alias("score"))
    return o.groupBy("split", "run").agg(F.count(F.lit(1)).alias("n")), o


def q_snk_runs(spark: SparkSession, sf: str) -> DataFrame:
    """``snk_runs``: an attempt that never commits, one that does, and a repetition of it: every example
    is read back once."""
    results, examples = run_tables(spark, sf)
    path = new_folder(spark, "runs")
    wr.stage_attempt(results, examples, path)
    wr.write_runs(results, examples, path)
    wr.write_runs(results, examples, path)
    return rd.read_saved_runs(spark, path)


SQL_SNK_RUNS = """SELECT year(o_orderdate)::VARCHAR AS split, o_orderpriority AS run, o_orderkey::VARCHAR AS id,
 (o_orderstatus = 'F')::INTEGER AS label, o_totalprice::DOUBLE / 600000.0::DOUBLE AS score FROM orders"""


def q_snk_resume(spark: SparkSession, sf: str) -> DataFrame:
    """``snk_resume``: of the planned splits those that the manifest does not list, after the odd years'
    runs have been written."""
    results, examples = run_tables(spark, sf)
    odd = F.col("split").cast("int") % 2 == 1
    path = new_folder(spark, "runs")
    wr.write_runs(results.filter(odd), examples.filter(odd), path)
    return wr.pending_splits(results.select("split").distinct(), rd.saved_run_list(spark, path))


SQL_SNK_RESUME = "SELECT DISTINCT year(o_orderdate)::VARCHAR AS split FROM orders WHERE year(o_orderdate) % 2 = 0"


# ---------------------------------------------------------------------------------------------- datasets and vocabularies


def written_dataset(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = labelled_docs(spark, sf).join(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    part = F.when(F.col("part") == "train", "train").otherwise("test")
    path = new_folder(spark, "dataset")
    index = docs.select(F.coalesce("lang", F.lit("none")).alias("split"), part.alias("part"), F.col("doc_id").cast("string").alias("file"), "label")
    wr.write_dataset(index, docs.select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content")), path)
    return rd.read_dataset(spark, path)


def q_snk_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """``snk_dataset``: index and content written, read back and joined."""
    index, content = written_dataset(spark, sf)
    return rd.attach_content(index, content).select("split", "part", "file", "label", F.md5("content").alias("content_md5"))


_SQL_DATASET = f"""SELECT coalesce(o.lang, 'none') AS split, CASE WHEN d.part = 'train' THEN 'train' ELSE 'test' END AS part, d.doc_id::VARCHAR AS file, d.label, md5(d.text) AS content_md5
FROM ({SQL_LABELLED_DOCS}) d JOIN documents o ON d.doc_id = o.doc_id"""


def q_src_splits(spark: SparkSession, sf: str) -> DataFrame:
    """``src_splits``: split names with a training part, of the index read back."""
    return rd.splits(written_dataset(spark, sf)[0])


SQL_SRC_SPLITS = f"SELECT DISTINCT split FROM ({_SQL_DATASET}) WHERE part = 'train'"


def q_src_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """``src_vocab``: the language model's vocabulary as a file of one token per line, read back."""
    c = lm_corpus(spark, sf)
    path = new_folder(spark, "vocabulary")
    # top-k tokens, a bounded number: one file keeps their order
    corpus.lm_vocabulary(c, LM_VOCAB_SIZE).orderBy("id").select("token").coalesce(1).write.text(path)
    return rd.read_vocabulary(spark, path)


SQL_SRC_VOCAB = f"WITH {SQL_LM_CORPUS} SELECT token, id FROM lmvocab"


# ---------------------------------------------------------------------------------------------- predictions, vectors, feeds


def q_snk_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``snk_predictions``: predictions as CSV, read back and counted."""
    o = load(spark, sf, "orders")
    path = new_folder(spark, "predictions")
    wr.write_predictions(o.select((F.col("o_totalprice") > 150000).cast("int").alias("prediction"), (F.col("o_orderstatus") == "F").cast("int").alias("label")), path)
    back = spark.read.schema("prediction int, label int").option("header", True).csv(path)
    return back.groupBy("prediction", "label").agg(F.count(F.lit(1)).alias("n"))


SQL_SNK_PREDICTIONS = "SELECT (o_totalprice > 150000)::INTEGER AS prediction, (o_orderstatus = 'F')::INTEGER AS label, count(*) AS n FROM orders GROUP BY ALL"


def q_src_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``src_vectors``: document vectors written and read back."""
    e = load(spark, sf, "embeddings")
    path = new_folder(spark, "vectors")
    half = F.transform("embedding", lambda x: x / 2)
    e.select(F.col("vec_id").alias("file"), F.col("embedding").alias("mean_vector"), half.alias("sd_vector")).write.parquet(path)
    v = rd.read_vectors(spark, path)
    return v.select("file", F.size("mean_vector").alias("width"), F.array_max("mean_vector").cast("double").alias("top"), F.array_min("sd_vector").cast("double").alias("low"))


SQL_SRC_VECTORS = "SELECT vec_id AS file, len(embedding)::INTEGER AS width, list_max(embedding)::DOUBLE AS top, (list_min(embedding)::DOUBLE / 2) AS low FROM embeddings"


def q_src_feed(spark: SparkSession, sf: str) -> DataFrame:
    """``src_feed``: feed parts as one JSON file each, scanned back: advisories with their references."""
    path = new_folder(spark, "feeds")
    feed(spark, sf).select("CVE_Items").write.option("maxRecordsPerFile", 1).option("compression", "gzip").json(path)
    items = ln.feed_items(rd.read_feeds(spark, path))
    return items.select("cve_id", F.size("cve.references.reference_data").cast("long").alias("n_references"))


SQL_SRC_FEED = "SELECT 'CVE-' || o_custkey AS cve_id, count(*) AS n_references FROM orders GROUP BY o_orderstatus, year(o_orderdate), o_custkey"


QUERIES = {
    "snk_runs": (q_snk_runs, SQL_SNK_RUNS),
    "snk_resume": (q_snk_resume, SQL_SNK_RESUME),
    "snk_dataset": (q_snk_dataset, _SQL_DATASET),
    "src_splits": (q_src_splits, SQL_SRC_SPLITS),
    "src_vocab": (q_src_vocab, SQL_SRC_VOCAB),
    "snk_predictions": (q_snk_predictions, SQL_SNK_PREDICTIONS),
    "src_vectors": (q_src_vectors, SQL_SRC_VECTORS),
    "src_feed": (q_src_feed, SQL_SRC_FEED),
}
