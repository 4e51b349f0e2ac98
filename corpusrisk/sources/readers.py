"""Readers: advisory feeds, dataset indexes, content and source trees, archives, vocabularies,
run results, learning curves, stats files and hyperparameter configs.

All are ``spark.read`` scans with explicit schemas; files are read in parallel and the file
name is kept from ``_metadata`` wherever an order or key depends on it.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusrisk.sources import files

# ---------------------------------------------------------------------------------------------- schemas

FEED_SCHEMA = T.StructType(
    [
        T.StructField(
            "CVE_Items",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "cve",
                            T.StructType(
                                [
                                    T.StructField("CVE_data_meta", T.StructType([T.StructField("ID", T.StringType())])),
                                    T.StructField(
                                        "references",
                                        T.StructType([T.StructField("reference_data", T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("refsource", T.StringType())])))]),
                                    ),
                                    T.StructField(
                                        "description",
                                        T.StructType([T.StructField("description_data", T.ArrayType(T.StructType([T.StructField("value", T.StringType())])))]),
                                    ),
                                ]
                            ),
                        )
                    ]
                )
            ),
        )
    ]
)

INDEX_SCHEMA = T.StructType([T.StructField("file", T.StringType()), T.StructField("label", T.StringType())])

METADATA_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("commit hash", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("commit time", T.LongType()),
    ]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField(
            "test",
            T.StructType(
                [T.StructField(m, T.DoubleType()) for m in ("roc_auc", "average_precision", "precision", "recall", "f1", "accuracy")]
                + [
                    T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
                    T.StructField("examples", T.ArrayType(T.ArrayType(T.StringType()))),
                ]
            ),
        ),
        T.StructField("vocabulary_size", T.LongType()),
    ]
)

# the tree that ``writers.write_blame_tree`` writes: commit hashes and file names are map keys
BLAME_SCHEMA = (
    "cve_id STRING, cve_desc_files ARRAY<STRING>, cve_desc_functions ARRAY<STRING>, "
    "fix_commits MAP<STRING, STRUCT<committed_timestamp: STRING, affected_files: MAP<STRING, STRUCT<blame_lines: ARRAY<STRUCT<line_no: INT, blame_commit: STRING>>>>>>"
)

# hyperparameters of the sequence classifier and of the document-vector classifiers
CONFIG_SCHEMA = (
    "min_token_occurrences INT, min_token_documents INT, class_weight MAP<STRING, DOUBLE>, embed_dim INT, conv_filters INT, conv_kernel_size INT, "
    "conv_padding STRING, conv_strides INT, conv_pool_size INT, lstm_size INT, batch_size INT, max_length INT, dropout DOUBLE, es_min_delta DOUBLE, "
    "es_patience INT, max_epochs INT, pos_class_weight DOUBLE, pooling STRING, "
    "classifier STRUCT<type: STRING, n_estimators: DOUBLE, criterion: STRING, C: DOUBLE, penalty: STRING, kernel: STRUCT<type: STRING, gamma: DOUBLE>>"
)

LEARNING_CURVE_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("training_examples", T.LongType()),
            T.StructField("results", T.StructType([T.StructField("test", T.StructType([T.StructField("precision", T.DoubleType()), T.StructField("recall", T.DoubleType())]))])),
        ]
    )
)

# Fixed value: index file names are ``[<split>_]<part>.csv``; with more underscores the part is
# the second piece


def _file_name() -> F.Column:
    return F.col("_metadata.file_name")


# ---------------------------------------------------------------------------------------------- feeds


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """``src_feed``: every (gzipped) JSON feed file in ``path``, one row per file, with its name
    (feeds are processed in file-name order by the later last-wins step, not by read order)."""
    df = spark.read.schema(FEED_SCHEMA).option("multiLine", True).json(path)
    return df.select(_file_name().alias("file_name"), "CVE_Items")


def read_blame_json(spark: SparkSession, path: str) -> DataFrame:
    """``src_blame_json``: the nested advisory tree written by ``write_blame_tree``."""
    return spark.read.schema(BLAME_SCHEMA).json(path)


# ---------------------------------------------------------------------------------------------- datasets


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``src_index``: dataset index CSVs (``file,label``) with ``split`` and ``part`` from the file
    name: ``<split>_<part>.csv`` or ``<part>.csv`` (split null)."""
    df = spark.read.schema(INDEX_SCHEMA).option("header", True).csv(path)
    split, part = index_name_parts(_file_name())
    return df.select(split.alias("split"), part.alias("part"), "file", "label")


def index_name_parts(name: F.Column) -> tuple[F.Column, F.Column]:
    """Split and part of an index file's name."""
    base = F.regexp_replace(name, r"\.csv", "")
    pieces = F.split(base, "_")
    has = F.instr(base, "_") > 0
    return F.when(has, F.element_at(pieces, 1)), F.when(has, F.element_at(pieces, 2)).otherwise(base)


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A dataset written by ``writers.write_dataset``: the index (``split``, ``part`` from the
    partition folders) and the content table keyed by ``file``."""
    schema = T.StructType(list(INDEX_SCHEMA.fields) + [T.StructField("split", T.StringType()), T.StructField("part", T.StringType())])
    index = spark.read.schema(schema).option("header", True).csv(f"{path}/index")
    return index.select("split", "part", "file", "label"), spark.read.parquet(f"{path}/content")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A cleaned corpus written by ``writers.write_corpus``: ``(doc_ord, line)``."""
    return spark.read.parquet(path)


def splits(index: DataFrame) -> DataFrame:
    """``src_splits``: distinct split names that have a training part, sorted as strings."""
    return index.filter((F.col("part") == "train") & F.col("split").isNotNull()).select("split").distinct().orderBy("split")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Document metadata CSV (``id,label,commit hash,path,commit time``)."""
    return spark.read.schema(METADATA_SCHEMA).option("header", True).csv(path)


def read_content(spark: SparkSession, path: str) -> DataFrame:
    """``src_content``: one row per file: ``(file, content)``, ``file`` being the name within ``path``, nested
    folders included (whole text; an empty file keeps an empty row, so it is not mistaken for a
    missing one)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    scanned = df.select(files.relative_to(path).alias("file"), F.col("content").cast("string").alias("content"))
    return scanned.unionByName(_empty_files(spark, path).select(files.relative_to(path).alias("file"), F.lit("").alias("content")))


def _empty_files(spark: SparkSession, path: str) -> DataFrame:
    """Zero-length files below ``path``, which file scans skip."""
    return files.file_table(spark, path).filter("size = 0").select("path")


def attach_content(index: DataFrame, content: DataFrame, strict: bool = True) -> DataFrame:
    """``jn_index_content``: attach content by file name; with ``strict`` a missing file raises."""
    j = index.join(content, "file", "left")
    if strict:
        return j.withColumn("content", F.coalesce(F.col("content"), F.raise_error(F.concat(F.lit("missing content for "), F.col("file")))))
    return j.filter(F.col("content").isNotNull())


def read_tree(spark: SparkSession, path: str, glob: str = "*.c") -> DataFrame:
    """``src_tree``: every ``*.c`` file below ``path`` as UTF-8 text; undecodable files are
    dropped (the reference logs and skips them).  ``(path, content)``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    named = F.element_at(F.split("path", "/"), -1).rlike(fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$"))
    empty = _empty_files(spark, path).filter(named).select(F.concat(F.lit("file:"), "path").alias("path") if files.local_form(path).startswith("/") else "path", F.lit("").alias("content"))
    return df.select("path", text.alias("content")).filter(F.col("content").isNotNull()).unionByName(empty)


def read_archives(spark: SparkSession, path: str, glob: str = "*", member_suffix: str = ".c") -> DataFrame:
    """``src_archive``: members of zip / tar.gz archives in ``path`` ending in ``member_suffix``, as
    ``(archive, path, content)``; any other archive suffix raises, a member that is not UTF-8 is
    left out (as in :func:`read_tree`).  Members are streamed from the open archives."""
    found = files.file_table(spark, path, recursive=False).filter(F.element_at(F.split("path", "/"), -1).rlike(fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$")))
    members = files.archive_members(found, member_suffix)
    return members.select("archive", "path", F.try_validate_utf8(F.col("content").cast("string")).alias("content")).filter(F.col("content").isNotNull())


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``src_vocab``: one token per line, id = line number starting at 1.  The order of lines is that
    of the file's splits; a table ``(token, id)`` is the form to keep vocabularies in."""
    from corpusrisk.operators.prefix import dense_index

    from corpusrisk.functions.text import SPACE

    stripped = F.regexp_replace(F.col("value"), f"^[{SPACE}]+|[{SPACE}]+$", "")
    lines = spark.read.text(path).select(_file_name().alias("_f"), stripped.alias("token"), F.monotonically_increasing_id().alias("_m"))
    return dense_index(lines, ["_f", "_m"], out="id", base=1).select("token", F.col("id").cast("int").alias("id"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``src_vectors``: document vectors ``(file, mean_vector, sd_vector)``."""
    return spark.read.parquet(path)


# ---------------------------------------------------------------------------------------------- results


def read_runs(spark: SparkSession, path: str, finished_only: bool = True) -> DataFrame:
    """``src_runs``: every ``results_<run>.json`` below ``<split>/``, exploded to scored examples
    ``(split, run, id, label, score)``; the positional ``[id, label, score]`` triples are cast.
    With ``finished_only`` only runs listed in the split's ``run_ids.txt`` are read."""
    df = spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(f"{path}/*/results_*.json")
    p = F.col("_metadata.file_path")
    out = df.select(
        F.regexp_extract(p, r"/([^/]+)/results_[^/]+\.json$", 1).alias("split"),
        F.regexp_extract(p, r"results_([^/]+)\.json$", 1).alias("run"),
        F.explode("test.examples").alias("e"),
    ).select("split", "run", *example_columns(F.col("e")))
    return out.join(finished_runs(spark, path), ["split", "run"], "left_semi") if finished_only else out


def example_columns(triple: F.Column) -> list[F.Column]:
    """The positional ``[id, label, score]`` as typed columns."""
    return [triple[0].alias("id"), triple[1].cast("int").alias("label"), triple[2].cast("double").alias("score")]


def saved_run_list(spark: SparkSession, path: str) -> DataFrame:
    """``(split, run, attempt)`` of the finished runs in the manifest that ``writers.write_runs`` keeps:
    of several attempts at a run, the one committed first."""
    manifest = spark.read.schema("split string, run string, attempt string, committed_at string").parquet(f"{path}/manifest")
    return manifest.groupBy("split", "run").agg(F.min_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))


def _saved(spark: SparkSession, path: str, name: str, finished_only: bool) -> DataFrame:
    out = spark.read.parquet(f"{path}/{name}").withColumn("split", F.col("split").cast("string")).withColumn("run", F.col("run").cast("string"))
    return out.join(saved_run_list(spark, path), ["split", "run", "attempt"], "left_semi") if finished_only else out


def read_saved_runs(spark: SparkSession, path: str, finished_only: bool = True) -> DataFrame:
    """Scored examples ``(split, run, id, label, score)`` of what ``writers.write_runs`` wrote, by
    default of the attempts that count."""
    out = _saved(spark, path, "examples", finished_only)
    return out.select("split", "run", F.col("file").cast("string").alias("id"), F.col("label").cast("int").alias("label"), "score")


def read_saved_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of the finished runs, as written."""
    return _saved(spark, path, "results", True).drop("attempt")


def read_saved_history(spark: SparkSession, path: str) -> DataFrame:
    """``ml_history``: ``(split, run, iteration, loss ...)`` of the finished runs."""
    return _saved(spark, path, "history", True).drop("attempt")


def read_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Per run the stored test metrics ``(split, run, roc_auc, average_precision, ...)``."""
    df = spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(f"{path}/*/results_*.json")
    p = F.col("_metadata.file_path")
    return df.select(
        F.regexp_extract(p, r"/([^/]+)/results_[^/]+\.json$", 1).alias("split"), F.regexp_extract(p, r"results_([^/]+)\.json$", 1).alias("run"), "test.*", "vocabulary_size"
    ).drop("examples")


def finished_runs(spark: SparkSession, path: str) -> DataFrame:
    """``run_ids.txt`` per split (the commit marker of a finished split): ``(split, run)``."""
    df = spark.read.text(f"{path}/*/run_ids.txt")
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/run_ids\.txt$", 1).alias("split"), F.trim("value").alias("run")).filter(F.col("run") != "")


def read_learning_curve(spark: SparkSession, path: str) -> DataFrame:
    """``src_learning_curve``: ``learning_curve_<run>.json`` -> ``(run, training_examples, metric,
    score)`` with metric in {precision, recall}."""
    df = spark.read.option("multiLine", True).text(path, wholetext=True)
    parsed = df.select(F.regexp_extract(F.col("_metadata.file_name"), r"learning_curve_(.+)\.json$", 1).alias("run"), F.explode(F.from_json("value", LEARNING_CURVE_SCHEMA)).alias("p"))
    wide = parsed.select("run", F.col("p.training_examples").alias("training_examples"), F.col("p.results.test.precision").alias("precision"), F.col("p.results.test.recall").alias("recall"))
    return wide.unpivot(["run", "training_examples"], ["precision", "recall"], "metric", "score")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """``src_stats``: ``key: value`` lines -> ``(split, key, value DOUBLE)``; split = parent folder."""
    df = spark.read.text(path)
    key, value = stats_line(F.col("value"))
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1).alias("split"), key.alias("key"), value.alias("value")).filter(F.col("key") != "")


def stats_line(line: F.Column) -> tuple[F.Column, F.Column]:
    """Key and value of a ``key: value`` line."""
    kv = F.split(line, ": ?", 2)
    return F.trim(kv[0]), F.trim(kv[1]).try_cast("double")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """``src_config``: hyperparameter JSON; ``class_weight`` string keys re-cast to int."""
    df = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path)
    return df.withColumn("class_weight", F.transform_keys("class_weight", lambda k, v: k.cast("int")))
