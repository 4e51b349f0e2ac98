"""Incremental corpus cleaning with Structured Streaming: new source files landing in a folder
are cleaned (``fn_denoise`` + `` <EOF>``) and appended to a parquet corpus.  The checkpoint
location must be a shared folder so a restarted query resumes where it stopped."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusrisk.functions import text as tx


def clean_corpus_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", 1000).load(source_dir)
    lines = raw.select(F.col("_metadata.file_path").alias("path"), tx.corpus_line("value").alias("line"))
    w = lines.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
