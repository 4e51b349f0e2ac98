"""Quality rules with host-level verdicts, in DataFrame and SQL functions only.

Every document gets its counts and base rules.  Rule failures are summed by host (partial
aggregation, so a hot host costs one row per task), each host's failure rate is shrunk with a beta
prior fitted to the rates of all hosts (method of moments), and the host's verdict is joined back.

Cases: null text has no words (and fails the length rule); a null host is a host of its own; a
repeated row counts as often as it occurs; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrisk.llm.common import SPACE_CLASS, WORD_CLASS, stage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10  # symbols per 100 words
MAX_DUP_LINE_PERCENT = 30  # repeated lines per 100 lines
HOST_MAX_RATE = 0.5  # a host whose shrunk failure rate lies above is rejected
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (all long).

    Repeated windows: each three-word window is hashed with its position, the pairs are sorted
    inside the row, and windows equal to a neighbour are the repeated ones; a word counts once
    however many of them cover it."""
    one = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    has_word = lambda line: line.rlike(WORD_CLASS)
    lines = F.filter(F.split("text", "\n"), has_word)
    cut = one.select(
        "doc_id",
        "host",
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.filter(F.split("text", SPACE_CLASS + "+"), lambda w: w != "").alias("words"),
    ).select(
        "doc_id",
        "host",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"),
        "words",
    )
    windows = F.expr(
        "CASE WHEN size(words) < 4 THEN CAST(array() AS array<struct<h:bigint,i:int>>) ELSE "
        "sort_array(transform(sequence(0, size(words) - 3), i -> struct(xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)) AS h, i AS i))) END"
    )
    repeated = F.expr(
        "sort_array(transform(filter(s, (x, k) -> x.h <=> get(s, k - 1).h OR x.h <=> get(s, k + 1).h), x -> x.i))"
    )
    covered = F.expr("aggregate(transform(r, (p, k) -> least(3, coalesce(get(r, k + 1) - p, 3))), 0L, (a, b) -> a + b)")
    keep = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    return (
        cut.select(*keep, windows.alias("s"))
        .select(*keep, repeated.alias("r"))
        .select(*keep, covered.alias("n_repeat_words"))
    )


def rule_failures(counts: DataFrame) -> DataFrame:
    """``base_failed`` and ``failed`` (base or one of the symbol and line rules)."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    other = (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
    return counts.withColumn("base_failed", base).withColumn("failed", base | other)


def host_verdicts(failures: DataFrame, max_rate: float = HOST_MAX_RATE) -> DataFrame:
    """One row per host: host, host_docs, host_failed, host_rate (shrunk), host_ok.

    Prior: mean ``m`` of all documents and variance ``v`` of the host rates give the strength
    ``m(1-m)/v - 1`` (at least 1; with no spread, 1000 documents' worth)."""
    hosts = failures.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    # the prior is one row: it reaches the driver and goes back as two literals
    mean, spread = hosts.agg(F.sum("host_failed") / F.sum("host_docs"), F.coalesce(F.var_samp(rate), F.lit(0.0))).first()
    mean = mean or 0.0
    strength = max(mean * (1 - mean) / spread - 1, 1.0) if spread > 0 else 1000.0
    shrunk = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.select("host", "host_docs", "host_failed", shrunk.alias("host_rate"), (shrunk <= max_rate).alias("host_ok"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = HOST_MAX_RATE) -> DataFrame:
    """Counts, ``base_failed``, the host's figures and ``kept`` for each row of ``docs``."""
    rows = stage(rule_failures(document_counts(docs, id_col, text_col, host_col)), "rule-counts")
    verdict = host_verdicts(rows, max_rate).withColumnRenamed("host", "_host")
    return (
        rows.join(verdict, F.col("host").eqNullSafe(F.col("_host")))
        .drop("_host")
        .withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
    )
