"""Splits, samples, limits and ids (``flt_position_split``, ``smp_*``, ``lim_train``,
``ml_time_split``, ``prj_docid``, ``fn_time``).

Every random choice is a seeded md5 order of the row's own id, so samples do not depend on
partitioning and survive recomputation; positions come from :func:`dense_index`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusrisk.operators.prefix import dense_index

# Generated-data split fractions (train / valid / test by position)
TRAIN_FRACTION, VALID_END_FRACTION = 0.6, 0.8


def seeded_key(seed, id_col: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def sample_exact(df: DataFrame, id_col: str, n: int, seed=1) -> DataFrame:
    """``smp_exact``: exactly ``n`` rows without replacement (error if ``n`` exceeds the rows):
    the ``n`` first rows in ``(md5(seed|id), id)`` order, independent of partitioning.

    No task ever holds the sample: an approximate quantile of the 32-bit hash prefix gives a
    threshold with at least ``n`` rows at or below it (widened until it does); the candidates
    are then numbered by :func:`dense_index` and the first ``n`` kept.  Every row above the
    threshold sorts after every candidate, so the result is exact."""
    from corpusrisk.functions.rand import hash32

    total = df.count()
    if n > total:
        raise ValueError(f"cannot take a sample of {n} from {total} rows")
    keyed = df.withColumn("_k", seeded_key(seed, id_col)).withColumn("_h", hash32(seed, id_col))
    frac = min(1.0, n / max(total, 1) * 1.05 + 1000.0 / max(total, 1))
    while True:
        t = keyed.agg(F.percentile_approx("_h", frac, 10000)).first()[0] if frac < 1.0 else None
        cand = keyed if t is None else keyed.filter(F.col("_h") <= t)
        if t is None or cand.count() >= n:
            break
        frac = min(1.0, frac * 2)
    ided = dense_index(cand, ["_k", id_col], out="_s")
    return ided.filter(F.col("_s") < n).drop("_k", "_h", "_s")


def shuffle_positions(df: DataFrame, id_col: str, seed=1, out: str = "shuffle_pos") -> DataFrame:
    """``smp_shuffle``: a seeded full shuffle, as each row's position in the shuffled order."""
    return dense_index(df.withColumn("_k", seeded_key(seed, id_col)), ["_k", id_col], out=out).drop("_k")


def trim_majority(df: DataFrame, id_col: str, label: str, batch_size: int, seed=1) -> DataFrame:
    """``smp_trim_majority`` + ``set_relabel_union``: keep every positive and drop just enough
    negatives (the last in seeded order) that the row count is a multiple of ``batch_size``."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 0).alias("neg")).first()
    keep_neg = counts["neg"] - counts["n"] % batch_size
    if keep_neg < 0:
        raise ValueError("not enough negatives to trim to a multiple of the batch size")
    neg = dense_index(df.filter(F.col(label) == 0).withColumn("_k", seeded_key(seed, id_col)), ["_k", id_col], out="_r")
    return df.filter(F.col(label) == 1).unionByName(neg.filter(F.col("_r") < keep_neg).drop("_k", "_r"))


def position_split(df: DataFrame, order: Sequence[str], keep_index: bool = False) -> DataFrame:
    """``flt_position_split``: first 60 % train, next 20 % valid, the rest test, by position."""
    ided = dense_index(df, list(order), out="_row")
    n = ided.count()
    t, v = int(TRAIN_FRACTION * n), int(VALID_END_FRACTION * n)
    out = ided.withColumn("part", F.when(F.col("_row") < t, "train").when(F.col("_row") < v, "valid").otherwise("test"))
    return out if keep_index else out.drop("_row")


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """``lim_train``: the first ``n`` rows in ``order`` (re-indexed, no single-task sort)."""
    return dense_index(df, [order], out="_lim").filter(F.col("_lim") < n).drop("_lim")


def doc_id_hex(h) -> Column:
    """``prj_docid``: 16 hex digits of a 32-bit hash (negative -> two's complement)."""
    c = F.col(h) if isinstance(h, str) else h
    return F.lpad(F.lower(F.hex(F.pmod(c.cast("bigint"), F.lit(4294967296)))), 16, "0")


def iso_timestamp(ts, naive_utc: bool = True) -> Column:
    """``fn_time``: ISO-8601 with offset, microseconds only when non-zero (Python ``isoformat``).

    With ``naive_utc`` the input is a wall-clock (``TIMESTAMP_NTZ``) time taken as UTC, and the
    text does not depend on the session time zone; otherwise the instant is rendered in the
    session time zone with its offset."""
    raw = F.col(ts) if isinstance(ts, str) else ts
    c = raw.cast("timestamp_ntz") if naive_utc else raw.cast("timestamp")
    micros = F.date_format(c, "SSSSSS")
    frac = F.when(micros != F.lit("000000"), F.concat(F.lit("."), micros)).otherwise(F.lit(""))
    offset = F.lit("+00:00") if naive_utc else F.date_format(c, "xxx")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), frac, offset)


def epoch_seconds(ts) -> Column:
    """Whole seconds since 1970-01-01 of a wall-clock time taken as UTC (session-zone free)."""
    c = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    return (F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("long")


def time_key(name) -> Column:
    """``fn_time_key``: split key without the ``Time_`` prefix."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(c, "^Time_", "")


def release_years(df: DataFrame, time_col: str) -> DataFrame:
    return df.select(F.year(time_col).alias("_yr")).distinct()


def time_split(df: DataFrame, time_col: str) -> DataFrame:
    """``ml_time_split``: for every release year, rows of earlier years are ``train`` and rows of
    that year ``test``.  Every year is paired with itself and the later release years on the
    table of distinct years (a few rows), and rows join those pairs by equality."""
    later = Window.orderBy("_yr").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    pairs = release_years(df, time_col).filter(F.col("_yr").isNotNull()).select("_yr", F.collect_list("_yr").over(later).alias("_later")).select("_yr", F.explode("_later").alias("_release"))
    return df.withColumn("_yr", F.year(time_col)).join(pairs, "_yr").select(
        *df.columns, F.col("_release").cast("string").alias("split"), F.when(F.col("_yr") < F.col("_release"), "train").otherwise("test").alias("part")
    )


def release_train_fraction(df: DataFrame, time_col: str) -> DataFrame:
    """``rep_train_fraction``: per release year, rows before it (train), rows in it (test) and
    the training fraction.  Rows are counted per year first; the cumulative window runs over
    the per-year table (one row per year)."""
    y = df.groupBy(F.year(time_col).alias("_yr")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("_yr").rowsBetween(Window.unboundedPreceding, -1)
    c = y.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    split = F.col("_yr").cast("string")
    return c.select(
        split.alias("split"),
        F.dense_rank().over(Window.orderBy(split)).cast("int").alias("release"),
        F.col("before").cast("long").alias("train_rows"),
        F.col("n").cast("long").alias("test_rows"),
        (F.col("before") / (F.col("before") + F.col("n"))).alias("train_fraction"),
    )
