"""Sequence batching (``fn_chunk``, ``fn_pad_right``, ``smp_trim_majority`` use): documents are
grouped into batches of ``batch_size`` (after dropping just enough negatives), every document of
a batch right-padded to the batch's longest length rounded up to ``steps``, then cut into chunks
of ``steps``.  Positions come from a seeded shuffle and :func:`dense_index`; a batch is a group
of ``batch_size`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrisk.functions import vectors as vx
from corpusrisk.operators.prefix import dense_index
from corpusrisk.operators.sampling import seeded_key, trim_majority
from corpusrisk.session import pin


def make_batches(df: DataFrame, batch_size: int, steps: int, pad: int, seed: int = 1, id_col: str = "file", label: str = "label", vector: str = "vectors", order: str | None = None) -> DataFrame:
    """``(batch, slot, file, label, chunks ARRAY<ARRAY<INT>>)``.  ``order`` (optional) replaces
    the seeded shuffle with an explicit order column."""
    # vectors are kept once; rows are trimmed and numbered without them
    rows = pin(df).withColumn("_row", F.monotonically_increasing_id())
    keys = rows.select("_row", id_col, label, F.size(vector).alias("_n"), *([order] if order and order not in (id_col, label) else []))
    trimmed = trim_majority(keys, id_col, label, batch_size, seed)
    keyed = trimmed.withColumn("_k", F.col(order) if order else seeded_key(seed, id_col))
    pos = dense_index(keyed, ["_k", id_col], out="_pos").select("_row", "_pos", id_col, label, "_n")
    pos = pos.withColumn("batch", F.floor(F.col("_pos") / batch_size).cast("long")).withColumn("slot", (F.col("_pos") % batch_size).cast("int"))
    lens = pos.groupBy("batch").agg((F.ceil(F.max("_n") / F.lit(steps)) * steps).cast("int").alias("_len"))
    j = rows.select("_row", vector).join(pos.join(lens, "batch"), "_row")
    padded = vx.pad_right(F.col(vector), F.col("_len"), pad)
    return j.select("batch", "slot", id_col, label, vx.chunks(padded, steps, F.col("_len")).alias("chunks"))
