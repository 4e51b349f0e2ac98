"""Global ordinal index and keyed running sums without a single-task window.

A window with no ``partitionBy`` (or one whose key holds a third of all rows) runs in one task.
Both helpers here instead range-partition on ``keys + order`` (the range sampler spreads a hot
key over many partitions), pin that layout with a reliable checkpoint, compute per-partition
totals (one small row per partition), turn them into carry-in offsets, and add the offsets in a
second pass over the pinned rows.  Work and memory per task stay bounded by the partition
size whatever the key skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusrisk.session import pin

_POS_BITS = 33  # monotonically_increasing_id: partition id in the upper bits, row number below


def _range(df: DataFrame, cols: list[Column], n: int | None) -> DataFrame:
    """Range-partition on ``cols`` into ``n`` or the session's configured shuffle partitions."""
    return df.repartitionByRange(n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def _sort_cols(order: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def dense_index(df: DataFrame, order: Sequence, out: str = "idx", num_partitions: int | None = None, base: int = 0) -> DataFrame:
    """Add ``out`` = 0-based (or ``base``-based) position of each row in the total order ``order``.

    ``order`` must be a total order (break ties with a unique column) for a deterministic result.
    JVM-only: the in-partition position comes from ``monotonically_increasing_id`` over the pinned,
    sorted partitions and the partition offsets from a broadcast of one row per partition.
    """
    cols = _sort_cols(order)
    ranged = pin(_range(df, cols, num_partitions).sortWithinPartitions(*cols))
    mid = F.monotonically_increasing_id()
    pos = ranged.withColumn("_cr_mid", mid).withColumn("_cr_pid", F.shiftright(F.col("_cr_mid"), _POS_BITS)).withColumn(
        "_cr_pos", F.col("_cr_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    )
    # one row per non-empty partition: the offset table is bounded by the partition count
    counts = pos.groupBy("_cr_pid").agg(F.count(F.lit(1)).alias("_cr_n"))
    offsets = counts.select(
        "_cr_pid",
        (F.sum("_cr_n").over(Window.orderBy("_cr_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_cr_off"),
    ).fillna(0, subset=["_cr_off"])
    return (
        pos.join(F.broadcast(offsets), "_cr_pid")  # one row per partition: bounded by the partition count
        .withColumn(out, (F.col("_cr_off") + F.col("_cr_pos") + F.lit(base)).cast("long"))
        .drop("_cr_mid", "_cr_pid", "_cr_pos", "_cr_off")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    values: Sequence[str],
    out_prefix: str = "cum_",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``cum_<v>`` = inclusive running sum of ``v`` within each ``keys`` group in ``order``.

    Equivalent to ``sum(v).over(partitionBy(keys).orderBy(order).rowsBetween(unbounded, 0))``,
    null keys being a group of their own, but a key may span any number of partitions.  ``order``
    must be total within a key (aggregate equal values first), or ties share a partition.  Values
    are summed as doubles (counts stay exact below 2^53).

    Rows are pinned in range order; sums run inside each (partition, key), and what earlier
    partitions hold of a key is carried in: at most one key per partition goes on from the one
    before it, so the carry table has at most one row per partition."""
    keys, values = list(keys), list(values)
    cols = [F.col(k) for k in keys] + _sort_cols(order)
    mid = F.monotonically_increasing_id()
    ranged = pin(_range(df, cols, num_partitions).sortWithinPartitions(*cols).withColumn("_cr_mid", mid))
    placed = ranged.withColumn("_cr_pid", F.shiftright("_cr_mid", _POS_BITS))
    num = {v: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values}
    sums = placed.groupBy("_cr_pid", *keys).agg(*[F.sum(num[v]).alias(f"_cr_s_{i}") for i, v in enumerate(values)])
    earlier = Window.partitionBy(*keys).orderBy("_cr_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        F.col("_cr_pid").alias("_cr_cpid"),
        *[F.col(k).alias(f"_cr_k_{i}") for i, k in enumerate(keys)],
        *[F.sum(f"_cr_s_{i}").over(earlier).alias(f"_cr_c_{i}") for i in range(len(values))],
    ).filter(F.col("_cr_c_0").isNotNull())
    inner = Window.partitionBy("_cr_pid", *keys).orderBy("_cr_mid").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.select("*", *[F.sum(num[v]).over(inner).alias(f"_cr_r_{i}") for i, v in enumerate(values)])
    same = F.col("_cr_pid") == F.col("_cr_cpid")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_cr_k_{i}"))
    # bounded: at most one row per range partition
    out = run.join(F.broadcast(carry), same, "left")
    total = lambda i: F.col(f"_cr_r_{i}") + F.coalesce(F.col(f"_cr_c_{i}"), F.lit(0.0))
    return out.select(*df.columns, *[total(i).alias(out_prefix + v) for i, v in enumerate(values)])
