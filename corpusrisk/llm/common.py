"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrisk.session import ensure_checkpoint_dir

# the six ASCII white-space characters that separate words in every contract
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"


_scratch: list[str] = []  # paths of tables that belong to the scratch begun last


def stage(df: DataFrame, label: str, codec: str | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, later
    jobs read the table, and a lost executor costs only its running tasks.

    The table stays until :func:`discard` or, unless ``keep``, until the next :func:`begin_scratch`."""
    path = shared_path(df.sparkSession, label)
    schema = df.schema
    df.write.parquet(path, compression=codec)
    if not keep:
        _scratch.append(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(table: DataFrame) -> None:
    """Delete a staged table, given as :func:`stage` returned it, that no later job reads."""
    _delete(table.sparkSession, table.staged_at)
    if table.staged_at in _scratch:
        _scratch.remove(table.staged_at)


def begin_scratch(spark: SparkSession) -> None:
    """Delete the tables staged since the last call.  For callers whose earlier results are all written:
    a result is read from staged tables until it is."""
    while _scratch:
        _delete(spark, _scratch.pop())


_worker_tables: list[dict] = []


def worker_table(table: dict) -> dict:
    """Register a table that a Python worker keeps from task to task to save work."""
    _worker_tables.append(table)
    return table


def forget_worker_tables() -> None:
    """Empty this worker's registered tables, at the start of tasks that need the memory."""
    for table in _worker_tables:
        table.clear()


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that are staged already: it does so once
    the driver's garbage collector has found their plans unused."""
    for _ in range(2):  # Python's garbage may hold the driver's
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def id_text_columns(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    return [F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` (null text: empty) of ``docs``; all other columns are left behind."""
    return docs.select(*id_text_columns(id_col, text_col))


def row_number(rid_col: str | None) -> Column:
    """The row number in ``rid_col``; without one, a number that holds within this scan only."""
    return (F.col(rid_col) if rid_col else F.monotonically_increasing_id()).alias("rid")


def numbered(docs: DataFrame, label: str = "numbered") -> tuple[DataFrame, str]:
    """A staged copy of ``docs`` with a row number in a new column, and the name of that column.

    ``monotonically_increasing_id`` follows the file splits of a scan, which follow the executors
    of the moment: only a number that is written once is the same for every later job."""
    rid = fresh_name(docs, "rid")
    return stage(docs.withColumn(rid, F.monotonically_increasing_id()), label, "zstd"), rid


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """The held-out quarter: crc32 of the id as text, modulo 4, is 2 (null id: false)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def number_rows(df: DataFrame, order: list[str | Column], label: str, out: str = "idx") -> DataFrame:
    """Add ``out``: the row's 0-based position in the total order ``order`` (staged).

    Rows are range-sorted; a row's place within its partition is written with it, and the
    partitions' row counts (one row per partition) give the offsets.  No task holds more than a
    range partition, however the keys are spread, as long as ``order`` tells rows apart."""
    from pyspark.sql import Window

    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    n = shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    placed = stage(ranged.withColumn("_mid", F.monotonically_increasing_id()), label)
    part, pos = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # one offset per range partition: its size is the configured partition count
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(out, F.col("_off") + pos).drop("_mid", "_part", "_off")


def _ranged(df: DataFrame, cols: list[Column], label: str) -> DataFrame:
    """``df`` range-sorted and staged, each row with its partition and place (``_part``, ``_mid``)."""
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *cols).sortWithinPartitions(*cols)
    return stage(ranged.withColumn("_mid", F.monotonically_increasing_id()), label).withColumn("_part", F.shiftright("_mid", 33))


def running_total(df: DataFrame, key: str, order: list[str | Column], value: str, label: str, out: str = "upto") -> DataFrame:
    """Add ``out``: the running sum of ``value`` (long, inclusive) within ``key`` (not null) in ``order``.

    A key may span any number of range partitions: sums run within (partition, key), and what
    earlier partitions hold of a key is added.  Only the first key of a partition can go on from an
    earlier one, so those carries are at most one row per partition."""
    from pyspark.sql import Window

    placed = _ranged(df, [F.col(key), *(F.col(c) if isinstance(c, str) else c for c in order)], label)
    sums = placed.groupBy("_part", key).agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("_part", key, F.sum("_s").over(earlier).alias("_base")).filter(F.col("_base").isNotNull())
    inner = Window.partitionBy("_part", key).orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumn("_run", F.sum(value).over(inner))
    total = (F.coalesce("_base", F.lit(0)) + F.col("_run")).cast("long")
    return run.join(F.broadcast(carry), ["_part", key], "left").withColumn(out, total).drop("_part", "_mid", "_run", "_base")


def places(df: DataFrame, key: str, order: list[str | Column], out: str, label: str, size: str | None = None) -> DataFrame:
    """Add ``out``, the row's 0-based place within its ``key`` (not null) in ``order``, and ``size``,
    the number of rows of the key.

    Rows are numbered and counted within (partition, key); for keys that several partitions share -
    at most two per partition - the counts of the others are added from a small table."""
    from pyspark.sql import Window

    placed = _ranged(df, [F.col(key), *(F.col(c) if isinstance(c, str) else c for c in order)], label)
    counts = placed.groupBy("_part", key).agg(F.count(F.lit(1)).alias("_n"))
    of_key = Window.partitionBy(key)
    earlier = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shared = counts.select("_part", key, "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"), F.sum("_n").over(of_key).alias("_all")).filter("_all > _n").drop("_n")
    inner = Window.partitionBy("_part", key)
    rows = placed.withColumn("_row", F.row_number().over(inner.orderBy("_mid")) - 1).withColumn("_here", F.count(F.lit(1)).over(inner))
    rows = rows.join(F.broadcast(shared), ["_part", key], "left").withColumn(out, (F.col("_row") + F.coalesce("_base", F.lit(0))).cast("long"))
    if size:
        rows = rows.withColumn(size, F.coalesce("_all", "_here").cast("long"))
    return rows.drop("_part", "_mid", "_row", "_here", "_base", "_all")
