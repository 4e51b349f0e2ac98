"""Session helpers: a local session for tests/bench and the lineage-cutting checkpoint."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "corpusrisk") -> SparkSession:
    """Local session used by tests and bench (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring it from ``spark.checkpoint.dir``.

    On a cluster the directory must be a shared file system named by the session; only a
    local-mode session (tests, bench) without one gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder; a machine-local one does not survive executor loss")
    scratch = tempfile.mkdtemp(prefix="corpusrisk-ckpt-", dir=os.environ.get("CORPUSRISK_SCRATCH", "/tmp"))
    sc.setCheckpointDir(scratch)
    return scratch


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the reliable checkpoint folder so that partition contents and
    row order stay fixed across the jobs that read it (and survive executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    # persist first: the checkpoint write then reads the cached rows instead of recomputing them
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, for tables that a loop makes anew in each round:
    unlike a checkpoint it can be deleted, with :func:`drop`, as soon as no later job reads it."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.kept_at = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps whose results are kept: it does so once the driver's
    garbage collector has found their plans unused."""
    gc.collect()  # Python's garbage may hold the driver's
    spark.sparkContext._jvm.System.gc()


def drop(table: DataFrame) -> None:
    """Delete a table, given as :func:`keep` returned it, and :func:`release` the shuffle files of the steps before it."""
    spark = table.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.kept_at)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    release(spark)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition a scan that has fewer partitions than the cluster has task slots
    (a small file with few row groups feeding CPU-heavy regex work).  A large input already has
    at least that many splits, so this is a no-op at scale and adds no shuffle there."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only after its data has been measured below ``max_bytes`` (release lists,
    vocabularies, metric tables); otherwise leave the join strategy to AQE.  ``df`` is measured by
    a job of its own, so pass a pinned or otherwise cheap table."""
    from pyspark.sql import functions as F

    width = F.lit(16)
    for f in df.schema.fields:
        plain = f.dataType.simpleString() in ("int", "bigint", "double", "float", "boolean", "smallint", "tinyint", "date", "timestamp")
        width = width + (F.lit(8) if plain else F.coalesce(F.octet_length(F.col(f.name) if f.dataType.simpleString() in ("string", "binary") else F.to_json(F.struct(f.name))), F.lit(0)) + 16)
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df
