"""Seeded, partition-independent pseudo-random numbers as column expressions.

Every draw is ``md5(seed | key ...)`` truncated to 32 bits, so a row's value depends only on its
own key columns: re-running a job, re-partitioning it or losing an executor gives the same
numbers, and DuckDB can rebuild them with ``('0x' || substr(md5(...), 1, 8))::BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _key(seed, *cols) -> Column:
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.concat_ws("|", *parts)


def hash32(seed, *cols) -> Column:
    """Unsigned 32-bit hash of ``seed|cols`` (BIGINT in [0, 2^32))."""
    return F.conv(F.substring(F.md5(_key(seed, *cols)), 1, 8), 16, 10).cast("bigint")


def uniform(seed, *cols) -> Column:
    """Uniform draw in [0, 1)."""
    return hash32(seed, *cols) / F.lit(TWO_POW_32)


def uniform_open(seed, *cols) -> Column:
    """Uniform draw in (0, 1]: safe under ``ln``."""
    return F.lit(1.0) - uniform(seed, *cols)


def bucket(seed, n: int, *cols) -> Column:
    """Group number in [0, n) (``flt_dev_group`` uses n = 100)."""
    return F.pmod(hash32(seed, *cols), F.lit(n))


def geometric(p: float, u: Column) -> Column:
    """Geometric(p) on {1, 2, ...} from a (0, 1] uniform by inversion."""
    import math

    return F.greatest(F.lit(1), F.ceil(F.log(u) / F.lit(math.log(1.0 - p))).cast("int"))


def sql_hash32(seed, *cols: str) -> str:
    """DuckDB spelling of :func:`hash32` for oracle SQL."""
    inner = ", ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 8))::BIGINT"
