"""Joins that attach to each row what belongs to its key.

There is one plan for every size. The table has one row per key; it is repeated ``SPREAD`` times and
the rows of a key are dealt over the copies by a hash of their other columns, so no key, nor the null
keys, goes to one task whole. As both inputs of the join are then shuffles of their own, adaptive
execution can split what is still too large, and broadcasts a table that turns out to be small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.session import materialize

SPREAD = 8
BROADCAST_ROWS = 200_000
# A key with more rows than this is dealt over several tasks.
HEAVY_ROWS = 50_000
_HASHED = ("string", "bigint", "int", "double", "timestamp", "date", "boolean")


def attach_group(rows: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], among: DataFrame | None = None) -> DataFrame:
    """Add aggregates of each row's key group to the row; rows with a null key get nulls.

    ``among`` are the rows that the groups are made of, where ``rows`` has been extended since.
    """
    known = rows if among is None else among
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return lookup(rows, known.groupBy(*keys).agg(*aggregates), keys)


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join a table with one row per key to rows whose keys may be skewed."""
    values = [c for c in table.columns if c not in keys]
    copies = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    right = table.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *values, copies.alias("__of_spread"))
    others = [name for name, kind in rows.dtypes if kind in _HASHED and name not in keys]
    spread = F.pmod(F.xxhash64(*(others or keys)), F.lit(SPREAD)).cast("int")
    same = F.col("__spread") == F.col("__of_spread")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__of_{k}"))
    return rows.withColumn("__spread", spread).join(right, same, "left").select(*rows.columns, *values)


def lookup_large(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``lookup`` for a table about as large as the rows: only keys with more than ``HEAVY_ROWS`` rows have copies.

    The rows of each key are counted first, partially aggregated; the heavy keys, at most one in ``HEAVY_ROWS`` rows, are written.
    """
    known = rows.select(*keys)
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    counted = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > HEAVY_ROWS)
    heavy = materialize(counted.select(*[F.col(k).alias(f"__heavy_{k}") for k in keys], F.lit(True).alias("__heavy")), "heavy-keys")
    heavy = broadcast_if_small(heavy)
    values = [c for c in table.columns if c not in keys]

    def marked(df: DataFrame) -> DataFrame:
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.col(f"__heavy_{k}"))
        return df.join(heavy, same, "left")

    copies = F.explode(F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))))
    right = marked(table).select(*[F.col(k).alias(f"__of_{k}") for k in keys], *values, copies.alias("__of_spread"))
    others = [name for name, kind in rows.dtypes if kind in _HASHED and name not in keys]
    # Null keys are dealt too.
    dealt = F.col("__heavy") | F.coalesce(*[F.when(F.col(k).isNull(), True) for k in keys])
    spread = F.when(dealt, F.pmod(F.xxhash64(*(others or keys)), F.lit(SPREAD))).otherwise(0).cast("int")
    same = F.col("__spread") == F.col("__of_spread")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__of_{k}"))
    return marked(rows).withColumn("__spread", spread).join(right, same, "left").select(*rows.columns, *values)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the rows are few; otherwise leave the plan open."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread_rows(df: DataFrame, rows: int) -> DataFrame:
    """Deal rows that each take long over the cores, at most about ``rows`` to a task, whatever the files they came from."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks)
