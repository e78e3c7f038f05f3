"""Row numbers and top-k per group without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.operators.skew import broadcast_if_small
from casewise.session import materialize


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Number the rows of each group from 1 in the given order, as ``row_number`` would.

    The rows are range-partitioned on (group, order), so a group of any size is cut
    into pieces that different tasks sort. Only one line per (group, piece) takes part
    in the running count that turns positions inside a piece into positions in the group.
    The order must be total (end it with an id) for the numbers to be reproducible.
    """
    keys = [F.col(g) for g in group]
    pieces = materialize(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("__position", F.monotonically_increasing_id())
        .withColumn("__piece", F.shiftright(F.col("__position"), 33))
    )
    sizes = pieces.groupBy(*group, "__piece").agg(
        F.min("__position").alias("__first"), F.count(F.lit(1)).alias("__size")
    )
    earlier = Window.partitionBy(*group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group,
        "__piece",
        "__first",
        F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"),
    )
    return (
        pieces.join(broadcast_if_small(offsets), [*group, "__piece"])
        .withColumn(out, (F.col("__before") + F.col("__position") - F.col("__first") + 1).cast("long"))
        .select(*df.columns, out)
    )


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None, dealt: bool = False) -> DataFrame:
    """First ``k`` rows of each group, the feature of a report.

    The filter on the row number is pushed below the shuffle (window group limit), so each
    task forwards at most ``k`` rows per group. For that a task sorts all its rows; ``dealt`` first deals
    them into parts of the advisory size, so that what a task sorts does not grow with the input.
    """
    column = rank or "__rank"
    df = df.hint("rebalance") if dealt else df
    ranked = df.withColumn(column, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    kept = ranked.where(F.col(column) <= k)
    return kept if rank else kept.drop(column)


def page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of an ordered list. ``total_matches`` gives the size of the list."""
    return df.orderBy(*order).offset(skip).limit(limit)


def total_matches(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
