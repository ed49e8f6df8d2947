"""Global numbering and in-group ranks without a single-task window.

Rows are range-partitioned on the whole sort tuple, so one group holding a
third of the rows is still spread over many tasks. Only one row per *partition*
meets in a single task to turn local positions into global ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import Scratch

_LOCAL_BITS = 33  # layout of monotonically_increasing_id


def number_rows(
    df: DataFrame, order: list[Column], scratch: Scratch, name: str = "position", grouped: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Add a dense 0-based position of every row in ``order``.

    ``grouped`` may aggregate by the columns of ``order``; its rows are numbered, where the rows of ``df`` were dealt to.
    """
    dealt = df.repartitionByRange(*order)
    placed = scratch.keep(
        (dealt if grouped is None else grouped(dealt))
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "numbered",
    )
    part = F.shiftright("_at", _LOCAL_BITS)
    # one row per shuffle partition, so this window and broadcast stay small at any scale
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    local = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + local)
        .drop("_part", "_start", "_at")
    )


def rank_within(
    df: DataFrame, group: list[str], order: list[Column], scratch: Scratch, name: str = "rank"
) -> DataFrame:
    """Add the 1-based rank of each row inside its group."""
    numbered = number_rows(df, [F.col(g) for g in group] + order, scratch, "_position")
    firsts = numbered.groupBy(*group).agg(F.min("_position").alias("_first"))
    return (
        numbered.join(firsts, group)
        .withColumn(name, F.col("_position") - F.col("_first") + 1)
        .drop("_position", "_first")
    )
