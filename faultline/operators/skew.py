"""Joins against edge tables whose key may be extremely popular.

A key with more than ``hot_rows`` edges is split into several salts. The list of
such keys can never exceed edges / hot_rows entries; whether it is broadcast is
left to Spark's own size check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import Scratch

HOT_ROWS = 2_000_000


@dataclass(frozen=True)
class SplitEdges:
    """Edges keyed by ``key``, salted when some keys are hot."""

    edges: DataFrame
    key: str
    hot: DataFrame | None = None  # (key, fan), only when such keys exist

    def follow(self, frontier: DataFrame, on: str) -> DataFrame:
        """Join ``frontier`` to the edges that start at its ``on`` column."""
        if self.hot is None:
            return frontier.join(self.edges, F.col(on) == F.col(self.key))
        fans = self.hot.select(F.col(self.key).alias(on), F.col("fan").alias("_fan"))
        spread = frontier.join(fans, on, "left").withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1))
        )
        matched = (spread[on] == self.edges[self.key]) & (spread["salt"] == self.edges["salt"])
        return spread.join(self.edges, matched).drop("salt", "_fan")


def split_hot(
    edges: DataFrame, key: str, spread_by: str, scratch: Scratch, hot_rows: int = HOT_ROWS
) -> SplitEdges:
    """Measure the key and salt its hot values."""
    heavy = (
        edges.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("fan"))
    )
    hot, n = scratch.keep_counted(heavy, f"hot-{key}")
    if n == 0:
        return SplitEdges(edges, key)
    salted = edges.join(hot, key, "left").withColumn(
        "salt",
        F.when(F.col("fan").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread_by), F.col("fan")).cast("int")),
    ).drop("fan")
    return SplitEdges(scratch.keep(salted, f"salted-{key}"), key, hot)
