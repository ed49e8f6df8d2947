"""Compare measured metrics with expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(metrics: DataFrame, expected: DataFrame) -> DataFrame:
    """(metric, op, expected, actual, ok); a metric that was not measured fails.

    ``metrics`` has (metric, actual), ``expected`` (metric, op, expected) with op one
    of eq, lte, gte.
    """
    actual, wanted, op = F.col("actual"), F.col("expected"), F.col("op")
    verdict = F.when(op == "eq", actual == wanted).when(op == "lte", actual <= wanted).when(op == "gte", actual >= wanted)
    return expected.join(metrics, "metric", "left").select(
        "metric", "op", "expected", "actual", F.coalesce(verdict, F.lit(False)).alias("ok")
    )
