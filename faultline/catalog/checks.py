"""Measured metrics against expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.catalog.precision import kept
from faultline.catalog.registry import query, sql
from faultline.operators import scans as S
from faultline.operators.expectations import check
from faultline.sources.binding import Graph


@query("expectation_check", sql("""
SELECT metric, op, CAST(expected AS DOUBLE) AS expected, CAST(actual AS DOUBLE) AS actual, CASE op WHEN 'eq' THEN actual=expected WHEN 'lte' THEN actual<=expected ELSE actual>=expected END IS TRUE AS ok FROM (
SELECT 'Package' AS metric, 'eq' AS op, (SELECT count(*) FROM part) AS expected, (SELECT count(*) FROM pkg) AS actual
UNION ALL SELECT 'Service', 'eq', (SELECT count(*) FROM customer), (SELECT count(*) FROM svc)
UNION ALL SELECT 'Lockfile', 'lte', (SELECT count(*) FROM orders), (SELECT count(*) FROM lock)
UNION ALL SELECT 'Version', 'gte', (SELECT count(*) FROM part), (SELECT count(*) FROM ver)
UNION ALL SELECT 'Maintainer', 'gte', (SELECT count(*) FROM part), (SELECT count(*) FROM mtn)
UNION ALL SELECT 'exposed', 'lte', (SELECT count(*) FROM clo WHERE depth<=6), (SELECT count(*) FROM gclo)
UNION ALL SELECT 'unmeasured', 'eq', 0, NULL)"""))
def expectation_check(g: Graph) -> DataFrame:
    """Graph counts and refined exposure against the source tables' counts."""
    def measured(df: DataFrame, metric: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit(metric).alias("metric"), F.col("v"))

    def source(table: str) -> DataFrame:
        return g.spark.read.parquet(g.source(table))

    def expect(metric: str, op: str, df: DataFrame) -> DataFrame:
        return measured(df, metric).select("metric", F.lit(op).alias("op"), F.col("v").alias("expected"))

    wanted = [
        expect("Package", "eq", source("part")), expect("Service", "eq", source("customer")), expect("Lockfile", "lte", source("orders")),
        expect("Version", "gte", source("part")), expect("Maintainer", "gte", source("part")), expect("exposed", "lte", g.closure(6)),
        expect("unmeasured", "eq", source("part").where(F.lit(False))),
    ]
    metrics = S.graph_stats(g).select("metric", F.col("value").cast("double").alias("actual")).unionByName(
        measured(kept(g), "exposed").withColumnRenamed("v", "actual")
    )
    return check(metrics, reduce(DataFrame.unionByName, wanted))
