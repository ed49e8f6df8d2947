"""Vulnerability records in the public OSV JSON format, as advisory rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "struct<introduced:string,fixed:string,last_affected:string>"
AFFECTED = (
    "struct<package:struct<name:string,ecosystem:string>,versions:array<string>,"
    f"ranges:array<struct<type:string,events:array<{EVENT}>>>>"
)
RECORD = (
    "id string, summary string, details string, published string, modified string, aliases array<string>, "
    f"affected array<{AFFECTED}>, database_specific struct<severity:string>"
)
_PAIRS = "array<struct<introduced:string,fixed:string>>"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per line."""
    return spark.read.schema(RECORD).json(path)


def pairs_of(events: Column) -> Column:
    """(introduced, fixed) windows of an ordered event list.

    A window still open at the next ``introduced`` or at the end has no upper
    bound, and so has one closed by ``last_affected``.
    """
    empty = F.array().cast(_PAIRS)
    text = F.lit(None).cast("string")

    def pair(low: Column, high: Column) -> Column:
        return F.array(F.struct(low.alias("introduced"), high.alias("fixed")))

    def state(done: Column, low: Column, opened: Column) -> Column:
        return F.struct(done.alias("done"), low.alias("low"), opened.alias("opened"))

    def step(acc: Column, event: Column) -> Column:
        low = F.when(acc["opened"], acc["low"])
        return (
            F.when(
                event["introduced"].isNotNull(),
                state(
                    F.concat(acc["done"], F.when(acc["opened"], pair(acc["low"], text)).otherwise(empty)),
                    event["introduced"],
                    F.lit(True),
                ),
            )
            .when(
                event["fixed"].isNotNull() | event["last_affected"].isNotNull(),
                state(F.concat(acc["done"], pair(low, event["fixed"])), text, F.lit(False)),
            )
            .otherwise(acc)
        )

    return F.aggregate(
        F.coalesce(events, F.array().cast(f"array<{EVENT}>")),
        state(empty, text, F.lit(False)),
        step,
        lambda acc: F.concat(acc["done"], F.when(acc["opened"], pair(acc["low"], text)).otherwise(empty)),
    )


def advisories_of(records: DataFrame, first_only: bool = False) -> DataFrame:
    """Advisory rows, one per record and affected (ecosystem, package).

    Only the affected entries of a row's own package contribute its versions and
    ranges. ``first_only`` keeps the first entry's package and no other.
    """
    entries = F.filter(F.coalesce("affected", F.array().cast(f"array<{AFFECTED}>")), lambda a: a.isNotNull())
    eco = F.lower(F.coalesce(F.col("t.ecosystem"), F.lit("npm")))

    def mine(a: Column) -> Column:
        return (a["package"]["name"] == F.col("t.name")) & (
            F.lower(F.coalesce(a["package"]["ecosystem"], F.lit("npm"))) == eco
        )

    targets = F.array_distinct(
        F.transform(
            F.slice(entries, 1, 1) if first_only else entries,
            lambda a: F.struct(
                a["package"]["name"].alias("name"),
                F.lower(F.coalesce(a["package"]["ecosystem"], F.lit("npm"))).alias("ecosystem"),
            ),
        )
    )
    own = F.slice(entries, 1, 1) if first_only else F.filter(entries, mine)
    detail = F.regexp_replace("details", r"^\s+|\s+$", "")
    none = F.array().cast("array<string>")
    semver_ranges = F.flatten(
        F.transform(
            own,
            lambda a: F.filter(
                F.coalesce(a["ranges"], F.array().cast(f"array<struct<type:string,events:array<{EVENT}>>>")),
                lambda r: r["type"] == "SEMVER",
            ),
        )
    )
    return (
        records.where("id IS NOT NULL AND id <> ''")
        .withColumn("t", F.explode(targets))
        .select(
            "id",
            F.coalesce("t.name", F.lit("unknown")).alias("package"),
            F.col("t.ecosystem").alias("ecosystem"),
            F.coalesce(
                F.nullif("summary", F.lit("")),
                F.nullif(F.element_at(F.split(detail, r"\r\n|\r|\n"), 1), F.lit("")),
            ).alias("summary"),
            F.col("database_specific.severity").alias("severity"),
            F.col("id").startswith("MAL-").alias("malicious"),
            "published",
            "modified",
            F.array_distinct(F.flatten(F.transform(own, lambda a: F.coalesce(a["versions"], none)))).alias("affected_versions"),
            F.flatten(F.transform(semver_ranges, lambda r: pairs_of(r["events"]))).alias("ranges"),
            F.coalesce("aliases", none).alias("aliases"),
        )
    )
