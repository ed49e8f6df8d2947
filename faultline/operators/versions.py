"""Release history, bad-version choice, safe versions and range resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import semver as V
from faultline.operators.ordering import rank_within
from faultline.operators.sweep import greatest_below
from faultline.session import Scratch


def _parsed_once(strings: DataFrame, column: str, parser, name: str) -> DataFrame:
    """Parse the distinct strings of a column.

    The text handed to the parser depends on the group's count, so a later filter on
    the result is not moved below the grouping, where it would parse every row.
    """
    counted = strings.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    text = counted.select(column, F.when(F.col("_n") > 0, F.col(column)).alias("_text"))
    return text.select(column, V.of_column(parser, "_text").alias(name))


def keys_of(strings: DataFrame, column: str, parser=V.strict_key) -> DataFrame:
    """Version keys of the distinct strings in a column."""
    return _parsed_once(strings, column, parser, "key")


def ranges_of(constraints: DataFrame, column: str = "constraint_") -> DataFrame:
    """Parsed comparator sets of the distinct constraints in a column."""
    return _parsed_once(constraints, column, V.range_sets, "sets")


def with_key(versions: DataFrame, name: str) -> DataFrame:
    """Releases with their ``strict`` or ``lenient`` version key, parsed here only where it is not stored."""
    if name in versions.columns:
        return versions
    parser = V.strict_key if name == "strict" else V.lenient_key
    keys = keys_of(versions, "semver", parser).withColumnRenamed("key", name)
    if name == "lenient":
        keys = keys.withColumn(name, F.coalesce(name, V.lenient_key(F.lit("0.0.0"))))
    return versions.join(keys, "semver")


def history(versions: DataFrame, scratch: Scratch) -> DataFrame:
    """Releases of each package, highest first; unparseable ones count as 0.0.0."""
    keyed = with_key(versions, "lenient").select("package_id", "id", "semver", "lenient")
    ordered = rank_within(keyed, ["package_id"], [F.desc("lenient"), F.asc("id")], scratch)
    return ordered.select("package_id", "id", "semver", "rank")


def history_by_date(versions: DataFrame, scratch: Scratch) -> DataFrame:
    """Releases of each package, newest publication first, text order on ties."""
    ordered = rank_within(
        versions.select("package_id", "id", "semver", "published_at"),
        ["package_id"],
        [F.desc_nulls_last("published_at"), F.desc("semver")],
        scratch,
    )
    return ordered.select("package_id", "id", "semver", "published_at", "rank")


def first_windowed(versions: DataFrame) -> DataFrame:
    """Earliest release of each package inside the window, lowest id on ties."""
    order = F.struct("published_at", "id")
    return versions.where("compromised_window").groupBy("package_id").agg(
        F.min_by("id", order).alias("version_id"),
        F.min_by("semver", order).alias("semver"),
        F.min("published_at").alias("published_at"),
    )


def highest_malicious(named: DataFrame) -> DataFrame:
    """Highest named malicious release per package (column ``exact_version``).

    Released versions win over prereleases and unparseable text, which only count
    when nothing else is named (then the last in text order).
    """
    named = named.where("exact_version IS NOT NULL").select("package_id", "exact_version").distinct()
    keyed = named.join(keys_of(named, "exact_version"), "exact_version").withColumn(
        "released", F.coalesce(V.is_release(F.col("key")), F.lit(False))
    )
    # ties keep the first spelling in text order
    return keyed.groupBy("package_id").agg(
        F.coalesce(
            F.max_by("exact_version", F.when(F.col("released"), F.col("key"))),
            F.max("exact_version"),
        ).alias("malicious_semver")
    )


def bad_version(packages: DataFrame, versions: DataFrame, named: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """The release under investigation for every package.

    Order: requested, highest malicious, earliest windowed, newest. ``windowed`` is
    true for an unrecorded requested or malicious version.
    """
    newest = with_key(versions, "lenient").groupBy("package_id").agg(
        F.max_by("semver", F.struct("lenient", -F.col("id"))).alias("newest_semver")
    )
    out = (
        packages.select(F.col("id").alias("package_id"))
        .join(highest_malicious(named), "package_id", "left")
        .join(first_windowed(versions).select("package_id", F.col("semver").alias("windowed_semver")), "package_id", "left")
        .join(newest, "package_id", "left")
    )
    choices = ["malicious_semver", "windowed_semver", "newest_semver"]
    names = ["malicious", "windowed", "newest"]
    if requested is not None:
        out = out.join(requested.select("package_id", F.col("semver").alias("requested_semver")), "package_id", "left")
        choices, names = ["requested_semver", *choices], ["requested", *names]
    source = F.lit(None).cast("string")
    for column, name in reversed(list(zip(choices, names))):
        source = F.when(F.col(column).isNotNull(), name).otherwise(source)
    chosen = out.select("package_id", F.coalesce(*choices).alias("bad_version"), source.alias("source"))
    recorded = versions.select(
        "package_id", F.col("semver").alias("bad_version"), F.col("id").alias("version_id"), "compromised_window", "published_at"
    )
    return chosen.join(recorded, ["package_id", "bad_version"], "left").select(
        "package_id",
        "bad_version",
        "source",
        "version_id",
        F.coalesce("compromised_window", F.col("bad_version").isNotNull()).alias("windowed"),
        "published_at",
    )


def safe_version(bad: DataFrame, versions: DataFrame) -> DataFrame:
    """Highest release below the bad one and outside the window, with the reason.

    ``bad`` has (package_id, bad_version). ``reason`` is one of unordered, unrecorded,
    nothing_below, all_windowed, found.
    """
    bad_keyed = bad.select("package_id", "bad_version").join(
        keys_of(bad, "bad_version", V.lenient_key).withColumnRenamed("key", "bad_key"), "bad_version", "left"
    )
    # a lenient key is stored as 0.0.0 for text without a version; such text is no candidate
    readable = F.col("readable") if "readable" in versions.columns else V.lenient_key(F.col("semver")).isNotNull()
    keyed = with_key(versions, "lenient").where(readable).select(
        "package_id", "semver", "id", "compromised_window", "published_at", F.col("lenient").alias("key")
    )
    below = F.col("key") < F.col("bad_key")
    order = F.when(below & ~F.col("compromised_window"), F.struct("key", -F.col("id")))
    picked = bad_keyed.join(keyed, "package_id", "left").groupBy("package_id", "bad_version").agg(
        F.max_by("semver", order).alias("safe_version"),
        F.max_by("published_at", order).alias("safe_published_at"),
        F.count("key").alias("recorded"),
        F.count_if(below).alias("below"),
        F.count_if(below & F.col("compromised_window")).alias("skipped"),
        F.any_value(F.col("bad_key").isNotNull()).alias("orderable"),
    )
    found = F.col("below") > F.col("skipped")
    return picked.select(
        "package_id",
        "bad_version",
        F.when(found, F.col("safe_version")).alias("safe_version"),
        F.when(found, F.col("safe_published_at")).alias("safe_published_at"),
        F.when(~F.coalesce("orderable", F.lit(False)), "unordered")
        .when(F.col("recorded") == 0, "unrecorded")
        .when(F.col("below") == 0, "nothing_below")
        .when(~found, "all_windowed")
        .otherwise("found")
        .alias("reason"),
        "skipped",
    )


def max_satisfying(wanted: DataFrame, versions: DataFrame, scratch: Scratch) -> DataFrame:
    """Highest release of ``package_id`` inside ``constraint_`` for every distinct pair.

    Equal versions keep the lowest id; no match gives null. Each upper bound looks for the greatest
    release below it in one sweep in version order, and, where the range admits prereleases of a
    core, for the greatest of those in a second one.
    """
    asked = wanted.select("package_id", "constraint_").distinct()
    intervals = asked.join(ranges_of(asked), "constraint_").select("package_id", "constraint_", F.explode("sets").alias("s")).select(
        "package_id", "constraint_", "s.low", F.col("s.high").alias("key"), "s.admits"
    )
    keyed = with_key(versions, "strict").where("strict IS NOT NULL").select(
        "package_id", F.col("strict").alias("key"), F.struct(F.col("strict").alias("key"), (-F.col("id")).alias("id"), "semver").alias("value")
    )
    released = V.is_release(F.col("key"))
    plain = greatest_below(intervals.drop("admits"), keyed.where(released), ["package_id"], "key", "value", scratch, "best")
    early = keyed.where(~released).withColumn("core", V.same_core(F.col("key")))
    admitting = intervals.withColumn("core", F.explode(F.array_distinct("admits"))).drop("admits")
    admitted = greatest_below(admitting, early, ["package_id", "core"], "key", "value", scratch, "best").drop("core")
    best = (
        plain.unionByName(admitted).where(F.col("best")["key"] >= F.col("low"))
        .groupBy("package_id", "constraint_").agg(F.max("best")["semver"].alias("semver"))
    )
    return asked.join(best, ["package_id", "constraint_"], "left")
