"""Risk profile, timeline and the one-row incident report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import scores as R
from faultline.operators.ordering import rank_within
from faultline.session import Scratch


def risk_profile(roots: DataFrame, exposed: DataFrame, incidents: DataFrame, sisters: DataFrame, look_alikes: DataFrame) -> DataFrame:
    """Composite score per root with its components.

    ``exposed`` (root, node) is the refined closure, ``incidents`` has (root,
    windowed), ``sisters`` (root, flagged, sisters) counts, ``look_alikes``
    (package_id, similarity_score).
    """
    dependents = exposed.groupBy("root").agg(F.count("node").alias("dependents"))
    family = sisters.select("root", "flagged", "sisters")
    copies = look_alikes.groupBy(F.col("package_id").alias("root")).agg(
        F.max("similarity_score").alias("similarity"), F.count(F.lit(1)).alias("look_alikes")
    )
    joined = (
        roots.select("root")
        .join(incidents.select("root", "windowed"), "root", "left")
        .join(dependents, "root", "left")
        .join(family, "root", "left")
        .join(copies, "root", "left")
        .fillna(0, ["dependents", "flagged", "sisters", "look_alikes"])
        .withColumn("reach", R.reach_component(F.col("dependents")))
        .withColumn("window", F.when(F.col("windowed"), 1.0).otherwise(0.0))
        .withColumn("maintainer", R.maintainer_component(F.col("flagged"), F.col("sisters")))
        .withColumn("typosquat", R.typosquat_component(F.col("similarity"), F.col("look_alikes")))
    )
    parts = [F.col(c) for c in ("reach", "window", "maintainer", "typosquat")]
    scored = joined.withColumn("score", R.composite(*parts))
    return scored.select(
        "root", "dependents", "flagged", "sisters", "look_alikes",
        *[F.round(c, 4).alias(n) for c, n in zip(parts, ("reach", "window", "maintainer", "typosquat"))],
        "score", R.band(F.col("score")).alias("band"),
    )


def sister_events(state: DataFrame) -> DataFrame:
    """(maintainer_id, package_id, at, event): one row for each windowed package of each maintainer.

    Stored once per maintainer: the timeline of a root refers to its maintainer, and the events of
    the root are these rows without the root's own.
    """
    return state.where("in_window").select(
        "maintainer_id", "package_id", F.col("published_at").alias("at"),
        F.concat(F.lit("sister release "), F.col("name"), F.lit("@"), F.col("window_release")).alias("event"),
    )


def sister_reference(summary: DataFrame) -> DataFrame:
    """(root, at, event, refers_to, stands_for): one timeline row per root for all its rows of :func:`sister_events`."""
    return summary.where("in_window > 0").select(
        "root", F.col("first_at").alias("at"),
        F.concat(F.col("in_window").cast("string"), F.lit(" sister releases inside the window, first "), F.col("first_release")).alias("event"),
        F.col("maintainer_id").alias("refers_to"), F.col("in_window").alias("stands_for"),
    )


def timeline(
    roots: DataFrame,
    packages: DataFrame,
    versions: DataFrame,
    incidents: DataFrame,
    safe: DataFrame,
    sisters: DataFrame,
    look_alikes: DataFrame,
    radius: DataFrame,
    detected_at: Column,
    scratch: Scratch,
) -> DataFrame:
    """Ordered incident events (root, rank, at, kind, severity, event, refers_to, stands_for) for every root.

    ``sisters`` comes from :func:`sister_reference`. ``refers_to`` names the maintainer whose
    :func:`sister_events` a row stands for, and ``stands_for`` is the number of events: 1 for all other rows.
    """
    name = packages.select(F.col("id").alias("root"), F.col("name").alias("package"))
    releases = versions.where("compromised_window").select(F.col("package_id").alias("root"), "semver", "published_at").join(
        incidents.select("root", "bad_version"), "root"
    )
    spec = F.concat_ws("@", "package", "semver")

    def events(df: DataFrame, at: Column, kind: str, severity: str, text: Column, refers_to: Column | None = None, stands_for: Column | None = None) -> DataFrame:
        return df.select(
            "root", at.alias("at"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), text.alias("event"),
            (F.lit(None) if refers_to is None else refers_to).cast("bigint").alias("refers_to"),
            (F.lit(1) if stands_for is None else stands_for).cast("bigint").alias("stands_for"),
        )

    known_good = events(
        safe.where("safe_published_at IS NOT NULL").join(name, "root"), F.col("safe_published_at"), "release", "info",
        F.concat(F.col("package"), F.lit("@"), F.col("safe_version"), F.lit(": last release outside the window")),
    )
    opened = (
        releases.select("root", "published_at")
        .unionByName(sisters.select("root", F.col("at").alias("published_at")))
        .groupBy("root")
        .agg(F.min("published_at").alias("first"))
    )
    credential = events(
        opened, F.col("first") - F.expr("INTERVAL 1 MINUTE"), "credential", "warning",
        F.lit("compromise window opens: publish credentials used"),
    )
    published = events(
        incidents.where("published_at IS NOT NULL").withColumnRenamed("bad_version", "semver").join(name, "root"),
        F.col("published_at"), "publish", "critical", F.concat(F.lit("malicious release "), spec),
    )
    later = events(
        releases.where("semver <> bad_version").join(name, "root"), F.col("published_at"), "publish", "high",
        F.concat(spec, F.lit(": also published inside the window")),
    )
    sister = events(sisters, F.col("at"), "sister", "high", F.col("event"), F.col("refers_to"), F.col("stands_for"))
    look_alike = events(
        look_alikes.where("last_published_at IS NOT NULL").withColumnRenamed("package_id", "root").join(
            roots.select("root"), "root", "left_semi"
        ),
        F.col("last_published_at"), "typosquat", "warning",
        F.concat(F.lit("look-alike "), F.col("name"), F.lit(", edit distance "), F.col("edit_distance").cast("string")),
    )
    detection = events(
        radius, detected_at, "detection", "critical",
        F.concat_ws(
            " ",
            F.lit("exposed:"),
            F.col("exposed_packages").cast("string"), F.lit("packages,"),
            F.concat_ws("/", F.col("exposed_lockfiles").cast("string"), F.col("total_lockfiles").cast("string")), F.lit("lockfiles,"),
            F.concat_ws("/", F.col("exposed_services").cast("string"), F.col("total_services").cast("string")), F.lit("services,"),
            F.col("tier1_exposed").cast("string"), F.lit("tier-1"),
        ),
    )
    all_events = known_good
    for part in (credential, published, later, sister, look_alike, detection):
        all_events = all_events.unionByName(part)
    order = [
        F.asc(F.col("kind") == "detection"),
        F.asc_nulls_first("at"),
        F.asc(R.severity_rank(F.col("severity"))),
        F.asc("kind"),
        F.asc("event"),
    ]
    return rank_within(all_events, ["root"], order, scratch)


def incident_report(
    summary: DataFrame, safe: DataFrame, risk: DataFrame, events: DataFrame, primary: DataFrame
) -> DataFrame:
    """One row per root: exposure before and after refinement, safe version, risk."""
    counted = events.groupBy("root").agg(F.sum("stands_for").alias("events"))
    return (
        summary.join(safe.select("root", "safe_version", "reason"), "root", "left")
        .join(risk.select("root", "score", "band", "flagged", "sisters", "look_alikes"), "root", "left")
        .join(counted, "root", "left")
        .join(primary.select(F.col("package_id").alias("root"), "maintainer_id"), "root", "left")
        .withColumn("severity", R.exposure_severity(F.col("percentage"), F.col("tier1_exposed")))
    )
