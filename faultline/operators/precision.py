"""Version-exact refinement of the closure, for all roots at once.

A direct dependent transmits unless every edge it has into the root carries a
valid range that excludes the bad version. Lockfiles whose pins of the root are
all outside the window are never entered. Everything fails open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import schema as X
from faultline.functions import scores as R
from faultline.functions import semver as V
from faultline.operators.closure import reach
from faultline.operators.skew import SplitEdges
from faultline.operators.versions import keys_of, ranges_of
from faultline.session import Scratch


def hop1_gate(depends_on: DataFrame, incidents: DataFrame) -> DataFrame:
    """(root, node, gated, constraint_) for every direct dependent of a root.

    ``incidents`` has (root, bad_version); constraint_ is the first excluding range.
    """
    hop = incidents.select("root", "bad_version").join(
        depends_on.select(F.col("dst").alias("root"), F.col("src").alias("node"), "constraint_"), "root"
    ).where("node <> root")
    # one evaluation per distinct (version, constraint)
    pairs = hop.select("bad_version", "constraint_").distinct()
    verdict = (
        pairs.join(keys_of(pairs, "bad_version"), "bad_version", "left")
        .join(ranges_of(pairs), "constraint_", "left")
        .select(
            "bad_version",
            "constraint_",
            (
                F.col("key").isNotNull()
                & V.range_is_evidence(F.col("constraint_"), F.col("sets"))
                & ~V.satisfies(F.col("key"), F.col("sets"))
            ).alias("excludes"),
        )
    )
    return (
        hop.join(verdict, ["bad_version", "constraint_"], "left")
        .groupBy("root", "node")
        .agg(
            F.bool_and(F.coalesce("excludes", F.lit(False))).alias("gated"),
            F.min(F.when(F.col("excludes"), F.col("constraint_"))).alias("constraint_"),
        )
        .withColumn("constraint_", F.when(F.col("gated"), F.col("constraint_")))
    )


def lockfile_pins(resolved_in: DataFrame, versions: DataFrame, incidents: DataFrame, ids: X.IdSpace) -> DataFrame:
    """(root, node, version_id, semver, windowed): lockfile pins of each root's releases.

    The bad version counts as windowed whatever its flag; the package's own
    history edges are not pins. Releases are looked up here only where the edges do not carry
    their package, number and flag.
    """
    pins = resolved_in.where(ids.is_label(F.col("src"), X.LOCKFILE))
    if "package_id" not in pins.columns:
        # pins find their release first: the releases, by far the longest table, move once
        pins = pins.select("src", "dst").join(versions.select("package_id", F.col("id").alias("dst"), "semver", "compromised_window"), "dst")
    return (
        pins.withColumnRenamed("package_id", "root")
        .join(incidents.select("root", "bad_version"), "root")
        .select(
            "root",
            F.col("src").alias("node"),
            F.col("dst").alias("version_id"),
            "semver",
            F.coalesce(F.col("compromised_window") | (F.col("semver") == F.col("bad_version")), F.lit(False)).alias("windowed"),
        )
    )


def clean_lockfiles(pins: DataFrame) -> DataFrame:
    """(root, node) of lockfiles with pins and no windowed one."""
    return pins.groupBy("root", "node").agg(F.bool_or("windowed").alias("_w")).where("NOT _w").select("root", "node")


def remaining(
    edges: SplitEdges,
    roots: DataFrame,
    incidents: DataFrame,
    gate: DataFrame,
    clean: DataFrame,
    depth: int,
    scratch: Scratch,
) -> DataFrame:
    """(root, node) still exposed after pruning, without the closure they are left of.

    Roots whose bad version is missing or unparseable keep everything.
    """
    orderable = _orderable(incidents)
    gated, shut = (df.select("root", "node").join(orderable, "root", "left_semi") for df in (gate.where("gated"), clean))
    found = reach(edges, roots, depth, scratch, first_hop_blocked=gated, blocked=shut).select("root", "node")
    # a node without an id is kept where everything is
    return found.where("node IS NOT NULL").unionByName(found.where("node IS NULL").join(orderable, "root", "left_anti"))


def _orderable(incidents: DataFrame) -> DataFrame:
    return incidents.join(keys_of(incidents, "bad_version"), "bad_version").where("key IS NOT NULL").select("root")


def mark(closure: DataFrame, exposed: DataFrame, incidents: DataFrame) -> DataFrame:
    """The closure (root, node, depth) with ``kept``: among the ``exposed`` (root, node), or of a root that keeps everything."""
    reached = exposed.where("node IS NOT NULL").select("root", "node", F.lit(True).alias("_reached"))
    exact = _orderable(incidents).distinct().withColumn("_exact", F.lit(True))
    return (
        closure.join(reached, ["root", "node"], "left")
        .join(exact, "root", "left")
        .select("root", "node", "depth", (F.col("_reached").isNotNull() | F.col("_exact").isNull()).alias("kept"))
    )


def refine(
    edges: SplitEdges,
    closure: DataFrame,
    incidents: DataFrame,
    gate: DataFrame,
    clean: DataFrame,
    depth: int,
    scratch: Scratch,
) -> DataFrame:
    """The closure (root, node, depth) with ``kept``: still exposed after pruning."""
    return mark(closure, remaining(edges, closure.select("root"), incidents, gate, clean, depth, scratch), incidents)


def blast_radius(exposed: DataFrame, roots: DataFrame, services: DataFrame, fleet: DataFrame, ids: X.IdSpace) -> DataFrame:
    """Exposure of the fleet per root from its exposed (root, node) rows."""
    tiers = services.select(F.col("id").alias("node"), X.is_tier1(F.col("criticality")).alias("_tier1"))
    node = F.col("node")
    counted = exposed.join(tiers, "node", "left").groupBy("root").agg(
        F.count_if(ids.is_label(node, X.PACKAGE)).alias("exposed_packages"),
        F.count_if(ids.is_label(node, X.SERVICE)).alias("exposed_services"),
        F.count_if(ids.is_label(node, X.LOCKFILE)).alias("exposed_lockfiles"),
        F.count_if(F.coalesce("_tier1", F.lit(False))).alias("tier1_exposed"),
    )
    counts = ["exposed_packages", "exposed_services", "exposed_lockfiles", "tier1_exposed"]
    return (
        roots.select("root")
        .join(counted, "root", "left")
        .fillna(0, counts)
        .withColumn("total_services", fleet.select("total_services").scalar())
        .withColumn("total_lockfiles", fleet.select("total_lockfiles").scalar())
        .withColumn("percentage", R.share_percent(F.col("exposed_services"), F.col("total_services")))
    )
