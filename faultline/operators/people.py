"""Maintainer networks and look-alike reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.ordering import rank_within
from faultline.operators.versions import first_windowed
from faultline.session import Scratch


def primary_maintainer(maintained_by: DataFrame) -> DataFrame:
    return maintained_by.groupBy(F.col("src").alias("package_id")).agg(F.min("dst").alias("maintainer_id"))


def maintained_packages(maintained_by: DataFrame, maintains: DataFrame | None = None) -> DataFrame:
    """(maintainer_id, package_id, since) from either edge direction."""
    owned = maintained_by.select(F.col("dst").alias("maintainer_id"), F.col("src").alias("package_id"), "since")
    if maintains is not None:
        owned = owned.unionByName(
            maintains.select(
                F.col("src").alias("maintainer_id"), F.col("dst").alias("package_id"), F.lit(None).cast("timestamp_ntz").alias("since")
            )
        )
    return owned.groupBy("maintainer_id", "package_id").agg(F.min("since").alias("since"))


def maintained_state(owned: DataFrame, packages: DataFrame, versions: DataFrame) -> DataFrame:
    """Every package of every maintainer with its flags and first windowed release."""
    earliest = first_windowed(versions).select("package_id", F.col("semver").alias("window_release"), "published_at")
    return (
        owned.join(packages.select(F.col("id").alias("package_id"), "name", "is_compromised"), "package_id")
        .join(earliest, "package_id", "left")
        .withColumn("in_window", F.col("window_release").isNotNull())
        .withColumn("flagged", F.col("in_window") | F.coalesce("is_compromised", F.lit(False)))
    )


def network(owned: DataFrame, packages: DataFrame, versions: DataFrame) -> DataFrame:
    """Every package of every maintainer, the breached one included."""
    return maintained_state(owned, packages, versions).select(
        "maintainer_id", "package_id", "name", "in_window", "flagged", "published_at", F.col("since").alias("maintained_since")
    )


def _sole_compromised(state: DataFrame) -> DataFrame:
    """(maintainer_id, _sole) of maintainers with exactly one compromised package."""
    return state.where("is_compromised").groupBy("maintainer_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("package_id").alias("_sole")
    ).where("_n = 1").select("maintainer_id", "_sole")


def _centres(state: DataFrame, epicentre: DataFrame) -> DataFrame:
    """(root, maintainer_id, centre): the package left out of each report.

    A named package the maintainer does not own falls back to the maintainer's only
    compromised package.
    """
    owns = state.select("maintainer_id", F.col("package_id").alias("root"), F.lit(True).alias("_owns"))
    return (
        epicentre.select("root", "maintainer_id")
        .join(owns, ["maintainer_id", "root"], "left")
        .join(_sole_compromised(state), "maintainer_id", "left")
        .select("root", "maintainer_id", F.when(F.col("_owns"), F.col("root")).otherwise(F.col("_sole")).alias("centre"))
    )


def sisters(owned: DataFrame, packages: DataFrame, versions: DataFrame, epicentre: DataFrame | None = None) -> DataFrame:
    """Packages sharing a maintainer, without the epicentre.

    Without ``epicentre`` there is one report per maintainer. With it, (root,
    maintainer_id) rows name the breached package of each report; that form lists
    every sister of every root and is meant for the incidents at hand. For all roots
    at once use :func:`sister_summary`.
    """
    state = maintained_state(owned, packages, versions)
    if epicentre is None:
        out = state.join(_sole_compromised(state), "maintainer_id", "left").where(
            F.col("_sole").isNull() | (F.col("package_id") != F.col("_sole"))
        )
        group = ["maintainer_id"]
    else:
        out = _centres(state, epicentre).join(state, "maintainer_id").where(
            F.col("centre").isNull() | (F.col("package_id") != F.col("centre"))
        )
        group = ["root", "maintainer_id"]
    return out.select(*group, "package_id", "name", "in_window", "flagged", "window_release", "published_at")


def sister_summary(owned: DataFrame, packages: DataFrame, versions: DataFrame, epicentre: DataFrame) -> DataFrame:
    """Sister counts and the first sister release in the window, per root.

    Counts are taken once per maintainer and the epicentre's own share subtracted, and
    the two earliest releases suffice to find the first that is not the epicentre's,
    so a maintainer of very many packages never yields root x sister pairs.
    """
    state = maintained_state(owned, packages, versions)
    counts = state.groupBy("maintainer_id").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if("flagged").alias("_flagged"), F.count_if("in_window").alias("_window")
    )
    early = Window.partitionBy("maintainer_id").orderBy("published_at", "package_id")
    first_two = (
        state.where("in_window")
        .withColumn("_n", F.row_number().over(early))
        .where("_n <= 2")
        .groupBy("maintainer_id")
        .agg(F.array_sort(F.collect_list(F.struct("published_at", "package_id", "name", "window_release"))).alias("_first"))
    )
    own = state.select("maintainer_id", F.col("package_id").alias("centre"), F.col("flagged").alias("_own_flag"), F.col("in_window").alias("_own_window"), F.lit(1).alias("_own"))
    first = F.try_element_at(
        F.filter("_first", lambda r: F.col("centre").isNull() | (r["package_id"] != F.col("centre"))), F.lit(1)
    )

    def less(total: str, mine: str) -> Column:
        return F.col(total) - F.coalesce(F.col(mine).cast("int"), F.lit(0))

    return (
        _centres(state, epicentre)
        .join(counts, "maintainer_id")
        .join(first_two, "maintainer_id", "left")
        .join(own, ["maintainer_id", "centre"], "left")
        .select(
            "root", "maintainer_id",
            less("_all", "_own").alias("sisters"),
            less("_flagged", "_own_flag").alias("flagged"),
            less("_window", "_own_window").alias("in_window"),
            first["published_at"].alias("first_at"),
            F.concat_ws("@", first["name"], first["window_release"]).alias("first_release"),
        )
    )


def rank_sisters(found: DataFrame, group: list[str], scratch: Scratch) -> DataFrame:
    """Flagged packages first, then by name."""
    return rank_within(found, group, [F.desc("flagged"), F.asc("name"), F.asc("package_id")], scratch)


def look_alike_report(typosquat_of: DataFrame, packages: DataFrame) -> DataFrame:
    """Candidates per package from edges of both directions, incoming edges first."""
    def side(package: str, candidate: str, order: int) -> DataFrame:
        return typosquat_of.where("src <> dst").select(
            F.col(package).alias("package_id"),
            F.col(candidate).alias("candidate_id"),
            F.struct(F.lit(order).alias("o"), "similarity_score", "edit_distance").alias("e"),
        )

    first = side("dst", "src", 0).unionByName(side("src", "dst", 1)).groupBy("package_id", "candidate_id").agg(
        F.min("e").alias("e")
    )
    return first.join(
        packages.select(F.col("id").alias("candidate_id"), "name", "last_published_at"), "candidate_id"
    ).select(
        "package_id", "candidate_id", "name", F.col("e.similarity_score").alias("similarity_score"),
        F.col("e.edit_distance").alias("edit_distance"), "last_published_at",
    )


def rank_look_alikes(report: DataFrame, scratch: Scratch) -> DataFrame:
    order = [
        F.desc(F.coalesce("similarity_score", F.lit(0.0))),
        F.asc(F.coalesce("edit_distance", F.lit(99))),
        F.asc("name"),
        F.asc("candidate_id"),
    ]
    return rank_within(report, ["package_id"], order, scratch)
