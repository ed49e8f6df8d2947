"""Maintainers and look-alike names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.catalog.registry import query, sql
from faultline.functions import names as N
from faultline.operators import people as H
from faultline.operators import scans as S
from faultline.operators.scans import INSTANT
from faultline.operators.typosquat import typosquat_edges
from faultline import schema as X
from faultline.sources.binding import Graph

STATE = """
state AS MATERIALIZED (SELECT m.dst AS maintainer_id, m.src AS package_id, p.name, m.since, f.semver AS window_release, f.published_at,
  f.package_id IS NOT NULL AS in_window, p.id IN (SELECT package_id FROM mal) AS is_compromised,
  f.package_id IS NOT NULL OR p.id IN (SELECT package_id FROM mal) AS flagged
  FROM mnt m JOIN pkg p ON p.id=m.src LEFT JOIN fstw f ON f.package_id=p.id),
sole AS (SELECT maintainer_id, min(package_id) AS sole FROM state WHERE is_compromised GROUP BY 1 HAVING count(*)=1)"""


@query("package_maintainers", sql("SELECT DISTINCT m.src AS package_id, m.dst AS maintainer_id, t.name FROM mnt m JOIN mtn t ON t.id=m.dst"))
def package_maintainers(g: Graph) -> DataFrame:
    return g.maintained_by.select(F.col("src").alias("package_id"), F.col("dst").alias("maintainer_id")).distinct().join(
        g.maintainer.select(F.col("id").alias("maintainer_id"), "name"), "maintainer_id"
    ).select("package_id", "maintainer_id", "name")


@query("primary_maintainer", sql("SELECT src AS package_id, min(dst) AS maintainer_id FROM mnt GROUP BY 1"))
def primary_maintainer(g: Graph) -> DataFrame:
    return H.primary_maintainer(g.maintained_by)


def owned(g: Graph) -> DataFrame:
    return H.maintained_packages(g.maintained_by, S.inverse(g.maintained_by, X.MAINTAINS))


@query("maintainer_network", sql("""
SELECT maintainer_id, package_id, name, in_window, flagged, strftime(published_at,'%Y-%m-%dT%H:%M:%S.%f') AS published_at,
strftime(since,'%Y-%m-%dT%H:%M:%S.%f') AS maintained_since FROM state""", STATE))
def maintainer_network(g: Graph) -> DataFrame:
    found = H.network(owned(g), g.package, g.version)
    return found.select(
        "maintainer_id", "package_id", "name", "in_window", "flagged",
        F.date_format("published_at", INSTANT).alias("published_at"),
        F.date_format("maintained_since", INSTANT).alias("maintained_since"),
    )


@query("maintainer_risk", sql("""
SELECT maintainer_id, package_id, name, in_window, flagged, window_release, strftime(published_at,'%Y-%m-%dT%H:%M:%S.%f') AS published_at,
count(*) FILTER (flagged) OVER (PARTITION BY maintainer_id) AS flagged_count,
row_number() OVER (PARTITION BY maintainer_id ORDER BY flagged DESC, name, package_id) AS rank
FROM state LEFT JOIN sole USING (maintainer_id) WHERE sole IS NULL OR package_id<>sole""", STATE))
def maintainer_risk(g: Graph) -> DataFrame:
    found = H.sisters(owned(g), g.package, g.version)
    ranked = H.rank_sisters(found, ["maintainer_id"], g.scratch)
    flagged = found.groupBy("maintainer_id").agg(F.count_if("flagged").alias("flagged_count"))
    return ranked.join(flagged, "maintainer_id").select(
        "maintainer_id", "package_id", "name", "in_window", "flagged", "window_release",
        F.date_format("published_at", INSTANT).alias("published_at"), "flagged_count", "rank",
    )


@query("maintained_since", sql("SELECT package_id, strftime(min(published_at),'%Y-%m-%dT%H:%M:%S.%f') AS since FROM ver GROUP BY 1"))
def maintained_since(g: Graph) -> DataFrame:
    return g.version.groupBy("package_id").agg(F.date_format(F.min("published_at"), INSTANT).alias("since"))


@query("homoglyph_fold", sql("SELECT id, name, f AS folded, nullif(regexp_extract(name,'^(@[^/]*)/',1),'') AS scope FROM fold"))
def homoglyph_fold(g: Graph) -> DataFrame:
    return g.package.select("id", "name", N.fold(F.col("name")).alias("folded"), N.scope(F.col("name")).alias("scope"))


@query("typosquat_pairs", sql("SELECT src, dst, edit_distance, similarity_score FROM squat"))
def typosquat_pairs(g: Graph) -> DataFrame:
    return typosquat_edges(g.package.select("id", "name", "downloads_weekly"))


@query("typosquat_rank", sql("""
SELECT package_id, candidate_id, name, similarity_score, edit_distance, row_number() OVER (PARTITION BY package_id
 ORDER BY similarity_score DESC, edit_distance, name, candidate_id) AS rank FROM look""", """
look AS (SELECT package_id, candidate_id, p.name, similarity_score, edit_distance FROM (
  SELECT dst AS package_id, src AS candidate_id, similarity_score, edit_distance FROM squat
  UNION ALL SELECT src, dst, similarity_score, edit_distance FROM squat s WHERE NOT EXISTS (SELECT 1 FROM squat t WHERE t.src=s.dst AND t.dst=s.src)) x
  JOIN pkg p ON p.id=x.candidate_id)"""))
def typosquat_rank(g: Graph) -> DataFrame:
    return H.rank_look_alikes(H.look_alike_report(g.typosquat_of, g.package), g.scratch).drop("last_published_at")
