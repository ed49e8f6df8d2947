"""OSV records and their effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.catalog.registry import query, sql
from faultline.functions import scores as R
from faultline.operators import advisories as A
from faultline.sources import osv as O
from faultline.sources.binding import Graph

# Record e names the package of its event and, with another range, the next package.
OSV = """
osv AS MATERIALIZED (SELECT a.id, p.name AS package, a.malicious, strftime(a.published,'%Y-%m-%dT%H:%M:%SZ') AS published, a.introduced, a.fixed, a.exact_version, a.lo_num, a.hi_num, a.package_id, a.event_id
    FROM adv a JOIN pkg p ON p.id=a.package_id
  UNION ALL SELECT a.id, p.name, a.malicious, strftime(a.published,'%Y-%m-%dT%H:%M:%SZ'), '5.0.0', NULL, NULL, 5000000, 9000000000, a.package_id+1, a.event_id
    FROM adv a JOIN pkg p ON p.id=a.package_id+1)"""


def documents(g: Graph) -> DataFrame:
    """The advisories as OSV documents, one JSON text per row."""
    own = g.package.select(F.col("id").alias("package_id"), F.col("name").alias("own"))
    following = g.package.select((F.col("id") - 1).alias("package_id"), F.col("name").alias("following"))
    text = F.lit(None).cast("string")

    def event(**given) -> Column:
        return F.struct(*[given.get(k, text).alias(k) for k in ("introduced", "fixed", "last_affected")])

    def affected(name, versions, events) -> Column:
        return F.struct(
            F.struct(name.alias("name"), F.lit("npm").alias("ecosystem")).alias("package"),
            versions.alias("versions"),
            F.array(F.struct(F.lit("SEMVER").alias("type"), events.alias("events"))).alias("ranges"),
        )

    first = event(introduced=F.col("introduced"))
    entries = F.array(
        affected(
            F.col("own"),
            F.filter(F.array("exact_version"), lambda v: v.isNotNull()),
            F.when(F.col("fixed").isNull(), F.array(first)).otherwise(F.array(first, event(fixed=F.col("fixed")))),
        ),
        affected(F.col("following"), F.array().cast("array<string>"), F.array(event(introduced=F.lit("5.0.0")))),
    )
    body = F.struct(
        "id",
        F.concat(F.lit("\n  affects "), F.col("own"), F.lit("\nmore")).alias("details"),
        F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"),
        F.filter(entries, lambda a: a["package"]["name"].isNotNull()).alias("affected"),
        F.struct(F.when(F.col("malicious"), "CRITICAL").otherwise("MODERATE").alias("severity")).alias("database_specific"),
    )
    return g.advisory.join(own, "package_id").join(following, "package_id", "left").select(F.to_json(body).alias("value"))


def corpus(g: Graph) -> str:
    """Folder of OSV JSON lines derived from the event table."""
    def write() -> str:
        path = g.scratch.path("osv")
        documents(g).write.text(path)
        return path

    return g.once("osv_corpus", write)


def parsed(g: Graph) -> DataFrame:
    return g.kept("osv_rows", lambda: O.advisories_of(O.read_records(g.spark, corpus(g))))


def targeted(g: Graph) -> DataFrame:
    """Parsed advisories with the id of the package they name."""
    return parsed(g).join(
        g.package.select(F.col("id").alias("package_id"), F.col("name").alias("package"), "ecosystem"), ["ecosystem", "package"]
    )


@query("osv_records", sql("""
SELECT o.id, o.package, 'npm' AS ecosystem, concat('affects ',q.name) AS summary, CASE WHEN o.malicious THEN 'CRITICAL' ELSE 'MODERATE' END AS severity,
o.malicious, o.published, coalesce(o.exact_version,'') AS versions FROM osv o JOIN adv a ON a.event_id=o.event_id JOIN pkg q ON q.id=a.package_id""", OSV))
def osv_records(g: Graph) -> DataFrame:
    return parsed(g).select(
        "id", "package", "ecosystem", "summary", "severity", "malicious", "published", F.array_join("affected_versions", ",").alias("versions")
    )


@query("osv_pairs", sql("SELECT id, package, introduced, fixed FROM osv", OSV))
def osv_pairs(g: Graph) -> DataFrame:
    return parsed(g).select("id", "package", F.explode("ranges").alias("r")).select("id", "package", "r.introduced", "r.fixed")


@query("advisories_by_package", sql("""
SELECT DISTINCT concat('npm:',p.name) AS key, o.id AS advisory_id FROM pkg p LEFT JOIN osv o ON o.package=p.name""", OSV))
def advisories_by_package(g: Graph) -> DataFrame:
    return A.lookup(g.package, parsed(g))


@query("advisories_first_seen", sql("""
SELECT id, min(package) AS package, arg_min(introduced,package) AS introduced FROM osv GROUP BY 1""", OSV))
def advisories_first_seen(g: Graph) -> DataFrame:
    """Packages are asked in name order."""
    asked = g.package.select("ecosystem", "name", F.struct("ecosystem", "name").alias("position"))
    return A.first_seen(asked, parsed(g)).select("id", "package", F.col("ranges")[0]["introduced"].alias("introduced"))


MATCH = """
hit AS MATERIALIZED (SELECT DISTINCT v.id, v.package_id, v.semver, v.compromised_window FROM ver v JOIN osv o ON o.package_id=v.package_id
  AND (v.semver=o.exact_version OR (v.num>=o.lo_num AND v.num<o.hi_num)))"""


@query("advisory_match", sql("SELECT id, package_id, semver FROM hit", OSV, MATCH))
def advisory_match(g: Graph) -> DataFrame:
    return A.affected_versions(g.version, targeted(g), g.scratch).select("id", "package_id", "semver")


def applied(g: Graph) -> A.Applied:
    """All advisories applied to packages nothing is known about yet."""
    fresh = g.package.select("id", F.lit(False).alias("is_compromised"), F.lit(R.RISK_DEFAULT).alias("risk_score"))
    none = g.spark.createDataFrame([], "package_id bigint, advisory_id string")
    return A.apply_advisories(fresh, none, g.version, targeted(g), g.scratch)


STATUS = """
stat AS MATERIALIZED (SELECT package_id AS id, count(DISTINCT osv.id) AS new_ids, bool_or(malicious) AS is_compromised FROM osv GROUP BY 1)"""


@query("apply_advisories", sql("""
SELECT s.id, CASE WHEN is_compromised THEN 1.0::DOUBLE ELSE round(least(0.9::DOUBLE,0.05::DOUBLE+0.15::DOUBLE*new_ids),4) END AS risk_score, is_compromised,
is_compromised AS newly_flagged, new_ids, coalesce(m.n,0) AS malicious_releases, coalesce(w.n,0) AS windows_raised
FROM stat s LEFT JOIN (SELECT package_id, count(DISTINCT exact_version) AS n FROM osv GROUP BY 1) m ON m.package_id=s.id
LEFT JOIN (SELECT package_id, count(*) AS n FROM hit WHERE NOT compromised_window GROUP BY 1) w ON w.package_id=s.id""", OSV, MATCH, STATUS))
def apply_advisories(g: Graph) -> DataFrame:
    done = applied(g)
    raised = g.version.join(done.windowed, "id", "left_semi").groupBy(F.col("package_id").alias("id")).agg(F.count(F.lit(1)).alias("windows_raised"))
    named = done.malicious_releases.groupBy(F.col("package_id").alias("id")).agg(F.count("semver").alias("malicious_releases"))
    return done.packages.join(named, "id", "left").join(raised, "id", "left").fillna(0, ["malicious_releases", "windows_raised"])


@query("threat_delta", sql("""
SELECT 'compromised' AS metric, CAST(0 AS BIGINT) AS before, count(*) FILTER (is_compromised) AS after, count(*) FILTER (is_compromised) AS delta FROM stat
UNION ALL SELECT 'windowed', (SELECT count(*) FROM ver WHERE compromised_window), (SELECT count(*) FROM ver WHERE compromised_window)+count(*) FILTER (NOT compromised_window),
count(*) FILTER (NOT compromised_window) FROM hit""", OSV, MATCH, STATUS))
def threat_delta(g: Graph) -> DataFrame:
    """Flagged packages and windowed versions before and after the advisories."""
    done = applied(g)
    fresh = g.package.withColumn("is_compromised", F.lit(False))
    packages, versions = A.threat_counts(fresh, g.version)
    after_packages = done.packages.agg(F.count_if("newly_flagged").alias("d"))
    after_versions = done.windowed.agg(F.count(F.lit(1)).alias("d"))

    def row(metric: str, before: DataFrame, change: DataFrame) -> DataFrame:
        return before.select(F.lit(metric).alias("metric"), F.col("n").alias("before"), change.scalar().alias("delta")).select(
            "metric", "before", (F.col("before") + F.col("delta")).alias("after"), "delta"
        )

    return row("compromised", packages, after_packages).unionByName(row("windowed", versions, after_versions))


@query("breach_target", sql("""
SELECT s.id, p.name, 1.0::DOUBLE AS risk_score FROM stat s JOIN pkg p ON p.id=s.id WHERE is_compromised ORDER BY p.downloads_weekly DESC, s.id LIMIT 1""", OSV, STATUS))
def breach_target(g: Graph) -> DataFrame:
    """The flagged package with the highest risk, then most downloads."""
    return applied(g).packages.where("is_compromised").join(g.package.select("id", "name", "downloads_weekly"), "id").orderBy(
        F.desc("risk_score"), F.desc_nulls_last("downloads_weekly"), "id"
    ).limit(1).select("id", "name", "risk_score")
