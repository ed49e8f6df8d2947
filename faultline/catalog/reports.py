"""Scores, timelines, reports, remediation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import schema as X
from faultline.catalog.advisories import OSV, STATUS, applied
from faultline.catalog.graph import instants_as_text
from faultline.catalog.people import STATE, owned
from faultline.catalog.precision import REFINED, kept, precision_summary, refined_radius, root_pins
from faultline.catalog.registry import query, sql
from faultline.catalog.versions import SAFE, incidents
from faultline.functions import scores as R
from faultline.operators import people as H
from faultline.operators import remediation as M
from faultline.operators import versions as N
from faultline.plans import incident as I
from faultline.sources.binding import Graph

DETECTED = "2002-01-01 00:00:00"

SIGNALS = """
prim AS (SELECT src AS root, min(dst) AS maintainer_id FROM mnt WHERE src IN (SELECT root FROM roots) GROUP BY 1),
sis AS MATERIALIZED (SELECT p.root, s.* FROM prim p JOIN state s ON s.maintainer_id=p.maintainer_id AND s.package_id<>p.root),
sig AS (SELECT r.root, coalesce(b.windowed,false) AS windowed, rb.exposed_nodes AS dependents,
  (SELECT count(*) FROM sis WHERE sis.root=r.root AND flagged) AS flagged, (SELECT count(*) FROM sis WHERE sis.root=r.root) AS sisters,
  (SELECT count(*) FROM squat q WHERE q.dst=r.root OR q.src=r.root) AS look_alikes,
  coalesce((SELECT max(similarity_score) FROM squat q WHERE q.dst=r.root OR q.src=r.root),0.0) AS sim
  FROM roots r LEFT JOIN bad b ON b.package_id=r.root LEFT JOIN rblast rb ON rb.root=r.root),
cmp AS (SELECT *, least(1.0::DOUBLE, log10(1.0::DOUBLE+dependents)/log10(61.0::DOUBLE)) AS reach,
  CASE WHEN windowed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS window_,
  CASE WHEN flagged>0 THEN least(1.0::DOUBLE, 0.5::DOUBLE+0.5::DOUBLE*flagged/sisters) ELSE 0.0::DOUBLE END AS maintainer,
  CASE WHEN look_alikes>1 THEN least(1.0::DOUBLE, sim+least(0.05::DOUBLE,0.01::DOUBLE*(look_alikes-1))) ELSE sim END AS typosquat FROM sig),
risk AS MATERIALIZED (SELECT *, round(least(1.0::DOUBLE,0.4::DOUBLE*reach+0.25::DOUBLE*window_+0.2::DOUBLE*maintainer+0.15::DOUBLE*typosquat),4) AS score FROM cmp)"""


def incident_sisters(g: Graph) -> DataFrame:
    def build() -> DataFrame:
        primary = H.primary_maintainer(g.maintained_by).withColumnRenamed("package_id", "root").join(g.roots, "root", "left_semi")
        return H.sister_summary(owned(g), g.package, g.version, primary)

    return g.kept("incident_sisters", build)


def look_alikes(g: Graph) -> DataFrame:
    return g.kept("look_alikes", lambda: H.look_alike_report(g.typosquat_of, g.package))


@query("incident_sisters", sql("""
SELECT p.root, p.maintainer_id, count(s.package_id) AS sisters, count(s.package_id) FILTER (s.flagged) AS flagged, count(s.package_id) FILTER (s.in_window) AS in_window,
coalesce(arg_min(concat(s.name,'@',s.window_release),(s.published_at,s.package_id)) FILTER (s.in_window),'') AS first_release FROM prim p LEFT JOIN sis s ON s.root=p.root GROUP BY 1,2""", STATE, SIGNALS))
def incident_sisters_(g: Graph) -> DataFrame:
    return incident_sisters(g).drop("first_at")


def safe_for_roots(g: Graph) -> DataFrame:
    return g.kept("safe_roots", lambda: N.safe_version(
        incidents(g).withColumnRenamed("root", "package_id"), g.root_version).withColumnRenamed("package_id", "root"))


def risk(g: Graph) -> DataFrame:
    return g.kept("risk", lambda: I.risk_profile(g.roots, kept(g), incidents(g), incident_sisters(g), look_alikes(g)))


@query("risk_profile", sql("""
SELECT root, dependents, flagged, sisters, look_alikes, round(reach,4) AS reach, window_ AS "window", round(maintainer,4) AS maintainer,
round(typosquat,4) AS typosquat, score, CASE WHEN score>=0.75 THEN 'critical' WHEN score>=0.5 THEN 'high' WHEN score>=0.25 THEN 'moderate' ELSE 'low' END AS band
FROM risk""", STATE, SIGNALS))
def risk_profile(g: Graph) -> DataFrame:
    return risk(g)


SEVERITY = """CASE WHEN percentage<=0 THEN 'CONTAINED' WHEN tier1_exposed>0 AND percentage>=25 THEN 'CRITICAL' WHEN percentage>=60 THEN 'CRITICAL'
 WHEN percentage>=25 THEN 'SEVERE' WHEN percentage>=10 THEN 'ELEVATED' ELSE 'LIMITED' END"""


@query("severity", sql(f"SELECT root, percentage, tier1_exposed, {SEVERITY} AS severity FROM refd", f"refd AS ({REFINED})"))
def severity(g: Graph) -> DataFrame:
    return refined_radius(g).select(
        "root", "percentage", "tier1_exposed",
        R.exposure_severity(F.col("percentage"), F.col("tier1_exposed")).alias("severity"),
    )


EVENTS = f"""
ev AS (SELECT *, CASE WHEN kind='sister' THEN (SELECT maintainer_id FROM prim WHERE prim.root=e0.root) END AS refers_to,
  CASE WHEN kind='sister' THEN (SELECT count(*) FROM sis WHERE sis.root=e0.root AND in_window) ELSE 1 END AS stands_for FROM (
  SELECT s.package_id AS root, s.safe_published_at AS "at", 'release' AS kind, 'info' AS severity, concat(p.name,'@',s.safe_version,': last release outside the window') AS event
    FROM safe s JOIN roots r ON r.root=s.package_id JOIN pkg p ON p.id=s.package_id WHERE s.safe_published_at IS NOT NULL
  UNION ALL SELECT root, min(published_at)-INTERVAL 1 MINUTE, 'credential','warning','compromise window opens: publish credentials used' FROM
    (SELECT package_id AS root, published_at FROM ver WHERE compromised_window UNION ALL SELECT root, published_at FROM sis WHERE in_window) GROUP BY 1
  UNION ALL SELECT b.package_id, b.published_at, 'publish','critical', concat('malicious release ',p.name,'@',b.bad_version)
    FROM bad b JOIN roots r ON r.root=b.package_id JOIN pkg p ON p.id=b.package_id WHERE b.published_at IS NOT NULL
  UNION ALL SELECT v.package_id, v.published_at, 'publish','high', concat(p.name,'@',v.semver,': also published inside the window')
    FROM ver v JOIN inc i ON i.root=v.package_id JOIN pkg p ON p.id=v.package_id WHERE v.compromised_window AND v.semver<>i.bad_version
  UNION ALL SELECT root, min(published_at), 'sister','high', concat(count(*),' sister releases inside the window, first ',arg_min(concat(name,'@',window_release),(published_at,package_id))) FROM sis WHERE in_window GROUP BY 1
  UNION ALL SELECT x.root, l.last, 'typosquat','warning', concat('look-alike ',p.name,', edit distance ',x.d) FROM
    (SELECT dst AS root, src AS c, edit_distance AS d FROM squat UNION ALL SELECT src, dst, edit_distance FROM squat) x
    JOIN roots r ON r.root=x.root JOIN pkg p ON p.id=x.c JOIN (SELECT package_id, max(published_at) AS last FROM ver GROUP BY 1) l ON l.package_id=x.c
  UNION ALL SELECT b.root, TIMESTAMP '{DETECTED}', 'detection','critical', concat('exposed: ',exposed_packages,' packages, ',exposed_lockfiles,'/',f.total_lockfiles,
    ' lockfiles, ',exposed_services,'/',f.total_services,' services, ',tier1_exposed,' tier-1') FROM rblast b, fleet f) e0)"""


def timeline_of(g: Graph) -> DataFrame:
    return g.once("timeline", lambda: I.timeline(
        g.roots, g.package, g.version, incidents(g), safe_for_roots(g), I.sister_reference(incident_sisters(g)), look_alikes(g),
        refined_radius(g), F.lit(DETECTED).cast("timestamp_ntz"), g.scratch))


@query("timeline", sql("""
SELECT root, row_number() OVER (PARTITION BY root ORDER BY kind='detection', ev."at", CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'warning' THEN 3 ELSE 4 END, kind, event) AS rank,
strftime(ev."at",'%Y-%m-%dT%H:%M:%SZ') AS "at", kind, severity, event, refers_to, stands_for FROM ev""", SAFE, STATE, SIGNALS, EVENTS))
def timeline(g: Graph) -> DataFrame:
    return timeline_of(g).select(
        "root", "rank", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), "kind", "severity", "event", "refers_to", "stands_for"
    )


@query("sister_events", sql("""
SELECT maintainer_id, package_id, strftime(published_at,'%Y-%m-%dT%H:%M:%S.%f') AS "at", concat('sister release ',name,'@',window_release) AS event FROM state WHERE in_window""", STATE))
def sister_events(g: Graph) -> DataFrame:
    """Every windowed package of every maintainer, to which the rows of ``timeline`` refer."""
    return instants_as_text(I.sister_events(H.maintained_state(owned(g), g.package, g.version)))


@query("root_sister_events", sql("""
SELECT root, package_id, strftime(published_at,'%Y-%m-%dT%H:%M:%S.%f') AS "at" FROM sis WHERE in_window AND root IN (SELECT root FROM inc WHERE root IN (SELECT package_id FROM mal))""", STATE, SIGNALS))
def root_sister_events(g: Graph) -> DataFrame:
    """The sister events of the incidents at hand, flagged roots, one by one: what their timeline rows stand for."""
    flagged = g.package.where("is_compromised").select(F.col("id").alias("root"))
    refers = timeline_of(g).where("refers_to IS NOT NULL").join(flagged, "root", "left_semi").select("root", F.col("refers_to").alias("maintainer_id"))
    events = I.sister_events(H.maintained_state(owned(g), g.package, g.version))
    return instants_as_text(refers.join(events, "maintainer_id").where("package_id <> root").select("root", "package_id", "at"))


@query("maintainer_report", sql("""
SELECT root, maintainer_id, package_id, name, in_window, flagged, window_release, rank() OVER (PARTITION BY root ORDER BY flagged DESC, name, package_id) AS rank,
(SELECT count(*) FROM sis x WHERE x.root=sis.root AND flagged) AS flagged_count FROM sis WHERE root=(SELECT s.id FROM stat s JOIN pkg p ON p.id=s.id
 JOIN prim ON prim.root=s.id WHERE s.is_compromised ORDER BY p.downloads_weekly DESC, s.id LIMIT 1)""", OSV, STATUS, STATE, SIGNALS))
def maintainer_report(g: Graph) -> DataFrame:
    """Sisters of one named package: the most downloaded flagged root, by its primary maintainer."""
    centre = (
        applied(g).packages.where("is_compromised").select("id")
        .join(g.roots.select(F.col("root").alias("id")), "id", "left_semi").join(g.package.select("id", "downloads_weekly"), "id")
        .orderBy(F.desc_nulls_last("downloads_weekly"), "id").limit(1).select(F.col("id").alias("root"))
    )
    named = centre.join(H.primary_maintainer(g.maintained_by).withColumnRenamed("package_id", "root"), "root")
    found = g.scratch.keep(H.sisters(owned(g), g.package, g.version, named), "named-sisters")
    flagged = found.groupBy("root").agg(F.count_if("flagged").alias("flagged_count"))
    return H.rank_sisters(found, ["root"], g.scratch).join(flagged, "root").select(
        "root", "maintainer_id", "package_id", "name", "in_window", "flagged", "window_release", "rank", "flagged_count"
    )


@query("incident_report", sql(f"""
SELECT r.root, r.bad_version, r.services_before, r.exposed_services, r.exposed_packages, r.exposed_lockfiles, r.tier1_exposed, r.percentage, r.excluded_direct,
s.safe_version, s.reason, k.score, k.flagged, k.look_alikes, e.n AS events, p.maintainer_id, {SEVERITY} AS severity
FROM refd r LEFT JOIN safe s ON s.package_id=r.root LEFT JOIN risk k ON k.root=r.root LEFT JOIN (SELECT root, CAST(sum(stands_for) AS BIGINT) AS n FROM ev GROUP BY 1) e ON e.root=r.root
LEFT JOIN prim p ON p.root=r.root""", SAFE, STATE, SIGNALS, EVENTS, f"refd AS ({REFINED})"))
def incident_report(g: Graph) -> DataFrame:
    out = I.incident_report(
        precision_summary(g), safe_for_roots(g), risk(g), timeline_of(g), H.primary_maintainer(g.maintained_by)
    )
    return out.select(
        "root", "bad_version", "services_before", "exposed_services", "exposed_packages", "exposed_lockfiles", "tier1_exposed",
        "percentage", "excluded_direct", "safe_version", "reason", "score", "flagged", "look_alikes", "events", "maintainer_id", "severity",
    )


PINNED = """
pinned AS MATERIALIZED (SELECT d.dst AS root, d.src AS lockfile_id, max(d.constraint_) AS constraint_ FROM dep d JOIN roots r ON r.root=d.dst
  WHERE d.src>=5000000000000 GROUP BY 1,2)"""


def pinned(g: Graph) -> DataFrame:
    return M.pinned_constraints(g.depends_on, g.roots, g.ids)


@query("pinned_constraints", sql("""
SELECT root, lockfile_id, constraint_, concat('^',split_part(substr(constraint_,2),'.',1),'.',split_part(constraint_,'.',2),'.0') AS manifest_range,
'npm' AS manager, 'overrides' AS override_field FROM pinned""", PINNED))
def pinned_constraints(g: Graph) -> DataFrame:
    names = g.lockfile.select(F.col("id").alias("lockfile_id"), F.element_at(F.split("name", "/"), -1).alias("filename"))
    return pinned(g).join(names, "lockfile_id").select(
        "root", "lockfile_id", "constraint_", M.manifest_range(F.col("constraint_")).alias("manifest_range"),
        M.manager(F.col("filename")).alias("manager"), M.override_field(F.col("filename")).alias("override_field"),
    )


PLAN = """
exps AS MATERIALIZED (SELECT root, node AS service_id FROM clo WHERE depth<=6 AND node>=4000000000000 AND node<5000000000000),
wpin AS (SELECT DISTINCT v.package_id AS root, p.src AS lockfile_id FROM pin p JOIN ver v ON v.id=p.dst JOIN roots r ON r.root=v.package_id
  WHERE v.compromised_window OR v.semver=(SELECT bad_version FROM inc WHERE inc.root=v.package_id)),
plan AS MATERIALIZED (SELECT a.root, l.service_id, s.name AS service, a.lockfile_id, l.name AS lockfile, 'npm' AS manager, 'overrides' AS override_field,
  concat('^',split_part(coalesce(substr(a.c,2),f.bad_version),'.',1),'.',split_part(coalesce(a.c,f.bad_version),'.',2),'.0') AS constraint_, f.bad_version, f.safe_version
  FROM (SELECT root, lockfile_id, max(c) AS c FROM (SELECT root, lockfile_id, constraint_ AS c FROM pinned UNION ALL SELECT root, lockfile_id, NULL FROM wpin) GROUP BY 1,2) a
  JOIN safe f ON f.package_id=a.root AND f.safe_version IS NOT NULL JOIN lock l ON l.id=a.lockfile_id JOIN svc s ON s.id=l.service_id
  WHERE NOT EXISTS (SELECT 1 FROM exps e WHERE e.root=a.root) OR EXISTS (SELECT 1 FROM exps e WHERE e.root=a.root AND e.service_id=l.service_id))"""


def exposed_services(g: Graph, refined: bool = False) -> DataFrame:
    source = kept(g) if refined else g.closure(6)
    return source.where(g.ids.is_label(F.col("node"), X.SERVICE)).select("root", F.col("node").alias("service_id"))


def planned(g: Graph, refined: bool = False) -> DataFrame:
    def build() -> DataFrame:
        live = root_pins(g).where("windowed").select("root", F.col("node").alias("lockfile_id")).distinct()
        safe_ = safe_for_roots(g).select("root", "bad_version", "safe_version")
        return M.plan(g.lockfile, g.service, pinned(g), live, safe_, exposed_services(g, refined))

    return g.kept("plan-refined" if refined else "plan", build)


@query("remediation_plan", sql("SELECT * FROM plan", SAFE, PINNED, PLAN))
def remediation_plan(g: Graph) -> DataFrame:
    return planned(g)


@query("unpatched_services", sql("""
SELECT e.root, e.service_id, s.name FROM exps e JOIN svc s ON s.id=e.service_id
WHERE NOT EXISTS (SELECT 1 FROM plan p WHERE p.root=e.root AND p.service_id=e.service_id)""", SAFE, PINNED, PLAN))
def unpatched_services(g: Graph) -> DataFrame:
    return M.unpatched(exposed_services(g), planned(g)).join(
        g.service.select(F.col("id").alias("service_id"), "name"), "service_id"
    ).select("root", "service_id", "name")


EXPOSED_REFINED = "SELECT root, node AS service_id FROM gclo WHERE node>=4000000000000 AND node<5000000000000"
PLAN_REFINED = PLAN.replace("SELECT root, node AS service_id FROM clo WHERE depth<=6 AND node>=4000000000000 AND node<5000000000000", EXPOSED_REFINED)


@query("remediation_refined", sql("SELECT * FROM plan", SAFE, PINNED, PLAN_REFINED))
def remediation_refined(g: Graph) -> DataFrame:
    """The plan limited to services that are exposed after refinement."""
    return planned(g, refined=True)


@query("unpatched_refined", sql("""
SELECT e.root, e.service_id FROM exps e WHERE NOT EXISTS (SELECT 1 FROM plan p WHERE p.root=e.root AND p.service_id=e.service_id)""", SAFE, PINNED, PLAN_REFINED))
def unpatched_refined(g: Graph) -> DataFrame:
    return M.unpatched(exposed_services(g, refined=True), planned(g, refined=True)).select("root", "service_id")


@query("override_merge", sql("""
SELECT k.service_id, p.name AS package, coalesce(c.safe_version, CASE WHEN k.dst=k.lowest THEN '0.0.0' END) AS override,
CASE WHEN k.declared THEN coalesce(c.safe_version,k.constraint_) END AS direct_spec, k.declared AS declared
FROM (SELECT d.src AS service_id, d.dst, d.constraint_, true AS declared, min(d.dst) OVER (PARTITION BY d.src) AS lowest FROM dep d WHERE d.src>=4000000000000 AND d.src<5000000000000 AND d.dst<2000000000000
  UNION ALL SELECT DISTINCT q.service_id, q.root, NULL, false, NULL FROM plan q WHERE NOT EXISTS (SELECT 1 FROM dep d WHERE d.src=q.service_id AND d.dst=q.root)
    AND EXISTS (SELECT 1 FROM dep d WHERE d.src=q.service_id AND d.dst<2000000000000)) k
JOIN pkg p ON p.id=k.dst LEFT JOIN (SELECT DISTINCT service_id, root, safe_version FROM plan) c ON c.service_id=k.service_id AND c.root=k.dst
WHERE c.safe_version IS NOT NULL OR k.dst=k.lowest""", SAFE, PINNED, PLAN))
def override_merge(g: Graph) -> DataFrame:
    """Declared and overridden packages of each service with the planned pins merged in.

    Every service starts with one override, for its lowest dependency.
    """
    names = g.package.select(F.col("id").alias("dst"), F.col("name").alias("package"))
    declared = g.depends_on.where(g.ids.is_label(F.col("src"), X.SERVICE)).join(names, "dst").select(
        F.col("src").alias("service_id"), "dst", "package", F.col("constraint_").alias("spec")
    )
    current = declared.groupBy("service_id").agg(F.min_by("package", "dst").alias("package")).withColumn("override", F.lit("0.0.0"))
    pins = planned(g).select("service_id", F.col("root").alias("dst"), "safe_version").distinct().join(names, "dst").join(
        current.select("service_id"), "service_id", "left_semi"
    )
    return M.merge_override_rows(declared, current, pins.select("service_id", "package", "safe_version"))
