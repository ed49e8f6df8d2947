"""Scans, lookups, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import schema as X
from faultline.catalog.registry import query, sql
from faultline.operators import scans as S
from faultline.sources.binding import Graph


def _json(**fields: str) -> str:
    """SQL for a JSON object of the fields that are not null; values are SQL for JSON text."""
    members = ", ".join(f"CASE WHEN {value} IS NOT NULL THEN concat('\"{name}\":', {text}) END" for name, (value, text) in fields.items())
    return f"concat('{{', array_to_string(list_filter([{members}], lambda m: m IS NOT NULL), ','), '}}')"


def _text(column: str) -> tuple[str, str]:
    return column, f"concat('\"', {column}, '\"')"


def _plain(column: str) -> tuple[str, str]:
    return column, f"CAST({column} AS VARCHAR)"


def _instant(column: str) -> tuple[str, str]:
    return column, f"concat('\"', strftime({column},'%Y-%m-%dT%H:%M:%S.%f'), '\"')"


INSTANT = "%Y-%m-%dT%H:%M:%S.%f"
NODE_ROWS = f"""
pkgs AS (SELECT p.*, n.semver AS latest_version, l.last AS last_published_at, p.id IN (SELECT package_id FROM mal) AS is_compromised
  FROM pkg p LEFT JOIN newest n ON n.package_id=p.id LEFT JOIN (SELECT package_id, max(published_at) AS last FROM ver GROUP BY 1) l ON l.package_id=p.id),
vers AS (SELECT v.*, p.name AS package_name FROM ver v LEFT JOIN pkg p ON p.id=v.package_id),
noderows AS (
  SELECT 'Package' AS label, id, name, ecosystem, downloads_weekly, latest_version, strftime(last_published_at,'{INSTANT}') AS last_published_at, is_compromised,
    CAST(NULL AS BIGINT) AS package_id, CAST(NULL AS VARCHAR) AS package_name, CAST(NULL AS VARCHAR) AS semver, CAST(NULL AS VARCHAR) AS published_at, CAST(NULL AS BOOLEAN) AS compromised_window,
    CAST(NULL AS VARCHAR) AS criticality, CAST(NULL AS BIGINT) AS service_id, CAST(NULL AS VARCHAR) AS generated_at,
    {_json(ecosystem=_text("ecosystem"), downloads_weekly=_plain("downloads_weekly"), latest_version=_text("latest_version"), last_published_at=_instant("last_published_at"), is_compromised=_plain("is_compromised"))} AS properties FROM pkgs
  UNION ALL SELECT 'Version', id, concat_ws('@',package_name,semver), NULL, NULL, NULL, NULL, NULL, package_id, package_name, semver, strftime(published_at,'{INSTANT}'), compromised_window, NULL, NULL, NULL,
    {_json(package_id=_plain("package_id"), package_name=_text("package_name"), semver=_text("semver"), published_at=_instant("published_at"), compromised_window=_plain("compromised_window"))} FROM vers
  UNION ALL SELECT 'Maintainer', id, name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{{}}' FROM mtn
  UNION ALL SELECT 'Service', id, name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, criticality, NULL, NULL, {_json(criticality=_text("criticality"))} FROM svc
  UNION ALL SELECT 'Lockfile', id, name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, service_id, strftime(generated_at,'{INSTANT}'),
    {_json(service_id=_plain("service_id"), generated_at=_instant("generated_at"))} FROM lock)"""


def instants_as_text(rows: DataFrame) -> DataFrame:
    """Times of day written out to the microsecond, so that engines compare them alike."""
    return rows.select(*(F.date_format(c, S.INSTANT).alias(c) if kind.startswith("timestamp") else F.col(c) for c, kind in rows.dtypes))


@query("label_scan", sql("SELECT * FROM noderows", NODE_ROWS))
def label_scan(g: Graph) -> DataFrame:
    return instants_as_text(S.node_rows(g))


@query("edge_scan", sql(f"""
SELECT type, CAST(('0x'||substr(sha1(concat(type,'|',src,'|',dst)),1,16))::UBIGINT >> 2 AS BIGINT) AS eid, src, dst, constraint_, since, resolved_version, edit_distance, similarity_score, properties FROM (
  SELECT 'DEPENDS_ON' AS type, src, dst, constraint_, CAST(NULL AS VARCHAR) AS since, CAST(NULL AS VARCHAR) AS resolved_version, CAST(NULL AS BIGINT) AS edit_distance, CAST(NULL AS DOUBLE) AS similarity_score,
    {_json(constraint_=_text("constraint_"))} AS properties FROM dep
  UNION ALL SELECT 'MAINTAINED_BY', src, dst, NULL, strftime(since,'{INSTANT}'), NULL, NULL, NULL, {_json(since=_instant("since"))} FROM mnt
  UNION ALL SELECT 'RESOLVED_IN', src, dst, NULL, NULL, resolved_version, NULL, NULL, {_json(resolved_version=_text("resolved_version"))} FROM res
  UNION ALL SELECT 'TYPOSQUAT_OF', src, dst, NULL, NULL, NULL, edit_distance, similarity_score, {_json(edit_distance=_plain("edit_distance"), similarity_score=_plain("similarity_score"))} FROM squat)"""))
def edge_scan(g: Graph) -> DataFrame:
    return instants_as_text(S.edge_rows(g))


@query("node_lookup", sql("""
SELECT label, id, name, package_id, package_name, semver, published_at, compromised_window, properties FROM noderows WHERE id=2000000000001""", NODE_ROWS))
def node_lookup(g: Graph) -> DataFrame:
    return instants_as_text(S.node_lookup(g, g.ids.base(X.VERSION) + 1))


@query("hydrate_nodes", sql("""
SELECT w.id, CASE WHEN w.id//1000000000000 BETWEEN 1 AND 5 THEN ['Package','Version','Maintainer','Service','Lockfile'][CAST(w.id//1000000000000 AS INT)] END AS label,
coalesce(n.name, concat('node-',w.id)) AS name
FROM (SELECT DISTINCT 4000000000000+o_custkey*7 AS id FROM orders UNION SELECT DISTINCT dst FROM dep) w LEFT JOIN nodes n ON n.id=w.id"""))
def hydrate_nodes(g: Graph) -> DataFrame:
    """Every dependency target, and service ids of which some are not stored."""
    service = g.ids.base(X.SERVICE)
    sparse = g.lockfile.sparkSession.read.parquet(g.source("orders")).select((F.lit(service) + F.col("o_custkey") * 7).alias("id"))
    return S.hydrate(g, sparse.unionByName(g.depends_on.select(F.col("dst").alias("id"))))


@query("resolve_package", sql("""
SELECT q.request, min(p.id) AS id, min(p.name) AS name, CAST(min(CASE WHEN p.name=q.request THEN 2 ELSE 3 END) AS BIGINT) AS how
FROM (SELECT DISTINCT replace(p_name,' ','-') AS request FROM part) q JOIN pkg p ON starts_with(p.name,q.request)
WHERE p.id=(SELECT min(x.id) FROM pkg x WHERE starts_with(x.name,q.request)) GROUP BY 1
UNION ALL SELECT name, id, name, 2 FROM pkg UNION ALL SELECT CAST(id AS VARCHAR), id, name, 1 FROM pkg"""))
def resolve_package(g: Graph) -> DataFrame:
    parts = g.spark.read.parquet(g.source("part"))
    asked = (
        parts.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("request"))
        .unionByName(g.package.select(F.col("name").alias("request")))
        .unionByName(g.package.select(F.col("id").cast("string").alias("request")))
    )
    return S.resolve_packages(g, asked).withColumn("how", F.col("how").cast("bigint"))


@query("package_keys", sql("SELECT DISTINCT ecosystem, name, concat(ecosystem,':',name) AS key FROM pkg"))
def package_keys(g: Graph) -> DataFrame:
    return S.package_keys(g)


@query("label_of_id", sql("""
SELECT id, CASE WHEN id//1000000000000 BETWEEN 1 AND 5 THEN ['Package','Version','Maintainer','Service','Lockfile'][CAST(id//1000000000000 AS INT)] END AS label
FROM (SELECT id FROM nodes UNION SELECT o_orderkey FROM orders)"""))
def label_of_id(g: Graph) -> DataFrame:
    keys = g.spark.read.parquet(g.source("orders")).select(F.col("o_orderkey").alias("id"))
    return g.nodes().select("id").union(keys).distinct().withColumn("label", g.ids.label_of(F.col("id")))


@query("edge_ids", sql("""
SELECT src, dst, CAST(('0x'||substr(sha1(concat('DEPENDS_ON|',src,'|',dst)),1,16))::UBIGINT >> 2 AS BIGINT) AS eid FROM dep"""))
def edge_ids(g: Graph) -> DataFrame:
    return g.depends_on.select("src", "dst", X.edge_id(X.DEPENDS_ON, F.col("src"), F.col("dst")).alias("eid"))


@query("inverse_edges", sql("""
SELECT 'DEPENDED_ON_BY' AS type, dst AS src, src AS dst FROM dep WHERE src<>dst
UNION ALL SELECT 'MAINTAINS', dst, src FROM mnt WHERE src<>dst"""))
def inverse_edges(g: Graph) -> DataFrame:
    return S.inverse(g.depends_on, X.DEPENDED_ON_BY).unionByName(S.inverse(g.maintained_by, X.MAINTAINS))


@query("graph_stats", sql("""
SELECT label AS metric, count(*) AS value FROM nodes GROUP BY 1 UNION ALL SELECT type, count(*) FROM pub GROUP BY 1
UNION ALL SELECT 'compromised', count(*) FROM pkg JOIN mal ON mal.package_id=pkg.id
UNION ALL SELECT 'total_nodes', count(*) FROM nodes UNION ALL SELECT 'total_edges', count(*) FROM pub"""))
def graph_stats(g: Graph) -> DataFrame:
    return S.graph_stats(g)


@query("fleet", sql("SELECT * FROM fleet"))
def fleet(g: Graph) -> DataFrame:
    return S.fleet(g)


@query("graph_head", sql("""
SELECT 'node' AS kind, label AS type, id AS a, CAST(NULL AS BIGINT) AS b FROM head
UNION ALL SELECT 'edge', type, src, dst FROM pub WHERE src IN (SELECT id FROM head) AND dst IN (SELECT id FROM head)""",
    "head AS (SELECT id,label FROM nodes ORDER BY id LIMIT 1000)"))
def graph_head(g: Graph) -> DataFrame:
    head, edges = S.graph_head(g, 1000)
    nodes = head.select(
        F.lit("node").alias("kind"), g.ids.label_of(F.col("id")).alias("type"), F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b")
    )
    return nodes.unionByName(edges.select(F.lit("edge").alias("kind"), "type", F.col("src").alias("a"), F.col("dst").alias("b")))


@query("compromised_packages", sql("SELECT id, name FROM pkg WHERE id IN (SELECT package_id FROM mal)"))
def compromised_packages(g: Graph) -> DataFrame:
    return g.package.where("is_compromised").select("id", "name")


@query("windowed_versions", sql("""
SELECT v.id, v.package_id, v.semver, v.compromised_window AS flagged,
coalesce(v.published_at>=f.published_at AND v.published_at<f.published_at+INTERVAL 48 HOUR, false) AS near_breach
FROM ver v LEFT JOIN fstw f ON f.package_id=v.package_id
WHERE v.compromised_window OR (v.published_at>=f.published_at AND v.published_at<f.published_at+INTERVAL 48 HOUR)"""))
def windowed_versions(g: Graph) -> DataFrame:
    """Flagged releases, and releases within 48 hours of a package's first flagged one."""
    return S.near_breach(g.version, 48).where("flagged OR near_breach")


@query("service_lockfiles", sql("SELECT DISTINCT service_id, id AS lockfile_id FROM lock"))
def service_lockfiles(g: Graph) -> DataFrame:
    return S.service_lockfiles(g)


@query("fixed_hop_in", sql("SELECT r.root, d.src AS dependent, d.constraint_ FROM roots r JOIN dep d ON d.dst=r.root"))
def fixed_hop_in(g: Graph) -> DataFrame:
    return S.direct_dependents(g, g.roots)
