"""Version-exact exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import schema as X
from faultline.catalog.registry import query, sql
from faultline.catalog.versions import incidents
from faultline.operators import precision as P
from faultline.operators.routes import routes
from faultline.operators import scans as S
from faultline.operators.closure import reach
from faultline.sources.binding import Graph


def gate(g: Graph) -> DataFrame:
    return g.kept("gate", lambda: P.hop1_gate(g.depends_on, incidents(g)))


def pins(g: Graph) -> DataFrame:
    return g.kept("pins", lambda: P.lockfile_pins(g.located, g.version, incidents(g), g.ids))


def root_pins(g: Graph) -> DataFrame:
    """As ``pins``, with releases numbered among those of the roots: for steps that do not show the number."""
    return g.kept("root_pins", lambda: P.lockfile_pins(g.root_located, g.root_version, incidents(g), g.ids))


def clean(g: Graph) -> DataFrame:
    return g.kept("clean", lambda: P.clean_lockfiles(root_pins(g)))


def kept(g: Graph) -> DataFrame:
    """(root, node) still exposed after refinement."""
    return g.once("remaining", lambda: P.remaining(
        g.dependents, g.roots, incidents(g), gate(g), clean(g), X.DEFAULT_DEPTH, g.scratch))


def refined(g: Graph) -> DataFrame:
    return g.kept("refined", lambda: P.mark(g.closure(6), kept(g), incidents(g)))


@query("hop1_gate", sql("SELECT root, node, gated, CASE WHEN gated THEN first_out END AS constraint_ FROM gate"))
def hop1_gate(g: Graph) -> DataFrame:
    return gate(g).select("root", "node", "gated", "constraint_")


@query("lockfile_pins", sql("SELECT root, node, version_id, semver, windowed FROM pins"))
def lockfile_pins(g: Graph) -> DataFrame:
    return pins(g)


@query("clean_lockfiles", sql("SELECT root, node FROM clean"))
def clean_lockfiles(g: Graph) -> DataFrame:
    return clean(g)


@query("gated_bfs", sql("SELECT root, node, depth FROM gclo"))
def gated_bfs(g: Graph) -> DataFrame:
    gated = gate(g).where("gated")
    return reach(
        g.dependents, incidents(g), X.DEFAULT_DEPTH, g.scratch, first_hop_blocked=gated, blocked=clean(g)
    ).withColumn("depth", F.col("depth").cast("bigint"))


@query("refined_closure", sql("""
SELECT c.root, c.node, g.node IS NOT NULL AS kept FROM clo c LEFT JOIN gclo g ON g.root=c.root AND g.node=c.node WHERE c.depth<=6"""))
def refined_closure(g: Graph) -> DataFrame:
    return refined(g).select("root", "node", "kept")


@query("refined_routes", sql("""
SELECT root, rank, array_to_string(chain,'>') AS chain, truncated FROM (SELECT root, chain, row_number() OVER (PARTITION BY root ORDER BY hops, chain) AS rank,
 count(*) OVER (PARTITION BY root)>400 AS truncated FROM gpaths WHERE hops>0) WHERE rank<=400""", """
open_ AS MATERIALIZED (SELECT DISTINCT c.root, d.dst, d.src FROM (SELECT root, node FROM gclo UNION ALL SELECT root, root FROM roots) c JOIN dep d ON d.dst=c.node
 JOIN gclo t ON t.root=c.root AND t.node=d.src
 WHERE NOT EXISTS (SELECT 1 FROM gate g WHERE g.root=c.root AND d.dst=c.root AND g.node=d.src AND g.gated)),
gpaths AS (SELECT root, root AS node, [root] AS chain, 0 AS hops FROM roots
 UNION ALL SELECT p.root, o.src, list_append(p.chain,o.src), p.hops+1 FROM gpaths p JOIN open_ o ON o.root=p.root AND o.dst=p.node
 WHERE p.hops<6 AND NOT list_contains(p.chain,o.src))"""))
def refined_routes(g: Graph) -> DataFrame:
    """The first routes over what is left after refinement, not what is left of the first routes."""
    out = routes(g.dependents, g.roots, X.DEFAULT_DEPTH, g.scratch, first_hop_blocked=gate(g).where("gated"), allowed=kept(g))
    return out.select("root", "rank", F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain"), "truncated")


REFINED = """
SELECT b.root, i.bad_version, b.exposed_services AS services_before, r.exposed_packages, r.exposed_services, r.exposed_lockfiles, r.tier1_exposed,
round(100.0::DOUBLE*b.exposed_services/f.total_services,1) AS percentage_before, round(100.0::DOUBLE*r.exposed_services/f.total_services,1) AS percentage,
(SELECT count(*) FROM gate g WHERE g.root=b.root AND g.gated) AS excluded_direct
FROM blast b JOIN rblast r ON r.root=b.root JOIN inc i ON i.root=b.root, fleet f"""


def refined_radius(g: Graph) -> DataFrame:
    return g.kept("refined_radius", lambda: P.blast_radius(kept(g), g.roots, g.service, S.fleet(g), g.ids))


def precision_summary(g: Graph) -> DataFrame:
    before = P.blast_radius(g.closure(6), g.roots, g.service, S.fleet(g), g.ids).select(
        "root", F.col("exposed_services").alias("services_before"), F.col("percentage").alias("percentage_before")
    )
    excluded = gate(g).groupBy("root").agg(F.count_if("gated").alias("excluded_direct"))
    return (
        refined_radius(g)
        .join(before, "root")
        .join(incidents(g).select("root", "bad_version"), "root")
        .join(excluded, "root", "left")
        .fillna(0, ["excluded_direct"])
    )


@query("refined_blast", sql(REFINED))
def refined_blast(g: Graph) -> DataFrame:
    return precision_summary(g).select(
        "root", "bad_version", "services_before", "exposed_packages", "exposed_services", "exposed_lockfiles",
        "tier1_exposed", "percentage_before", "percentage", "excluded_direct",
    )


@query("resolved_while_live", sql("""
SELECT v.package_id AS root, p.src AS lockfile_id, l.service_id, p.resolved_version AS semver,
l.generated_at>=v.published_at AS after_publish
FROM pin p JOIN ver v ON v.id=p.dst AND v.compromised_window JOIN lock l ON l.id=p.src"""))
def resolved_while_live(g: Graph) -> DataFrame:
    return S.resolved_while_live(g)
