"""Closures, routes, exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import schema as X
from faultline.catalog.registry import query, sql
from faultline.operators import closure as C
from faultline.operators import precision as P
from faultline.operators import routes as R
from faultline.operators import scans as S
from faultline.sources.binding import Graph

ROUTES = """
paths AS (SELECT root, root AS node, [root] AS chain, 0 AS hops FROM roots
  UNION ALL SELECT p.root, d.src, list_append(p.chain,d.src), p.hops+1 FROM paths p
  JOIN (SELECT DISTINCT src,dst FROM dep) d ON d.dst=p.node WHERE p.hops<6 AND NOT list_contains(p.chain,d.src)),
routes AS (SELECT * FROM (SELECT root, chain, hops, row_number() OVER (PARTITION BY root ORDER BY hops, chain) AS rank, count(*) OVER (PARTITION BY root)>400 AS truncated
  FROM paths WHERE hops>0) WHERE rank<=400)"""


def found_routes(g: Graph) -> DataFrame:
    return g.once("routes", lambda: R.routes(g.dependents, g.roots, X.DEFAULT_DEPTH, g.scratch))


@query("closure_depth6", sql("""
SELECT c.root, c.node, n.label FROM clo c JOIN (SELECT DISTINCT id, label FROM nodes) n ON n.id=c.node WHERE c.depth<=6"""))
def closure_depth6(g: Graph) -> DataFrame:
    return g.closure(6).select("root", "node", g.ids.label_of(F.col("node")).alias("label"))


@query("hop_distance", sql("SELECT root, node, depth FROM clo WHERE depth<=6"))
def hop_distance(g: Graph) -> DataFrame:
    """Shortest distances of all members of the closure."""
    return g.closure(6).select("root", "node", F.col("depth").cast("bigint").alias("depth"))


@query("depth_sweep", sql("""
SELECT root, count(*) FILTER (depth<=1) AS depth_1, count(*) FILTER (depth<=2) AS depth_2, count(*) FILTER (depth<=3) AS depth_3,
count(*) FILTER (depth<=4) AS depth_4, count(*) FILTER (depth<=5) AS depth_5, count(*) FILTER (depth<=6) AS depth_6,
count(*) FILTER (depth<=8) AS depth_8 FROM clo WHERE node>=4000000000000 AND node<5000000000000 GROUP BY root"""))
def depth_sweep(g: Graph) -> DataFrame:
    return C.depth_sweep(g.closure(8), g.service.select(F.col("id").alias("node")), (1, 2, 3, 4, 5, 6, 8))


@query("wavefront", sql("""
SELECT root, CAST(hop AS BIGINT) AS hop, arrived, CAST(sum(arrived) OVER (PARTITION BY root ORDER BY hop) AS BIGINT) AS infected
FROM (SELECT root, depth AS hop, count(*) AS arrived FROM clo WHERE depth<=6 GROUP BY 1,2
      UNION ALL SELECT DISTINCT root, 0, 1 FROM clo)"""))
def wavefront(g: Graph) -> DataFrame:
    return C.wavefront(g.closure(6)).withColumn("hop", F.col("hop").cast("bigint"))


@query("routes", sql("SELECT root, rank, CAST(hops AS BIGINT) AS hops, array_to_string(chain,'>') AS chain, truncated FROM routes", ROUTES))
def routes(g: Graph) -> DataFrame:
    return found_routes(g).select(
        "root", "rank", F.col("hops").cast("bigint").alias("hops"), F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain"), "truncated"
    )


@query("infection_edges", sql("""
SELECT DISTINCT c.root, c.node AS source, d.src AS target FROM (SELECT root, node, depth FROM clo UNION ALL SELECT root, root, 0 FROM roots) c
JOIN dep d ON d.dst=c.node WHERE c.depth<6 AND d.src<>c.root"""))
def infection_edges(g: Graph) -> DataFrame:
    return R.infection_edges(g.dependents, g.roots, g.closure(6), 6)


@query("neighbours", sql("""
SELECT e.id, e.n AS neighbour, CASE WHEN e.n//1000000000000 BETWEEN 1 AND 5 THEN ['Package','Version','Maintainer','Service','Lockfile'][CAST(e.n//1000000000000 AS INT)] END AS label, x.name, e.edges
FROM (SELECT id, n, count(*) AS edges FROM (SELECT src AS id, dst AS n FROM pub WHERE src<>dst UNION ALL SELECT dst, src FROM pub WHERE src<>dst) GROUP BY 1,2) e LEFT JOIN nodes x ON x.id=e.n"""))
def neighbours(g: Graph) -> DataFrame:
    return S.neighbours(g)


@query("indegree_importance", sql("""
SELECT n.id, coalesce(d.c,0) AS dependents, round(least(1.0::DOUBLE, 0.55::DOUBLE*ln(1+coalesce(p.downloads_weekly,0))/ln(1+t.dl)
 + 0.65::DOUBLE*ln(1+coalesce(d.c,0))/ln(1+t.dp)),4) AS importance
FROM nodes n LEFT JOIN pkg p ON p.id=n.id LEFT JOIN ind d ON d.dst=n.id, (SELECT max(downloads_weekly) AS dl, (SELECT max(c) FROM ind) AS dp FROM pkg) t""",
    "ind AS (SELECT dst, count(*) AS c FROM dep GROUP BY 1)"))
def indegree_importance(g: Graph) -> DataFrame:
    return S.importance(g)


@query("package_reach", sql("""
SELECT r.root, count(c.node) AS reach FROM roots r LEFT JOIN clo c ON c.root=r.root AND c.depth<=6 GROUP BY 1"""))
def package_reach(g: Graph) -> DataFrame:
    counted = g.closure(6).groupBy("root").agg(F.count("node").alias("reach"))
    return g.roots.join(counted, "root", "left").fillna(0, ["reach"])


@query("blast_radius", sql("""
SELECT b.*, f.total_services, f.total_lockfiles, round(100.0::DOUBLE*b.exposed_services/f.total_services,1) AS percentage FROM blast b, fleet f"""))
def blast_radius(g: Graph) -> DataFrame:
    return P.blast_radius(g.closure(6), g.roots, g.service, S.fleet(g), g.ids)


@query("exposed_flags", sql("""
SELECT n.id, n.label, coalesce(e.k,0) AS exposing_roots, coalesce(e.k,0)>0 AS exposed,
CASE n.label WHEN 'Package' THEN n.id IN (SELECT package_id FROM mal) OR n.id IN (SELECT root FROM roots) ELSE coalesce(e.k,0)>0 END AS patchable
FROM nodes n LEFT JOIN (SELECT node, count(*) AS k FROM clo WHERE depth<=6 GROUP BY 1) e ON e.node=n.id
WHERE n.label IN ('Package','Service','Lockfile')"""))
def exposed_flags(g: Graph) -> DataFrame:
    return S.exposure_flags(g, g.closure(6))


@query("exposed_service_names", sql("""
SELECT DISTINCT c.root, s.name FROM clo c JOIN svc s ON s.id=c.node WHERE c.depth<=6"""))
def exposed_service_names(g: Graph) -> DataFrame:
    """One row per root and service name, in order, rather than one unbounded list."""
    return (
        g.closure(6)
        .join(g.service.select(F.col("id").alias("node"), "name"), "node")
        .select("root", "name")
        .distinct()
        .orderBy("root", "name")
    )
