"""Query registry and the common table expressions of the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.sources.binding import Graph, graph_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The graph tables of faultline.sources.binding, as SQL over the warehouse tables.
TABLES = """
pkg AS (SELECT 1000000000000+p_partkey AS id, concat(replace(p_name,' ','-'),'-',p_partkey) AS name, 'npm' AS ecosystem,
  CAST((p_partkey*7919)%10007*102 AS BIGINT) AS downloads_weekly FROM part),
svc AS (SELECT 4000000000000+c_custkey AS id, c_name AS name, CASE c_mktsegment WHEN 'MACHINERY' THEN 'tier-1'
  WHEN 'BUILDING' THEN 'tier-2' WHEN 'AUTOMOBILE' THEN 'tier-2' ELSE 'tier-3' END AS criticality FROM customer),
lock AS (SELECT 5000000000000+o_orderkey AS id, 4000000000000+o_custkey AS service_id,
  concat('order-',o_orderkey,'/package-lock.json') AS name, o_orderdate AS generated_at
  FROM orders WHERE o_orderpriority='1-URGENT'),
mtn AS (SELECT 3000000000000+s_suppkey AS id, s_name AS name FROM supplier),
rel AS (SELECT l_partkey, concat(1+CAST(l_quantity AS BIGINT)%5,'.',l_linenumber,'.',CAST(round(l_discount*100) AS BIGINT)) AS semver,
  min(l_shipdate) AS published_at FROM lineitem GROUP BY 1,2),
ver AS MATERIALIZED (SELECT 1999999999999+row_number() OVER (ORDER BY l_partkey,semver) AS id, 1000000000000+l_partkey AS package_id, semver, published_at,
  published_at>=TIMESTAMP '1998-06-01 00:00:00' AND published_at<TIMESTAMP '1998-07-01 00:00:00' AS compromised_window,
  CAST(split_part(semver,'.',1) AS BIGINT)*1000000+CAST(split_part(semver,'.',2) AS BIGINT)*1000+CAST(split_part(semver,'.',3) AS BIGINT) AS num
  FROM rel),
dpp AS (SELECT DISTINCT 1000000000000+l.l_partkey AS src, 1000000000000+m.p AS dst FROM lineitem l
  JOIN (SELECT l_orderkey,min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey) m ON l.l_orderkey=m.l_orderkey
  WHERE l.l_linenumber=7 AND l.l_returnflag='R' AND l.l_partkey<>m.p),
dsp AS (SELECT DISTINCT k.service_id AS src, 1000000000000+l.l_partkey AS dst FROM lock k JOIN lineitem l ON k.id=5000000000000+l.l_orderkey
  WHERE l.l_linenumber=1),
dep AS MATERIALIZED (SELECT src,dst,concat(CASE src%4 WHEN 0 THEN '^' WHEN 1 THEN '~' WHEN 2 THEN '>=' ELSE '' END,1+src%5,'.',1+src%7,'.0') AS constraint_ FROM dpp
  UNION ALL SELECT src,dst,concat('^',1+src%5,'.0.0') FROM dsp
  UNION ALL SELECT service_id,id,'lockfile' FROM lock
  UNION ALL SELECT k.id,1000000000000+l.l_partkey,concat('=',min(concat(1+CAST(l_quantity AS BIGINT)%5,'.',l_linenumber,'.',CAST(round(l_discount*100) AS BIGINT))))
  FROM lock k JOIN lineitem l ON k.id=5000000000000+l.l_orderkey WHERE l.l_linenumber=1 GROUP BY 1,2),
pin AS MATERIALIZED (SELECT DISTINCT k.id AS src, v.id AS dst, v.semver AS resolved_version FROM lock k JOIN lineitem l ON k.id=5000000000000+l.l_orderkey
  JOIN ver v ON v.package_id=1000000000000+l.l_partkey
  AND v.semver=concat(1+CAST(l_quantity AS BIGINT)%5,'.',l_linenumber,'.',CAST(round(l_discount*100) AS BIGINT))),
res AS (SELECT * FROM pin UNION ALL SELECT package_id, id, semver FROM ver),
mnt AS (SELECT 1000000000000+l_partkey AS src, 3000000000000+l_suppkey AS dst, min(l_shipdate) AS since FROM lineitem WHERE l_linenumber=2 GROUP BY 1,2),
adv AS (SELECT concat(CASE WHEN event_id%10=0 THEN 'MAL-' ELSE 'GHSA-' END,event_id) AS id, 1000000000000+user_id AS package_id,
  event_id%10=0 AS malicious, ts AS published, event_id, concat(1+CAST(floor(value) AS BIGINT)%5,'.0.0') AS introduced,
  CASE WHEN event_id%3=0 THEN NULL ELSE concat(2+CAST(floor(value) AS BIGINT)%5,'.0.0') END AS fixed,
  CASE WHEN event_id%10=0 THEN concat(1+CAST(floor(value) AS BIGINT)%5,'.1.',event_id%11) END AS exact_version,
  (1+CAST(floor(value) AS BIGINT)%5)*1000000 AS lo_num,
  CASE WHEN event_id%3=0 THEN 9000000000 ELSE (2+CAST(floor(value) AS BIGINT)%5)*1000000 END AS hi_num
  FROM events WHERE event_type='error'),
mal AS (SELECT DISTINCT package_id FROM adv WHERE malicious),
fold AS (SELECT id, name, downloads_weekly, replace(replace(translate(lower(name),'01345789-_.','oleastbg'),'rn','m'),'vv','w') AS f FROM pkg),
squat AS MATERIALIZED (SELECT c.id AS src, t.id AS dst, levenshtein(c.f,t.f) AS edit_distance,
  round(1.0::DOUBLE-levenshtein(c.f,t.f)::DOUBLE/greatest(length(c.f),length(t.f),1),4) AS similarity_score
  FROM fold c JOIN fold t ON t.downloads_weekly>=1000000 AND c.name<>t.name AND c.downloads_weekly<t.downloads_weekly
  AND abs(length(c.f)-length(t.f))<=2 AND levenshtein(c.f,t.f)<=2),
nodes AS (SELECT id,name,'Package' AS label FROM pkg
  UNION ALL SELECT v.id,concat(p.name,'@',v.semver),'Version' FROM ver v JOIN pkg p ON p.id=v.package_id
  UNION ALL SELECT id,name,'Maintainer' FROM mtn UNION ALL SELECT id,name,'Service' FROM svc UNION ALL SELECT id,name,'Lockfile' FROM lock),
pub AS (SELECT 'DEPENDS_ON' AS type,src,dst,constraint_ AS property FROM dep
  UNION ALL SELECT 'MAINTAINED_BY',src,dst,strftime(since,'%Y-%m-%d') FROM mnt
  UNION ALL SELECT 'RESOLVED_IN',src,dst,resolved_version FROM res
  UNION ALL SELECT 'TYPOSQUAT_OF',src,dst,CAST(edit_distance AS VARCHAR) FROM squat),
roots AS (SELECT DISTINCT package_id AS root FROM ver WHERE compromised_window),
walk AS (SELECT root, root AS node, 0 AS depth FROM roots
  UNION SELECT w.root, d.src, w.depth+1 FROM walk w JOIN dep d ON d.dst=w.node WHERE w.depth<8),
clo AS MATERIALIZED (SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM walk WHERE node<>root GROUP BY 1,2),
fstw AS (SELECT package_id, arg_min(id, (published_at,id)) AS version_id, arg_min(semver,(published_at,id)) AS semver, min(published_at) AS published_at
  FROM ver WHERE compromised_window GROUP BY 1),
malv AS (SELECT package_id, arg_max(exact_version, CAST(split_part(exact_version,'.',1) AS BIGINT)*1000000+CAST(split_part(exact_version,'.',2) AS BIGINT)*1000+CAST(split_part(exact_version,'.',3) AS BIGINT)) AS semver
  FROM adv WHERE exact_version IS NOT NULL GROUP BY 1),
newest AS (SELECT package_id, arg_max(semver,num) AS semver FROM ver GROUP BY 1),
bad AS MATERIALIZED (SELECT p.id AS package_id, coalesce(m.semver,w.semver,n.semver) AS bad_version,
  CASE WHEN m.semver IS NOT NULL THEN 'malicious' WHEN w.semver IS NOT NULL THEN 'windowed' WHEN n.semver IS NOT NULL THEN 'newest' END AS source,
  v.id AS version_id, coalesce(v.compromised_window, coalesce(m.semver,w.semver,n.semver) IS NOT NULL) AS windowed, v.published_at,
  CAST(split_part(coalesce(m.semver,w.semver,n.semver),'.',1) AS BIGINT)*1000000+CAST(split_part(coalesce(m.semver,w.semver,n.semver),'.',2) AS BIGINT)*1000+CAST(split_part(coalesce(m.semver,w.semver,n.semver),'.',3) AS BIGINT) AS num
  FROM pkg p LEFT JOIN malv m ON m.package_id=p.id LEFT JOIN fstw w ON w.package_id=p.id LEFT JOIN newest n ON n.package_id=p.id
  LEFT JOIN ver v ON v.package_id=p.id AND v.semver=coalesce(m.semver,w.semver,n.semver)),
inc AS (SELECT b.package_id AS root, b.bad_version, b.num FROM bad b JOIN roots r ON r.root=b.package_id),
rng AS (SELECT constraint_, constraint_<>'lockfile' AS valid, regexp_extract(constraint_,'^([^0-9]*)',1) AS op,
  regexp_replace(constraint_,'^[^0-9]*','') AS base,
  CAST(nullif(regexp_extract(constraint_,'(\\d+)\\.(\\d+)\\.(\\d+)$',1),'') AS BIGINT) AS ma,
  CAST(nullif(regexp_extract(constraint_,'(\\d+)\\.(\\d+)\\.(\\d+)$',2),'') AS BIGINT) AS mi,
  CAST(nullif(regexp_extract(constraint_,'(\\d+)\\.(\\d+)\\.(\\d+)$',3),'') AS BIGINT) AS pa
  FROM (SELECT DISTINCT constraint_ FROM dep)),
span AS (SELECT constraint_, valid, op, base, ma, mi, pa, ma*1000000+mi*1000+pa AS lo,
  CASE op WHEN '^' THEN (ma+1)*1000000 WHEN '~' THEN ma*1000000+(mi+1)*1000 WHEN '>=' THEN 9000000000 ELSE ma*1000000+mi*1000+pa+1 END AS hi FROM rng),
gate AS MATERIALIZED (SELECT i.root, d.src AS node, bool_and(s.valid AND NOT (i.num>=s.lo AND i.num<s.hi)) AS gated,
  min(CASE WHEN s.valid AND NOT (i.num>=s.lo AND i.num<s.hi) THEN d.constraint_ END) AS first_out
  FROM inc i JOIN dep d ON d.dst=i.root JOIN span s ON s.constraint_=d.constraint_ GROUP BY 1,2),
pins AS MATERIALIZED (SELECT i.root, r.src AS node, r.dst AS version_id, v.semver, v.compromised_window OR v.semver=i.bad_version AS windowed
  FROM inc i JOIN ver v ON v.package_id=i.root JOIN res r ON r.dst=v.id WHERE r.src>=5000000000000),
clean AS (SELECT root,node FROM pins GROUP BY 1,2 HAVING NOT bool_or(windowed)),
gwalk AS (SELECT root, root AS node, 0 AS depth FROM inc
  UNION SELECT w.root, d.src, w.depth+1 FROM gwalk w JOIN dep d ON d.dst=w.node
  WHERE w.depth<6 AND NOT EXISTS (SELECT 1 FROM clean c WHERE c.root=w.root AND c.node=d.src)
  AND NOT (w.depth=0 AND EXISTS (SELECT 1 FROM gate g WHERE g.root=w.root AND g.node=d.src AND g.gated))),
gclo AS MATERIALIZED (SELECT root,node,CAST(min(depth) AS BIGINT) AS depth FROM gwalk WHERE node<>root GROUP BY 1,2),
fleet AS (SELECT (SELECT count(*) FROM svc) AS total_services, (SELECT count(*) FROM svc WHERE criticality='tier-1') AS tier1_services,
  (SELECT count(*) FROM lock) AS total_lockfiles),
blast AS (SELECT r.root, count(c.node) FILTER (c.node<2000000000000) AS exposed_packages,
  count(c.node) FILTER (c.node>=4000000000000 AND c.node<5000000000000) AS exposed_services, count(c.node) FILTER (c.node>=5000000000000) AS exposed_lockfiles,
  count(s.id) AS tier1_exposed FROM roots r LEFT JOIN clo c ON c.root=r.root AND c.depth<=6
  LEFT JOIN svc s ON s.id=c.node AND s.criticality='tier-1' GROUP BY 1),
rblast AS (SELECT r.root, count(c.node) FILTER (c.node<2000000000000) AS exposed_packages,
  count(c.node) FILTER (c.node>=4000000000000 AND c.node<5000000000000) AS exposed_services, count(c.node) FILTER (c.node>=5000000000000) AS exposed_lockfiles,
  count(s.id) AS tier1_exposed, count(c.node) AS exposed_nodes FROM roots r LEFT JOIN gclo c ON c.root=r.root
  LEFT JOIN svc s ON s.id=c.node AND s.criticality='tier-1' GROUP BY 1)
"""


def sql(body: str, *extra: str) -> str:
    """A complete statement: the shared tables, further named tables, the query."""
    return "WITH RECURSIVE " + ",\n".join([TABLES.strip(), *(e.strip() for e in extra)]) + "\n" + body.strip()


def query(name: str, oracle: str | None = None):
    """Register ``fn(graph)`` under ``name``."""

    def register(fn: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(graph_for(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
