"""Lockfile corpora, registry documents, ids, upserts and the whole ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema as X
from faultline.catalog.advisories import OSV, parsed as advisory_rows
from faultline.catalog.registry import query, sql
from faultline.operators import upsert as U
from faultline.plans import ingest as P
from faultline.session import together
from faultline.sources import corpus as C
from faultline.sources import lockfiles as L
from faultline.sources import registry as G_
from faultline.sources.binding import Graph

INSTALLS = """
dpp2 AS (SELECT src,dst,constraint_ FROM dep WHERE src<2000000000000 AND dst<2000000000000),
rels AS MATERIALIZED (SELECT *, max(slot) OVER (PARTITION BY lock) AS width FROM (SELECT lock, concat('order-',lock-5000000000000) AS doc, package_id, name, semver AS version, row_number() OVER (PARTITION BY lock,package_id ORDER BY vid)-1 AS rank,
  dense_rank() OVER (PARTITION BY lock ORDER BY package_id) AS slot
  FROM (SELECT DISTINCT p.src AS lock, v.id AS vid, v.package_id, k.name, v.semver FROM pin p JOIN ver v ON v.id=p.dst JOIN pkg k ON k.id=v.package_id))),
inst AS MATERIALIZED (SELECT lock, doc, package_id, name, version AS top FROM rels WHERE rank=0),
decl AS MATERIALIZED (SELECT i.doc, i.package_id, i.name, d.constraint_, i.top, i.package_id%3=0 AS dev FROM inst i JOIN dep d ON d.src=i.lock AND d.dst=i.package_id),
arcs AS MATERIALIZED (SELECT s.doc, s.package_id AS src, s.name AS src_name, s.version AS src_version, CASE WHEN s.rank=0 THEN s.slot ELSE (s.rank-1)%s.width+1 END AS below, t.package_id AS dst, t.name AS dst_name, t.top, d.constraint_
  FROM dpp2 d JOIN rels s ON s.package_id=d.src JOIN inst t ON t.doc=s.doc AND t.package_id=d.dst)"""

FLAT = """
nedge AS MATERIALIZED (SELECT doc, CAST(NULL AS VARCHAR) AS src_name, CAST(NULL AS VARCHAR) AS src_version, name AS dst_name, constraint_, top AS dst_version, dev FROM decl
  UNION ALL SELECT a.doc, a.src_name, a.src_version, a.dst_name, a.constraint_, coalesce(n.version,a.top), a.src%3=0 FROM arcs a
  LEFT JOIN rels n ON n.doc=a.doc AND n.package_id=a.dst AND n.rank=a.below)"""

NPM = """
SELECT 'release' AS kind, r.doc, CAST(NULL AS VARCHAR) AS src, r.name AS dst, CAST(NULL AS VARCHAR) AS constraint_, r.version, r.package_id%3=0 AS dev,
 EXISTS (SELECT 1 FROM decl d WHERE d.doc=r.doc AND d.package_id=r.package_id AND d.top=r.version) AS direct FROM rels r
UNION ALL SELECT 'edge', doc, concat_ws('@',src_name,src_version), dst_name, constraint_, dst_version, bool_and(dev), false FROM nedge GROUP BY doc, src_name, src_version, dst_name, constraint_, dst_version"""

# yarn and pnpm resolve every dependency to the first release of its package
SHARED = """
yarc AS MATERIALIZED (SELECT doc, src_name, src_version, dst_name, constraint_, top AS dst_version FROM arcs),
hit_(doc,name,version,dev) AS (SELECT doc, name, top, dev FROM decl UNION SELECT h.doc, y.dst_name, y.dst_version, h.dev FROM hit_ h JOIN yarc y ON y.doc=h.doc AND y.src_name=h.name AND y.src_version=h.version),
devonly AS (SELECT doc,name,version FROM hit_ GROUP BY 1,2,3 HAVING bool_and(dev))"""


def _shared(constraint: str) -> str:
    return f"""
SELECT 'release' AS kind, r.doc, CAST(NULL AS VARCHAR) AS src, r.name AS dst, CAST(NULL AS VARCHAR) AS constraint_, r.version,
 EXISTS (SELECT 1 FROM devonly o WHERE o.doc=r.doc AND o.name=r.name AND o.version=r.version) AS dev,
 EXISTS (SELECT 1 FROM decl d WHERE d.doc=r.doc AND d.package_id=r.package_id AND d.top=r.version) AS direct FROM rels r
UNION ALL SELECT 'edge', doc, NULL, name, constraint_, top, dev, false FROM decl
UNION ALL SELECT 'edge', y.doc, concat(src_name,'@',src_version), dst_name, {constraint}, dst_version,
 EXISTS (SELECT 1 FROM devonly o WHERE o.doc=y.doc AND o.name=y.src_name AND o.version=y.src_version), false FROM yarc y"""


def _rows(found: L.Parsed) -> DataFrame:
    none = F.lit(None).cast("string")
    releases = found.releases.select(
        F.lit("release").alias("kind"), "doc", none.alias("src"), F.col("name").alias("dst"), none.alias("constraint_"), "version", "dev", "direct"
    )
    edges = found.edges.select(
        F.lit("edge").alias("kind"), "doc",
        F.when(F.col("src_name").isNotNull(), F.concat_ws("@", "src_name", "src_version")).alias("src"),
        F.col("dst_name").alias("dst"), "constraint_", F.col("dst_version").alias("version"), "dev", F.lit(False).alias("direct"),
    )
    return releases.unionByName(edges)


def _blank_root(text: str) -> str:
    return text.replace("concat_ws('@',src_name,src_version)", "CASE WHEN src_name IS NOT NULL THEN concat(src_name,'@',src_version) END")


def npm(g: Graph) -> L.Parsed:
    def build() -> L.Parsed:
        found = L.parse_npm(C.npm_documents(g), g.scratch)
        return L.Parsed(g.scratch.keep(found.releases, "npm-releases"), found.edges)

    return g.once("npm", build)


@query("lock_npm", sql(_blank_root(NPM), INSTALLS, FLAT))
def lock_npm(g: Graph) -> DataFrame:
    return _rows(npm(g))


@query("lock_npm_v1", sql(_blank_root(NPM), INSTALLS, FLAT))
def lock_npm_v1(g: Graph) -> DataFrame:
    return _rows(L.parse_npm_v1(C.npm_v1_documents(g), g.scratch))


@query("lock_yarn", sql(_shared("constraint_"), INSTALLS, SHARED))
def lock_yarn(g: Graph) -> DataFrame:
    return _rows(L.parse_yarn(C.yarn_documents(g), g.scratch))


@query("lock_pnpm", sql(f"SELECT DISTINCT * FROM ({_shared('dst_version')})", INSTALLS, SHARED))
def lock_pnpm(g: Graph) -> DataFrame:
    return _rows(L.parse_pnpm(C.pnpm_documents(g), g.scratch))


# the older form says itself which package is for development
V6 = """
SELECT 'release' AS kind, r.doc, CAST(NULL AS VARCHAR) AS src, r.name AS dst, CAST(NULL AS VARCHAR) AS constraint_, r.version, r.package_id%3=0 AS dev,
 EXISTS (SELECT 1 FROM decl d WHERE d.doc=r.doc AND d.package_id=r.package_id AND d.top=r.version) AS direct FROM rels r
UNION ALL SELECT 'edge', doc, NULL, name, constraint_, top, dev, false FROM decl
UNION ALL SELECT DISTINCT 'edge', doc, concat(src_name,'@',src_version), dst_name, top, top, src%3=0, false FROM arcs"""


@query("lock_pnpm_v6", sql(V6, INSTALLS))
def lock_pnpm_v6(g: Graph) -> DataFrame:
    return _rows(L.parse_pnpm(C.pnpm_v6_documents(g), g.scratch))


@query("lockfile_files", sql("""
SELECT remote, path, path=concat('svc/',o_orderkey,'/yarn.lock') AS is_lockfile,
 CASE WHEN o_orderkey%5=4 THEN NULL ELSE concat('https://host.example/org/repo-',o_orderkey) END AS address, concat('org/repo-',o_orderkey) AS repository
FROM (SELECT o_orderkey, CASE o_orderkey%5 WHEN 0 THEN concat('git@host.example:org/repo-',o_orderkey,'.git') WHEN 1 THEN concat('ssh://git@host.example/org/repo-',o_orderkey,'.git')
  WHEN 2 THEN concat('https://host.example/org/repo-',o_orderkey,'.git') WHEN 3 THEN concat('git://host.example/org/repo-',o_orderkey) ELSE concat('ftp://host.example/org/repo-',o_orderkey) END AS remote,
  CASE o_orderkey%4 WHEN 0 THEN concat('svc/',o_orderkey,'/yarn.lock') WHEN 1 THEN concat('svc/node_modules/',o_orderkey,'/yarn.lock') WHEN 2 THEN concat('.cache/',o_orderkey,'/yarn.lock') ELSE concat('svc/',o_orderkey,'/package.json') END AS path FROM orders)"""))
def lockfile_files(g: Graph) -> DataFrame:
    """Path recognition and git address spellings over one repository per order."""
    key = F.col("o_orderkey")
    text = key.cast("string")

    def spelled(before: str, after: str = "") -> Column:
        return F.concat(F.lit(before), text, F.lit(after))

    remote = (
        F.when(key % 5 == 0, spelled("git@host.example:org/repo-", ".git"))
        .when(key % 5 == 1, spelled("ssh://git@host.example/org/repo-", ".git"))
        .when(key % 5 == 2, spelled("https://host.example/org/repo-", ".git"))
        .when(key % 5 == 3, spelled("git://host.example/org/repo-"))
        .otherwise(spelled("ftp://host.example/org/repo-"))
    )
    path = (
        F.when(key % 4 == 0, spelled("svc/", "/yarn.lock"))
        .when(key % 4 == 1, spelled("svc/node_modules/", "/yarn.lock"))
        .when(key % 4 == 2, spelled(".cache/", "/yarn.lock"))
        .otherwise(spelled("svc/", "/package.json"))
    )
    repos = g.spark.read.parquet(g.source("orders")).select(remote.alias("remote"), path.alias("path"))
    return repos.select(
        "remote", "path", L.is_lockfile_path(F.col("path")).alias("is_lockfile"),
        G_.https_address(F.col("remote")).alias("address"), G_.repository_name(F.col("remote")).alias("repository"),
    )


@query("manifest_roots", sql("SELECT doc, name AS dst_name, constraint_, dev FROM decl", INSTALLS))
def manifest_roots(g: Graph) -> DataFrame:
    return L.manifest_rows(C.yarn_documents(g))


@query("release_dedupe", sql("""
SELECT concat('order-',l_orderkey) AS doc, concat('part-',l_partkey) AS name, CAST(l_linenumber AS VARCHAR) AS version, bool_and(l_returnflag='N') AS dev,
bool_or(l_linestatus='O') AS direct, CAST(arg_min(l_suppkey,(l_shipdate,l_suppkey)) FILTER (l_tax>0) AS VARCHAR) AS resolved_url, CAST(arg_min(l_suppkey,(l_shipdate,l_suppkey)) AS VARCHAR) AS integrity
FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber"""))
def release_dedupe(g: Graph) -> DataFrame:
    """Line items as repeated sightings of one release."""
    supplier = F.col("l_suppkey").cast("string")
    rows = g.spark.read.parquet(g.source("lineitem")).select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("doc"),
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("name"),
        F.col("l_linenumber").cast("string").alias("version"),
        (F.col("l_returnflag") == "N").alias("dev"), (F.col("l_linestatus") == "O").alias("direct"),
        F.when(F.col("l_tax") > 0, supplier).alias("resolved_url"), supplier.alias("integrity"),
        F.struct("l_shipdate", "l_suppkey").alias("pos"),
    )
    return L.dedupe_releases(rows)


@query("dev_reachability", sql("""
SELECT r.doc, r.name, r.version, EXISTS (SELECT 1 FROM devonly o WHERE o.doc=r.doc AND o.name=r.name AND o.version=r.version) AS dev FROM rels r""", INSTALLS, SHARED))
def dev_reachability(g: Graph) -> DataFrame:
    """Dev flags derived from the rows alone, without a lockfile text."""
    tops = C.installs(g).select("doc", F.col("package_id").alias("dst"), F.col("top").alias("dst_version"))
    both = C.releases(g).select("doc", F.col("package_id").alias("src"), F.col("name").alias("src_name"), F.col("version").alias("src_version"))
    flags = [F.lit(False).alias("dev"), F.lit(False).alias("direct"), F.lit(None).cast("string").alias("resolved_url"), F.lit(None).cast("string").alias("integrity")]
    releases = both.select("doc", F.col("src_name").alias("name"), F.col("src_version").alias("version"), *flags)
    none = F.lit(None).cast("string")
    asked = C.declared(g).join(tops, ["doc", "dst"]).select(
        "doc", none.alias("src_name"), none.alias("src_version"), F.col("name").alias("dst_name"), "constraint_", "dst_version", "dev"
    )
    arcs = C.needs(g).join(both, ["doc", "src"]).join(tops, ["doc", "dst"]).select(
        "doc", "src_name", "src_version", F.col("name").alias("dst_name"), "constraint_", "dst_version", F.lit(False).alias("dev")
    )
    return L.dev_reachability(L.Parsed(releases, asked.unionByName(arcs)), g.scratch).releases.select("doc", "name", "version", "dev")


def lock_table(g: Graph) -> DataFrame:
    """(doc, repo, path, kind): the service owning each rendered lockfile."""
    owners = g.lockfile.select(F.col("id").alias("lock"), "service_id").join(
        g.service.select(F.col("id").alias("service_id"), F.col("name").alias("repo")), "service_id"
    )
    return C.installs(g).select("lock", "doc").distinct().join(owners, "lock").select(
        "doc", "repo", F.concat("doc", F.lit("/package-lock.json")).alias("path"), F.lit("npm").alias("kind")
    )


DEPTHS = """
repo AS (SELECT DISTINCT i.doc, s.name AS repo FROM inst i JOIN lock l ON l.id=i.lock JOIN svc s ON s.id=l.service_id),
names_ AS MATERIALIZED (SELECT DISTINCT r.repo, e.src_name, e.dst_name FROM nedge e JOIN repo r ON r.doc=e.doc),
bfs(repo,name,depth) AS (SELECT repo, dst_name, 1 FROM names_ WHERE src_name IS NULL UNION SELECT b.repo, n.dst_name, b.depth+1 FROM bfs b JOIN names_ n ON n.repo=b.repo AND n.src_name=b.name WHERE b.depth<40)"""


@query("transitive_depth", sql("SELECT repo, name, CAST(min(depth) AS BIGINT) AS transitive_depth FROM bfs GROUP BY 1,2", INSTALLS, FLAT, DEPTHS))
def transitive_depth(g: Graph) -> DataFrame:
    edges = npm(g).edges.join(lock_table(g).select("doc", "repo"), "doc")
    return P.transitive_depths(edges, g.scratch).withColumn("transitive_depth", F.col("transitive_depth").cast("bigint"))


def registry(g: Graph) -> DataFrame:
    def write() -> DataFrame:
        path = g.scratch.path("registry")
        C.registry_documents(g).write.option("compression", "gzip").text(path)
        return G_.read_documents(g.spark, path)

    return g.once("registry", write)


@query("registry_trim", sql("""
SELECT 'owner' AS kind, p.name, t.name AS item, concat(t.name,'@example.org') AS detail FROM mnt m JOIN pkg p ON p.id=m.src JOIN mtn t ON t.id=m.dst
UNION ALL SELECT 'release', p.name, v.semver, strftime(v.published_at,'%Y-%m-%dT%H:%M:%SZ') FROM ver v JOIN pkg p ON p.id=v.package_id
UNION ALL SELECT 'latest', p.name, n.semver, NULL FROM pkg p LEFT JOIN newest n ON n.package_id=p.id"""))
def registry_trim(g: Graph) -> DataFrame:
    documents = registry(g)
    none = F.lit(None).cast("string")
    owners = G_.owners(documents).select(F.lit("owner").alias("kind"), "name", F.col("username").alias("item"), F.col("email").alias("detail"))
    times = G_.publications(documents).select(F.lit("release").alias("kind"), "name", F.col("semver").alias("item"), G_.iso_text(F.col("published_at")).alias("detail"))
    latest = G_.latest_tags(documents).select(F.lit("latest").alias("kind"), "name", F.col("latest").alias("item"), none.alias("detail"))
    return owners.unionByName(times).unionByName(latest)


def metadata(g: Graph) -> P.Metadata:
    def build() -> P.Metadata:
        documents = registry(g)
        feed = g.package.where("NOT is_compromised").select("name", "downloads_weekly")
        facts = {"meta": G_.with_downloads(G_.latest_tags(documents), feed), "publications": G_.publications(documents), "owners": G_.owners(documents)}
        kept = together({name: (lambda name=name: g.scratch.keep(facts[name], name)) for name in facts})
        return P.Metadata(kept["meta"], kept["publications"], kept["owners"])

    return g.once("metadata", build)


@query("enrich", sql("""
SELECT p.name, n.semver AS latest, CASE WHEN p.id NOT IN (SELECT package_id FROM mal) THEN p.downloads_weekly END AS downloads_weekly FROM pkg p LEFT JOIN newest n ON n.package_id=p.id"""))
def enrich(g: Graph) -> DataFrame:
    """Registry rows with downloads; the feed knows only packages that are not compromised."""
    return metadata(g).packages.select("name", "latest", "downloads_weekly")


@query("allocate_ids", sql("""
SELECT k.key, coalesce(o.id, (SELECT max(root) FROM roots)+row_number() OVER (PARTITION BY o.id IS NULL ORDER BY k.key)) AS id, o.id IS NULL AS created
FROM (SELECT concat('npm:',name) AS key, id FROM pkg) k LEFT JOIN (SELECT concat('npm:',p.name) AS key, p.id FROM pkg p JOIN roots r ON r.root=p.id) o ON o.key=k.key"""))
def allocate_ids(g: Graph) -> DataFrame:
    """All package keys against a registry that knows only the compromised ones."""
    key = X.natural_key(X.PACKAGE, F.col("ecosystem"), F.col("name"))
    known = g.package.join(g.roots.select(F.col("root").alias("id")), "id", "left_semi").select(key.alias("key"), "id")
    return U.allocate_ids(g.package.select(key.alias("key")), known, g.ids.base(X.PACKAGE), g.scratch)


@query("upsert_nodes", sql("""
SELECT coalesce(p.id,b.id) AS id, coalesce(b.q,p.downloads_weekly) AS downloads_weekly, coalesce(b.f,p.name) AS name FROM pkg p FULL OUTER JOIN
(SELECT 1000000000000+l_suppkey*50 AS id, arg_max(CAST(l_quantity AS BIGINT),(l_shipdate,l_orderkey,l_linenumber,l_partkey,l_quantity)) FILTER (l_returnflag<>'N') AS q,
 arg_max(l_linestatus,(l_shipdate,l_orderkey,l_linenumber,l_partkey,l_quantity)) FILTER (l_tax>0.05) AS f FROM lineitem GROUP BY 1) b ON b.id=p.id"""))
def upsert_nodes(g: Graph) -> DataFrame:
    """Line items as updates, with nulls, to known and unknown packages."""
    items = g.spark.read.parquet(g.source("lineitem"))
    batch = items.select(
        (F.lit(g.ids.base(X.PACKAGE)) + F.col("l_suppkey") * 50).alias("id"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("bigint")).alias("downloads_weekly"),
        F.when(F.col("l_tax") > 0.05, F.col("l_linestatus")).alias("name"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("seq"),
    )
    return U.upsert_nodes(g.package.select("id", "downloads_weekly", "name"), batch, F.col("seq"))


@query("upsert_edges", sql("""
SELECT coalesce(a.src,b.src) AS src, coalesce(a.dst,b.dst) AS dst, coalesce(b.c,a.constraint_) AS constraint_,
CAST(('0x'||substr(sha1(concat('DEPENDS_ON|',coalesce(a.src,b.src),'|',coalesce(a.dst,b.dst))),1,16))::UBIGINT >> 2 AS BIGINT) AS eid FROM dep a FULL OUTER JOIN
(SELECT 4000000000000+o_custkey AS src, 5000000000000+o_orderkey-o_orderkey%2 AS dst, arg_min(o_orderpriority,(o_orderdate,o_orderkey)) AS c FROM orders GROUP BY 1,2) b ON b.src=a.src AND b.dst=a.dst"""))
def upsert_edges(g: Graph) -> DataFrame:
    """Orders as edge updates, several to one edge; the first of the batch wins."""
    orders = g.spark.read.parquet(g.source("orders"))
    batch = orders.select(
        (F.lit(g.ids.base(X.SERVICE)) + F.col("o_custkey")).alias("src"),
        (F.lit(g.ids.base(X.LOCKFILE)) + F.col("o_orderkey") - F.col("o_orderkey") % 2).alias("dst"),
        F.col("o_orderpriority").alias("constraint_"),
        F.struct("o_orderdate", "o_orderkey").alias("seq"),
    )
    current = g.depends_on.select(X.edge_id(X.DEPENDS_ON, F.col("src"), F.col("dst")).alias("eid"), "src", "dst", "constraint_")
    return U.upsert_edges(current, batch, X.DEPENDS_ON, F.col("seq")).select("src", "dst", "constraint_", "eid")


def scanned(g: Graph) -> tuple[P.Store, DataFrame]:
    def build():
        # none needs another; tables that several read are derived by the first that asks
        made = together({
            "locks": lambda: g.kept("lock_table", lambda: lock_table(g)), "npm": lambda: npm(g),
            "metadata": lambda: metadata(g), "advisories": lambda: advisory_rows(g),
        })
        locks = made["locks"]
        repos = locks.select("repo").distinct().select(
            "repo", F.concat(F.lit("https://host.example/"), "repo").alias("repo_url"), F.lit(None).cast("string").alias("commit_hash")
        )
        scan = P.Scan(repos, locks, made["npm"])
        return P.ingest(P.Store.empty(g.spark), scan, made["metadata"], made["advisories"], g.ids, g.scratch)

    return g.once("ingest", build)


REPORT = """
ing AS MATERIALIZED (SELECT DISTINCT package_id, name FROM inst),
ver_ AS MATERIALIZED (SELECT DISTINCT package_id, name, version FROM rels),
dl AS (SELECT i.package_id, CASE WHEN i.package_id NOT IN (SELECT package_id FROM mal) THEN p.downloads_weekly END AS d, f.f FROM ing i JOIN pkg p ON p.id=i.package_id JOIN fold f ON f.id=i.package_id),
sq AS (SELECT c.package_id AS src, t.package_id AS dst FROM dl c JOIN dl t ON t.d>=1000000 AND c.package_id<>t.package_id AND (c.d IS NULL OR c.d<t.d) AND abs(length(c.f)-length(t.f))<=2 AND levenshtein(c.f,t.f)<=2)"""


@query("ingest_report", sql("""
SELECT 'Service' AS kind, count(DISTINCT repo) AS touched FROM repo UNION ALL SELECT 'Lockfile', count(DISTINCT doc) FROM inst
UNION ALL SELECT 'Package', count(*) FROM ing UNION ALL SELECT 'Version', count(*) FROM ver_
UNION ALL SELECT 'Maintainer', count(DISTINCT dst) FROM mnt WHERE src IN (SELECT package_id FROM ing)
UNION ALL SELECT 'DEPENDS_ON', (SELECT count(DISTINCT doc) FROM inst)+count(*) FROM (SELECT DISTINCT coalesce(e.src_name,concat('service ',r.repo)), e.dst_name FROM nedge e JOIN repo r ON r.doc=e.doc WHERE e.src_name IS DISTINCT FROM e.dst_name)
UNION ALL SELECT 'RESOLVED_IN', (SELECT count(*) FROM ver_)+(SELECT count(*) FROM rels)
UNION ALL SELECT 'MAINTAINED_BY', count(*) FROM mnt WHERE src IN (SELECT package_id FROM ing)
UNION ALL SELECT 'TYPOSQUAT_OF', count(*) FROM sq UNION ALL SELECT 'newly_flagged', count(*) FROM ing WHERE package_id IN (SELECT package_id FROM osv WHERE malicious)""", INSTALLS, FLAT, DEPTHS, OSV, REPORT))
def ingest_report(g: Graph) -> DataFrame:
    return scanned(g)[1]


@query("ingest_packages", sql("""
SELECT i.name, p.d AS downloads_weekly, i.package_id IN (SELECT package_id FROM osv WHERE malicious) AS is_compromised, i.package_id IN (SELECT src FROM sq) AS is_typosquat,
CASE WHEN bool_or(o.malicious) THEN 1.0::DOUBLE ELSE round(least(0.9::DOUBLE,0.05::DOUBLE+0.15::DOUBLE*count(DISTINCT o.id)),4) END AS risk_score
FROM ing i JOIN dl p ON p.package_id=i.package_id LEFT JOIN osv o ON o.package_id=i.package_id GROUP BY i.name, p.d, i.package_id""", INSTALLS, OSV, REPORT))
def ingest_packages(g: Graph) -> DataFrame:
    """Package rows of the store after the ingest."""
    return scanned(g)[0].nodes[X.PACKAGE].select("name", "downloads_weekly", "is_compromised", "is_typosquat", "risk_score")


@query("snapshot_json", sql("""
SELECT 'package' AS "table", count(*) AS rows FROM pkg UNION ALL SELECT 'service', count(*) FROM svc UNION ALL SELECT 'lockfile', count(*) FROM lock
UNION ALL SELECT 'version', count(*) FROM ver UNION ALL SELECT 'maintainer', count(*) FROM mtn UNION ALL SELECT 'depends_on', count(*) FROM dep"""))
def snapshot_json(g: Graph) -> DataFrame:
    tables = {name: getattr(g, name) for name in ("package", "service", "lockfile", "version", "maintainer", "depends_on")}
    return U.write_snapshot(tables, g.scratch.path("snapshot"))
