"""Version keys, ranges, history, safe and bad versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import schema as X
from faultline.catalog.registry import query, sql
from faultline.functions import semver as V
from faultline.functions import sql as Q
from faultline.operators import versions as N
from faultline.operators.ordering import rank_within
from faultline.operators.scans import INSTANT
from faultline.sources.binding import Graph


@query("semver_keys", sql("""
SELECT semver, CAST(split_part(semver,'.',1) AS BIGINT) AS major, CAST(split_part(semver,'.',2) AS BIGINT) AS minor,
CAST(split_part(semver,'.',3) AS BIGINT) AS patch, true AS released, true AS agrees, row_number() OVER (ORDER BY num) AS position
FROM (SELECT DISTINCT semver, num FROM ver)"""))
def semver_keys(g: Graph) -> DataFrame:
    """Strict and lenient keys of every distinct release text, in version order."""
    keyed = N.keys_of(g.version, "semver").withColumn("lenient", V.lenient_key(F.col("semver")))
    ranked = rank_within(keyed.withColumn("all", F.lit(1)), ["all"], [F.asc("key")], g.scratch, "position")
    return ranked.select(
        "semver", *[V.component(F.col("semver"), i).alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))],
        V.is_release(F.col("key")).alias("released"), (F.col("lenient") == F.col("key")).alias("agrees"), "position",
    )


@query("range_comparators", sql("""
SELECT constraint_, valid, CASE WHEN NOT valid THEN NULL
 WHEN op='^' THEN concat('>=',base,' <',ma+1,'.0.0-0') WHEN op='~' THEN concat('>=',base,' <',ma,'.',mi+1,'.0-0')
 WHEN op='>=' THEN concat('>=',base) ELSE concat('=',base) END AS comparators FROM rng"""))
def range_comparators(g: Graph) -> DataFrame:
    return N.ranges_of(g.depends_on).select(
        "constraint_", F.col("sets").isNotNull().alias("valid"), V.sets_text(F.col("sets")).alias("comparators")
    )


@query("semver_satisfies", sql("""
SELECT v.semver, s.constraint_, coalesce(v.num>=s.lo AND v.num<s.hi,false) AS inside, count(*) AS edges
FROM dep d JOIN ver v ON v.package_id=d.dst AND v.compromised_window JOIN span s ON s.constraint_=d.constraint_ GROUP BY 1,2,3"""))
def semver_satisfies(g: Graph) -> DataFrame:
    """Every windowed release against every constraint on its package."""
    met = g.depends_on.join(
        g.version.where("compromised_window").select(F.col("package_id").alias("dst"), "semver"), "dst"
    ).groupBy("semver", "constraint_").agg(F.count(F.lit(1)).alias("edges"))
    return met.join(N.keys_of(met, "semver"), "semver").join(N.ranges_of(met), "constraint_").select(
        "semver", "constraint_", V.satisfies(F.col("key"), F.col("sets")).alias("inside"), "edges"
    )


@query("sql_functions", sql("""
SELECT v.semver, d.constraint_, coalesce(v.num>=s.lo AND v.num<s.hi,false) AS inside, f.f AS folded, v.num AS num
FROM dep d JOIN ver v ON v.package_id=d.dst AND v.compromised_window JOIN span s ON s.constraint_=d.constraint_ JOIN fold f ON f.id=v.package_id"""))
def sql_functions(g: Graph) -> DataFrame:
    """Windowed releases against the constraints on their package, folded names and version numbers, all written in SQL."""
    Q.register(g.spark, g.depends_on, g.scratch)
    for name in ("package", "version", "depends_on"):
        getattr(g, name).createOrReplaceTempView(f"graph_{name}")
    return g.spark.sql("""
        SELECT v.semver, d.constraint_, satisfies(v.semver, d.constraint_) AS inside, normalize_name(p.name) AS folded,
            CASE WHEN semver_key(v.semver) = v.strict AND semver_lenient_key(v.semver) = v.lenient
                THEN bigint(split_part(v.semver, '.', 1)) * 1000000 + bigint(split_part(v.semver, '.', 2)) * 1000 + bigint(split_part(v.semver, '.', 3)) END AS num
        FROM graph_depends_on d JOIN graph_version v ON v.package_id = d.dst AND v.compromised_window JOIN graph_package p ON p.id = v.package_id""")


@query("max_satisfying", sql("""
SELECT d.dst AS package_id, d.constraint_, (SELECT arg_max(v.semver,v.num) FROM ver v WHERE v.package_id=d.dst AND v.num>=s.lo AND v.num<s.hi) AS semver
FROM (SELECT DISTINCT dst, constraint_ FROM dep WHERE dst<2000000000000) d JOIN span s ON s.constraint_=d.constraint_"""))
def max_satisfying(g: Graph) -> DataFrame:
    return N.max_satisfying(
        g.depends_on.join(g.package.select(F.col("id").alias("dst")), "dst", "left_semi").select(
            F.col("dst").alias("package_id"), "constraint_"
        ),
        g.version,
        g.scratch,
    )


@query("version_history", sql("""
SELECT package_id, id, semver, row_number() OVER (PARTITION BY package_id ORDER BY num DESC, id) AS rank FROM ver"""))
def version_history(g: Graph) -> DataFrame:
    return N.history(g.version, g.scratch)


@query("version_history_by_date", sql("""
SELECT package_id, id, semver, strftime(published_at,'%Y-%m-%dT%H:%M:%S.%f') AS published_at,
row_number() OVER (PARTITION BY package_id ORDER BY published_at DESC, semver DESC) AS rank FROM ver"""))
def version_history_by_date(g: Graph) -> DataFrame:
    return N.history_by_date(g.version, g.scratch).select(
        "package_id", "id", "semver", F.date_format("published_at", INSTANT).alias("published_at"), "rank"
    )


@query("first_windowed", sql("""
SELECT package_id, version_id, semver, strftime(published_at,'%Y-%m-%dT%H:%M:%S.%f') AS published_at FROM fstw"""))
def first_windowed(g: Graph) -> DataFrame:
    return N.first_windowed(g.version).select(
        "package_id", "version_id", "semver", F.date_format("published_at", INSTANT).alias("published_at")
    )


def chosen(g: Graph) -> DataFrame:
    return g.kept("bad_version", lambda: N.bad_version(g.package, g.version, g.advisory))


def incidents(g: Graph) -> DataFrame:
    """(root, bad_version) of every package with a windowed release."""
    def build() -> DataFrame:
        asked = g.package_ids.join(g.roots.select(F.col("root").alias("id")), "id", "left_semi")
        return N.bad_version(asked, g.root_version, g.advisory).select(
            F.col("package_id").alias("root"), "bad_version", "windowed", "published_at"
        )

    return g.kept("incidents", build)


@query("bad_version", sql("""
SELECT package_id, bad_version, source, version_id, windowed, strftime(published_at,'%Y-%m-%dT%H:%M:%S.%f') AS published_at FROM bad"""))
def bad_version(g: Graph) -> DataFrame:
    return chosen(g).select(
        "package_id", "bad_version", "source", "version_id", "windowed", F.date_format("published_at", INSTANT).alias("published_at")
    )


REQUESTED = """
req AS MATERIALIZED (SELECT v.package_id, CASE WHEN v.package_id%7=0 THEN '99.0.0' ELSE min(p.resolved_version) END AS semver FROM pin p JOIN ver v ON v.id=p.dst GROUP BY 1)"""


@query("bad_version_requested", sql("""
SELECT b.package_id, coalesce(q.semver,b.bad_version) AS bad_version, CASE WHEN q.semver IS NOT NULL THEN 'requested' ELSE b.source END AS source, v.id AS version_id,
coalesce(v.compromised_window, coalesce(q.semver,b.bad_version) IS NOT NULL) AS windowed
FROM bad b LEFT JOIN req q ON q.package_id=b.package_id LEFT JOIN ver v ON v.package_id=b.package_id AND v.semver=coalesce(q.semver,b.bad_version)""", REQUESTED))
def bad_version_requested(g: Graph) -> DataFrame:
    """Each package that a lockfile pins is asked about by its least pinned text, some by a version that nobody recorded."""
    pinned = g.resolved_in.where(g.ids.is_label(F.col("src"), X.LOCKFILE)).join(g.version.select(F.col("id").alias("dst"), "package_id"), "dst")
    least = pinned.groupBy("package_id").agg(F.min("resolved_version").alias("semver"))
    requested = least.withColumn("semver", F.when(F.col("package_id") % 7 == 0, "99.0.0").otherwise(F.col("semver")))
    return N.bad_version(g.package, g.version, g.advisory, requested).select("package_id", "bad_version", "source", "version_id", "windowed")


SAFE = """
safe AS MATERIALIZED (SELECT b.package_id, b.bad_version, arg_max(v.semver,v.num) FILTER (v.num<b.num AND NOT v.compromised_window) AS safe_version,
  arg_max(v.published_at,v.num) FILTER (v.num<b.num AND NOT v.compromised_window) AS safe_published_at,
  CASE WHEN b.num IS NULL THEN 'unordered' WHEN count(v.id)=0 THEN 'unrecorded' WHEN count(v.id) FILTER (v.num<b.num)=0 THEN 'nothing_below'
   WHEN count(v.id) FILTER (v.num<b.num AND NOT v.compromised_window)=0 THEN 'all_windowed' ELSE 'found' END AS reason,
  count(v.id) FILTER (v.num<b.num AND v.compromised_window) AS skipped
  FROM bad b LEFT JOIN ver v ON v.package_id=b.package_id GROUP BY b.package_id, b.bad_version, b.num)"""


def safe(g: Graph) -> DataFrame:
    return g.kept("safe_version", lambda: N.safe_version(chosen(g), g.version))


@query("safe_version", sql("SELECT package_id, bad_version, safe_version, strftime(safe_published_at,'%Y-%m-%dT%H:%M:%S.%f') AS safe_published_at, reason, skipped FROM safe", SAFE))
def safe_version(g: Graph) -> DataFrame:
    return safe(g).select(
        "package_id", "bad_version", "safe_version", F.date_format("safe_published_at", INSTANT).alias("safe_published_at"), "reason", "skipped"
    )
