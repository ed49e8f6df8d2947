"""Lookups and whole-graph reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema as X
from faultline.sources.binding import Graph


#: Stored properties by label and edge type; sort keys and other derived index columns are none.
NODE_PROPERTIES = {
    X.PACKAGE: ("ecosystem", "downloads_weekly", "latest_version", "last_published_at", "is_compromised"),
    X.VERSION: ("package_id", "package_name", "semver", "published_at", "compromised_window"),
    X.MAINTAINER: (),
    X.SERVICE: ("criticality",),
    X.LOCKFILE: ("service_id", "generated_at"),
}
EDGE_PROPERTIES = {
    X.DEPENDS_ON: ("constraint_",), X.MAINTAINED_BY: ("since",), X.RESOLVED_IN: ("resolved_version",),
    X.TYPOSQUAT_OF: ("edit_distance", "similarity_score"),
}
INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _with_properties(rows: DataFrame, properties: tuple[str, ...]) -> DataFrame:
    """Adds ``properties``: JSON of those that are not null, with their types."""
    text = F.to_json(F.struct(*properties), {"timestampNTZFormat": INSTANT, "timestampFormat": INSTANT}) if properties else F.lit("{}")
    return rows.withColumn("properties", text)


def label_scan(graph: Graph, label: str, limit: int | None = None) -> DataFrame:
    """All nodes of one label: label, id, name, every stored property in its own type, and all of them as JSON."""
    table = {X.PACKAGE: graph.package, X.VERSION: graph.version, X.MAINTAINER: graph.maintainer, X.SERVICE: graph.service, X.LOCKFILE: graph.lockfile}[label]
    out = _with_properties(table, NODE_PROPERTIES[label]).select(F.lit(label).alias("label"), "id", "name", *NODE_PROPERTIES[label], "properties")
    return out if limit is None else out.limit(limit)


def node_rows(graph: Graph) -> DataFrame:
    """All nodes as one relation; a property that a label lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [label_scan(graph, label) for label in X.LABELS])


def edge_scan(graph: Graph, edge_type: str, limit: int | None = None) -> DataFrame:
    """All edges of one type: type, eid, src, dst, every stored property in its own type, and all of them as JSON."""
    table = {X.DEPENDS_ON: graph.depends_on, X.MAINTAINED_BY: graph.maintained_by, X.RESOLVED_IN: graph.resolved_in, X.TYPOSQUAT_OF: graph.typosquat_of}[edge_type]
    own = EDGE_PROPERTIES[edge_type]
    out = _with_properties(table, own).select(
        F.lit(edge_type).alias("type"), X.edge_id(edge_type, F.col("src"), F.col("dst")).alias("eid"), "src", "dst", *own, "properties"
    )
    return out if limit is None else out.limit(limit)


def edge_rows(graph: Graph) -> DataFrame:
    """All edges of the public types as one relation."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [edge_scan(graph, kind) for kind in X.PUBLIC_EDGES])


def node_lookup(graph: Graph, node_id: int) -> DataFrame:
    """One node by id; the id range selects the label, the filter reaches the scan."""
    for label in X.LABELS:
        low = graph.ids.base(label)
        if low <= node_id < low + graph.ids.span:
            return label_scan(graph, label).where(F.col("id") == node_id)
    return label_scan(graph, X.PACKAGE).where(F.lit(False))


def hydrate(graph: Graph, wanted: DataFrame) -> DataFrame:
    """Name every wanted id; an id without a stored node keeps a placeholder."""
    placeholder = F.concat(F.lit("node-"), F.col("id").cast("string"))
    return (
        wanted.select("id")
        .distinct()
        .join(graph.nodes(), "id", "left")
        .select("id", graph.ids.label_of(F.col("id")).alias("label"), F.coalesce("name", placeholder).alias("name"))
    )


def resolve_packages(graph: Graph, requests: DataFrame) -> DataFrame:
    """Resolve texts (column ``request``) to packages: id, else name, else prefix.

    Each package offers its prefixes of the lengths requested, reduced to the
    lowest id per prefix, so the prefix search is an equality join.
    """
    asked = requests.select("request").distinct()
    by_id = asked.withColumn("id", F.col("request").try_cast("bigint")).join(
        graph.package.select("id"), "id", "left_semi"
    ).select("request", "id", F.lit(1).alias("how"))
    by_name = asked.join(
        graph.package.groupBy(F.col("name").alias("request")).agg(F.min("id").alias("id")), "request"
    ).select("request", "id", F.lit(2).alias("how"))
    # the lengths in use are few: a name has at most a few hundred characters
    lengths = asked.agg(F.collect_set(F.length("request"))).scalar()
    prefixes = (
        graph.package.withColumn("lengths", lengths)
        .select("id", "name", F.explode(F.filter("lengths", lambda n: (n > 0) & (n <= F.length("name")))).alias("n"))
        .groupBy(F.substring("name", F.lit(1), F.col("n")).alias("request"))
        .agg(F.min("id").alias("id"))
    )
    by_prefix = asked.join(prefixes, "request").select("request", "id", F.lit(3).alias("how"))
    return (
        by_id.unionByName(by_name)
        .unionByName(by_prefix)
        .groupBy("request")
        .agg(F.min_by("id", "how").alias("id"), F.min("how").alias("how"))
        .join(graph.package.select("id", "name"), "id")
        .select("request", "id", "name", "how")
    )


def package_keys(graph: Graph) -> DataFrame:
    ecosystem = F.coalesce("ecosystem", F.lit(X.DEFAULT_ECOSYSTEM))
    return (
        graph.package.where("name IS NOT NULL")
        .select(ecosystem.alias("ecosystem"), "name")
        .distinct()
        .withColumn("key", X.natural_key(X.PACKAGE, F.col("ecosystem"), F.col("name")))
        .orderBy("ecosystem", "name")
    )


def inverse(edges: DataFrame, inverse_type: str) -> DataFrame:
    """Mirror of an edge set; an edge from a node to itself has no inverse."""
    return edges.where("src <> dst").select(
        F.lit(inverse_type).alias("type"), F.col("dst").alias("src"), F.col("src").alias("dst")
    )


def graph_stats(graph: Graph) -> DataFrame:
    """Counts per label and edge type, totals and compromised packages."""
    parts = [
        (label, label_scan(graph, label).agg(F.count(F.lit(1)).alias("value"))) for label in X.LABELS
    ] + [
        (X.DEPENDS_ON, graph.depends_on.agg(F.count(F.lit(1)).alias("value"))),
        (X.MAINTAINED_BY, graph.maintained_by.agg(F.count(F.lit(1)).alias("value"))),
        (X.RESOLVED_IN, graph.resolved_in.agg(F.count(F.lit(1)).alias("value"))),
        (X.TYPOSQUAT_OF, graph.typosquat_of.agg(F.count(F.lit(1)).alias("value"))),
        ("compromised", graph.package.agg(F.count_if("is_compromised").alias("value"))),
    ]
    counts = None
    for name, df in parts:
        row = df.select(F.lit(name).alias("metric"), "value")
        counts = row if counts is None else counts.unionByName(row)
    group = (
        F.when(F.col("metric").isin(*X.LABELS), "total_nodes")
        .when(F.col("metric").isin(*X.PUBLIC_EDGES), "total_edges")
    )
    totals = counts.where(group.isNotNull()).groupBy(group.alias("metric")).agg(F.sum("value").alias("value"))
    return counts.unionByName(totals)


def fleet(graph: Graph) -> DataFrame:
    """One row: services, tier-1 services and lockfiles."""
    return graph.service.agg(
        F.count(F.lit(1)).alias("total_services"),
        F.count_if(X.is_tier1(F.col("criticality"))).alias("tier1_services"),
    ).withColumn("total_lockfiles", graph.lockfile.agg(F.count(F.lit(1))).scalar())


def graph_head(graph: Graph, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first nodes by id and the public edges with both ends among them."""
    head = graph.scratch.keep(graph.nodes().orderBy("id").limit(limit), "head")
    kept = head.select("id")
    edges = (
        graph.public_edges()
        .join(kept.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")
    )
    return head, edges


def service_lockfiles(graph: Graph) -> DataFrame:
    """(service, lockfile) pairs from edges of either orientation."""
    def pairs(service: str, lockfile: str) -> DataFrame:
        return graph.depends_on.where(
            graph.ids.is_label(F.col(service), X.SERVICE) & graph.ids.is_label(F.col(lockfile), X.LOCKFILE)
        ).select(F.col(service).alias("service_id"), F.col(lockfile).alias("lockfile_id"))

    return pairs("src", "dst").unionByName(pairs("dst", "src")).distinct()


def direct_dependents(graph: Graph, targets: DataFrame) -> DataFrame:
    """Edges into each target (column ``root``) with their constraint."""
    return targets.select("root").join(
        graph.depends_on.select(F.col("dst").alias("root"), F.col("src").alias("dependent"), "constraint_"), "root"
    )


def neighbours(graph: Graph) -> DataFrame:
    """(id, neighbour, label, name, edges): every node beside every node, named, with the edges that join them."""
    edges = graph.public_edges().where("src <> dst")
    beside = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).unionByName(
        edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"))
    ).groupBy("id", "neighbour").agg(F.count(F.lit(1)).alias("edges"))
    names = graph.nodes().select(F.col("id").alias("neighbour"), "name")
    return beside.join(names, "neighbour", "left").select("id", "neighbour", graph.ids.label_of(F.col("neighbour")).alias("label"), "name", "edges")


def importance(graph: Graph) -> DataFrame:
    """Dependents and the blended popularity score of every node."""
    indegree = graph.depends_on.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("dependents"))
    scored = (
        graph.nodes()
        .select("id")
        .join(graph.package.select("id", "downloads_weekly"), "id", "left")
        .join(indegree, "id", "left")
        .select(
            "id",
            F.coalesce("dependents", F.lit(0)).alias("dependents"),
            F.coalesce("downloads_weekly", F.lit(0)).alias("downloads"),
        )
    )
    topped = scored.withColumn("_dl", graph.package.agg(F.log1p(F.max("downloads_weekly"))).scalar()).withColumn(
        "_dep", indegree.agg(F.log1p(F.max("dependents"))).scalar()
    )

    def part(value: str, top: str) -> Column:
        return F.when(F.col(top) > 0, F.log1p(value) / F.col(top)).otherwise(F.lit(0.0))

    score = F.least(F.lit(1.0), 0.55 * part("downloads", "_dl") + 0.65 * part("dependents", "_dep"))
    return topped.select("id", "dependents", F.round(score, 4).alias("importance"))


def near_breach(versions: DataFrame, hours: int) -> DataFrame:
    """Window membership by interval: published in [breach, breach + hours)."""
    breach = versions.where("compromised_window").groupBy("package_id").agg(F.min("published_at").alias("_breach"))
    inside = (F.col("published_at") >= F.col("_breach")) & (
        F.col("published_at") < F.col("_breach") + F.expr(f"INTERVAL {int(hours)} HOURS")
    )
    return versions.join(breach, "package_id", "left").select(
        "id", "package_id", "semver", F.col("compromised_window").alias("flagged"),
        F.coalesce(inside, F.lit(False)).alias("near_breach"),
    )


def exposure_flags(graph: Graph, closure: DataFrame) -> DataFrame:
    """Packages, services and lockfiles: exposed by how many roots, and patchable or not."""
    hit = closure.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("exposing_roots"))
    root = graph.roots.select(F.col("root").alias("id"), F.lit(True).alias("_root"))
    nodes = (
        graph.package.select("id", "is_compromised")
        .unionByName(graph.service.select("id"), allowMissingColumns=True)
        .unionByName(graph.lockfile.select("id"), allowMissingColumns=True)
    )
    exposed = F.col("exposing_roots") > 0
    label = graph.ids.label_of(F.col("id"))
    is_root_or_bad = F.coalesce("is_compromised", F.lit(False)) | F.col("_root").isNotNull()
    return (
        nodes.join(hit, "id", "left")
        .join(root, "id", "left")
        .fillna(0, ["exposing_roots"])
        .select(
            "id",
            label.alias("label"),
            "exposing_roots",
            exposed.alias("exposed"),
            F.when(label == X.PACKAGE, is_root_or_bad).otherwise(exposed).alias("patchable"),
        )
    )


def resolved_while_live(graph: Graph) -> DataFrame:
    """Lockfiles that pinned a release published inside the compromise window."""
    windowed = graph.version.where("compromised_window").select(
        F.col("id").alias("dst"), F.col("package_id").alias("root"), "published_at"
    )
    owners = graph.lockfile.select(F.col("id").alias("lockfile_id"), "service_id", "generated_at")
    return (
        graph.resolved_in.where(graph.ids.is_label(F.col("src"), X.LOCKFILE))
        .join(windowed, "dst")
        .withColumnRenamed("src", "lockfile_id")
        .join(owners, "lockfile_id")
        .select(
            "root", "lockfile_id", "service_id", F.col("resolved_version").alias("semver"),
            (F.col("generated_at") >= F.col("published_at")).alias("after_publish"),
        )
    )
