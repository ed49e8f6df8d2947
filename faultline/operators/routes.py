"""Route enumeration: the first routes per root in (length, node chain) order.

The cap is part of the feature and an argument. Shorter routes sort first, so once a root has
``cap`` routes no longer one can enter its answer and the root leaves the frontier; a root still
short of the cap carries fewer than ``cap`` routes into the next hop. The result is therefore
exact while every step stays bounded. Edges have to be distinct, which makes the chains distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.skew import SplitEdges
from faultline.schema import ROUTE_CAP
from faultline.session import Scratch

SCHEMA = "root bigint, chain array<bigint>, hops int, rank bigint, truncated boolean"


def _lowest_sources(edges: SplitEdges, most: int) -> SplitEdges:
    """The ``most`` lowest sources of every key.

    Chains of one length order by their nodes, so of the extensions of one chain only the lowest
    can enter its root's answer; at most ``depth`` of the sources are on the chain already.
    """
    order = Window.partitionBy(edges.key).orderBy("src")
    kept = edges.edges.withColumn("_lowest", F.row_number().over(order)).where(F.col("_lowest") <= most).drop("_lowest")
    return SplitEdges(kept, edges.key, edges.hot)


def routes(
    edges: SplitEdges,
    roots: DataFrame,
    depth: int,
    scratch: Scratch,
    cap: int | None = ROUTE_CAP,
    *,
    first_hop_blocked: DataFrame | None = None,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """(root, chain, hops, rank, truncated); ``truncated`` tells roots with more than ``cap`` routes.

    ``first_hop_blocked`` (root, node) removes edges out of the root; ``allowed`` (root, node)
    limits the nodes of a chain. One route beyond the cap is sought, which is how more are noticed.
    """
    limit = None if cap is None else cap + 1
    if limit is not None and allowed is None and first_hop_blocked is None:
        edges = _lowest_sources(edges, limit + depth)
    level = roots.select(
        "root", F.col("root").alias("node"), F.array("root").alias("chain"), F.lit(0).cast("bigint").alias("had")
    )
    levels: list[DataFrame] = []
    for hop in range(1, depth + 1):
        step = (
            edges.follow(level, "node")
            .where(~F.array_contains("chain", F.col("src")))
            .select("root", F.col("src").alias("node"), F.concat("chain", F.array("src")).alias("chain"), "had")
        )
        if hop == 1 and first_hop_blocked is not None:
            step = step.join(first_hop_blocked.select("root", "node"), ["root", "node"], "left_anti")
        if allowed is not None:
            step = step.join(allowed.select("root", "node"), ["root", "node"], "left_semi")
        # a rank below a constant lets Spark drop surplus rows before the shuffle
        in_order = Window.partitionBy("root").orderBy("chain")
        step = step.withColumn("_n", F.row_number().over(in_order))
        if limit is not None:
            step = step.where(F.col("_n") <= limit)
        step = step.withColumn("rank", F.col("had") + F.col("_n"))
        if limit is not None:
            step = step.where(F.col("rank") <= limit)
        kept, rows = scratch.keep_counted(
            step.select("root", "node", "chain", F.lit(hop).alias("hops"), "rank"), f"routes{hop}"
        )
        if rows == 0:
            break
        levels.append(kept)
        totals = kept.groupBy("root").agg(F.max("rank").alias("had"))
        if limit is not None:
            totals = totals.where(F.col("had") < limit)
        level = kept.select("root", "node", "chain").join(totals, "root")
    if not levels:
        return roots.sparkSession.createDataFrame([], SCHEMA)
    found = scratch.read_all(levels).select("root", "chain", "hops", "rank")
    if limit is None:
        return found.withColumn("truncated", F.lit(False))
    beyond = found.where(F.col("rank") == limit).select("root", F.lit(True).alias("_more"))
    return found.where(F.col("rank") < limit).join(beyond, "root", "left").select(
        "root", "chain", "hops", "rank", F.coalesce("_more", F.lit(False)).alias("truncated")
    )


def infection_edges(edges: SplitEdges, roots: DataFrame, closure: DataFrame, depth: int) -> DataFrame:
    """Distinct (root, source, target): dependency edges that an infection of the root can use.

    The source is the root or lies less than ``depth`` hops from it, the target is not the root.
    An edge back to a nearer node counts, whether or not a route without repeats runs over it.
    """
    frontier = roots.select("root", F.col("root").alias("node")).unionByName(closure.where(F.col("depth") < depth).select("root", "node"))
    return (
        edges.follow(frontier, "node").where(F.col("src") != F.col("root")).select("root", F.col("node").alias("source"), F.col("src").alias("target")).distinct()
    )
