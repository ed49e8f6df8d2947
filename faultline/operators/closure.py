"""Reverse transitive closure for many roots in one job, plain and gated.

A bounded closure keeps roots as bits: a state row holds a node and, in one word, 64 roots that
reach it. So a node that every root reaches is one row for 64 roots, in the frontier as well as in
what is known, and following the edges of a popular node costs its edges times the words. What is
new at a hop is the OR of what arrives AND NOT what is known.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from faultline.operators.ordering import number_rows
from faultline.operators.skew import SplitEdges
from faultline.schema import DEFAULT_DEPTH
from faultline.session import Scratch


WORD = 64


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(number, F.lit(WORD)).cast("int"))


def _packed(pairs: DataFrame, numbers: DataFrame) -> DataFrame:
    """(node, word, bits) of (root, node) pairs whose root is numbered."""
    return (
        pairs.select("root", "node").join(numbers, "root")
        .groupBy("node", F.floor(F.col("number") / WORD).alias("word"))
        .agg(F.bit_or(_bit(F.col("number"))).alias("bits"))
    )


def _unpacked(levels: DataFrame, numbers: DataFrame) -> DataFrame:
    """(root, node, depth) of (node, word, bits, depth)."""
    at = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0)
    each = levels.select("node", "depth", "word", F.explode(at).alias("_i")).select("node", "depth", (F.col("word") * WORD + F.col("_i")).alias("number"))
    return each.join(numbers, "number").select("root", "node", "depth")


def reach(
    edges: SplitEdges,
    roots: DataFrame,
    depth: int,
    scratch: Scratch,
    *,
    target: str = "src",
    first_hop_blocked: DataFrame | None = None,
    blocked: DataFrame | None = None,
) -> DataFrame:
    """Nodes reached from every root within ``depth`` hops, with their shortest hop count.

    ``edges`` are followed from their key to ``target``; ``roots`` has one column ``root``.
    ``first_hop_blocked`` (root, node) removes edges out of the root only, ``blocked`` (root, node)
    removes nodes at any hop.
    """
    numbers = scratch.keep(
        number_rows(roots.select("root").distinct(), [F.asc("root")], scratch, "number").select("root", "number"), "roots"
    )
    own = scratch.keep(_packed(numbers.select("root", F.col("root").alias("node")), numbers), "own")
    never = own if blocked is None else scratch.keep(own.unionByName(_packed(blocked, numbers)), "never")
    level, levels = own, []
    for hop in range(1, depth + 1):
        arrived = (
            edges.follow(level.select("node", "word", "bits"), "node")
            .groupBy(F.col(target).alias("node"), "word")
            .agg(F.bit_or("bits").alias("bits"))
        )
        known = never
        if hop == 1 and first_hop_blocked is not None:
            known = known.unionByName(_packed(first_hop_blocked, numbers))
        if levels:
            known = known.unionByName(scratch.read_all(levels).select("node", "word", "bits"))
        seen = known.groupBy("node", "word").agg(F.bit_or("bits").alias("_seen"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("bigint"))))
        found = arrived.join(seen, ["node", "word"], "left").select("node", "word", fresh.alias("bits")).where("bits <> 0")
        level, rows = scratch.keep_counted(found.withColumn("depth", F.lit(hop)), f"hop{hop}")
        levels.append(level)
        if rows == 0:
            break
    return scratch.keep(_unpacked(scratch.read_all(levels), numbers), "reached")


class Grown:
    """A table in hash buckets of its keys that only grows; joins on the keys move the other side alone.

    The last column tells the appends apart, each has a folder of its own.
    """

    def __init__(self, scratch: Scratch, schema: str, keys: list[str], label: str):
        self.spark, self.keys, self.part = scratch.spark, keys, schema.split(",")[-1].split()[0]
        self.count = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"{label}_{uuid.uuid4().hex}"
        self.path = scratch.path(label)
        self.append(self.spark.createDataFrame([], schema))

    def append(self, rows: DataFrame) -> int:
        """The number of rows; one file is written for each bucket."""
        seen = Observation()
        placed = rows.repartition(self.count, *self.keys).observe(seen, F.count(F.lit(1)).alias("n"))
        into = placed.write.mode("append").format("parquet").partitionBy(self.part).bucketBy(self.count, *self.keys)
        into.option("path", self.path).saveAsTable(self.name)
        return int(seen.get["n"])

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def release(self) -> DataFrame:
        """The rows as plain files; the catalog forgets the table, its files stay in the scratch folder."""
        out = self.spark.read.schema(self.read().schema).parquet(self.path)
        self.spark.sql(f"DROP TABLE {self.name}")
        return out


def reach_all(edges: SplitEdges, roots: DataFrame, scratch: Scratch, *, target: str = "src") -> DataFrame:
    """Nodes reached from every root at any distance, with their shortest hop count.

    Nodes are numbered once, so rows are numbers. Edges and what is known lie in buckets, edges by
    their start and known pairs by (root, node); a hop shuffles its frontier alone, to the edges
    and then to the known pairs, however many hops went before. It ends when nothing new appears.
    """
    named = edges.edges.select(F.col(edges.key).alias("name")).union(edges.edges.select(target)).union(roots.select("root")).distinct()
    ids = scratch.keep(number_rows(named, [F.asc("name")], scratch, "id").select("name", "id"), "names")

    def numbered(df: DataFrame, column: str) -> DataFrame:
        return df.join(ids.select(F.col("name").alias(column), F.col("id").alias("_id")), column).drop(column).withColumnRenamed("_id", column)

    arcs = numbered(numbered(edges.edges.select(F.col(edges.key).alias("_from"), F.col(target).alias("_to")).distinct(), "_from"), "_to")
    by_start = Grown(scratch, "_from bigint, _to bigint, _set int", ["_from"], "arcs")
    by_start.append(arcs.select("_from", "_to", F.lit(0).alias("_set")))
    # the root itself counts as known, at no distance
    known = Grown(scratch, "root bigint, node bigint, depth int", ["root", "node"], "known")
    rows = known.append(numbered(roots.select("root").distinct(), "root").select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    hop = 0
    while rows:
        hop += 1
        level = known.read().where(F.col("depth") == hop - 1)
        steps = level.join(by_start.read(), F.col("node") == F.col("_from")).select("root", F.col("_to").alias("node")).distinct()
        found = steps.join(known.read().select("root", "node"), ["root", "node"], "left_anti")
        rows = known.append(found.withColumn("depth", F.lit(hop)))
    by_start.release()
    back = known.release().where("depth > 0")
    out = back.join(ids.select(F.col("id").alias("root"), F.col("name").alias("_root")), "root")
    out = out.join(ids.select(F.col("id").alias("node"), F.col("name").alias("_node")), "node")
    return out.select(F.col("_root").alias("root"), F.col("_node").alias("node"), "depth")


def depth_sweep(closure: DataFrame, members: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """Reached members (column ``node``) per root at several hop bounds."""
    inside = closure.join(members.select("node"), "node", "left_semi")
    return inside.groupBy("root").agg(
        *[F.count_if(F.col("depth") <= d).alias(f"depth_{d}") for d in depths]
    )


def wavefront(closure: DataFrame, max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """Nodes infected at and up to each hop; hop 0 is the root itself."""
    sizes = closure.where(F.col("depth") <= max_depth).groupBy("root", "depth").agg(
        F.count(F.lit(1)).alias("arrived")
    )
    # at most max_depth rows per root reach this second aggregation
    steps = sizes.groupBy("root").agg(F.map_from_entries(
        F.collect_list(F.struct("depth", "arrived"))
    ).alias("by_hop"), F.max("depth").alias("last"))
    hops = steps.select(
        "root", "by_hop", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("hop")
    )
    arrived = F.when(F.col("hop") == 0, F.lit(1)).otherwise(F.col("by_hop")[F.col("hop")])
    total = F.aggregate(
        F.filter(F.map_entries("by_hop"), lambda e: e["key"] <= F.col("hop")),
        F.lit(1).cast("bigint"),
        lambda acc, e: acc + e["value"],
    )
    return hops.select("root", "hop", arrived.cast("bigint").alias("arrived"), total.alias("infected"))
