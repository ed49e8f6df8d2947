"""SimHash fingerprints and near-duplicate groups by binary trie self-joins.

Fingerprints are made of three-word shingles. Distinct fingerprints are joined in binary tries:
with an error budget of e bits, the 64 bits are cut into e + 1 blocks, and two fingerprints within
the budget agree on at least one whole block, so there is one trie for each block, with that block
turned to the top, where no error is allowed. A self-join walks pairs of nodes together from the
root, adds up the bits in which the two paths differ, and drops a pair as soon as its budget is
exceeded. What it links is reduced at once to a spanning forest, so a dense group of n
fingerprints gives at most n - 1 links and never its pairs. Subtries below the block meet in cells
of about ``CELL`` fingerprints; a larger subtrie is cut into parts that meet pairwise, so no task
holds a hot one whole.

Groups are the connected components of the links, found by rounds of joins that are written to
the shared folder; neither links nor fingerprints reach the driver.

Defined results: null and empty texts, and texts without words, have fingerprint zero and are
linked like any other. Texts with fewer words than a shingle are one shingle. Every input row
gives one row. Rows with a null id take their place in groups but name none: the component of a
group without any id is null. Columns other than the two read are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import scratch, ship, table
from faultline.session import Scratch

SHINGLE, BUDGET, SEED, BITS = 3, 3, 42, 64
#: Fingerprints that a cell, or one part of a subtrie, holds on average.
CELL = 4096
#: Node pairs expanded at a time while a trie is walked; bounds the memory of a cell.
PAIRS_AT_ONCE = 1 << 18

#: ASCII white space that separates words.
SEPARATORS = bytes(range(9, 14)) + b" "
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_TO_SPACE = bytes(32 if b in SEPARATORS else _LOWER[b] for b in range(256))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """A bit is set where over half of the shingles' hashes, repeats included, have it set."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - size + 1)
    spans = zip(starts[:last].tolist(), ends[min(size, len(words)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", extra: tuple[str, ...] = ()
) -> DataFrame:
    """(id, *extra, _fp): the 64 bits as a signed long."""
    ship(documents.sparkSession)
    return documents.select(F.col(id_column), *extra, _fingerprints(F.col(text_column)).alias("_fp"))


# ---- the trie self-join -------------------------------------------------------------------


class Forest:
    """Union by smallest member over positions 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if (higher == self.up).all():
                return self.up
            self.up = higher

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        """Join every pair; rounds of hooking larger roots to smaller ones."""
        while True:
            roots = self.roots()
            a, b = roots[left], roots[right]
            apart = a != b
            if not apart.any():
                return
            left, right = left[apart], right[apart]
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def trie_links(values: np.ndarray, sides: np.ndarray | None, budget: int, exact: int) -> np.ndarray:
    """For sorted distinct ``values`` the root position of each one's group.

    Linked values agree on their top ``exact`` bits and differ in at most ``budget`` of the others.

    ``sides`` (0 or 1 for each value) limits links to values of different sides; None: any two.
    A node of the trie is the range of sorted values that share a prefix; the children of a node
    at bit b are split where bit b turns from 0 to 1. A stack of node pairs with their error
    counts is walked depth first in batches, so at most some batches of pairs are alive.
    """
    n = len(values)
    forest = Forest(n)
    if n < 2:
        return forest.up
    start = np.array([[0, n, 0, n, 0]], np.int64)
    stack: list[tuple[int, np.ndarray]] = [(BITS - 1, start)]
    while stack:
        bit, pairs = stack.pop()
        if len(pairs) > PAIRS_AT_ONCE:
            stack.append((bit, pairs[PAIRS_AT_ONCE:]))
            pairs = pairs[:PAIRS_AT_ONCE]
        single = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        leaves = pairs[single]
        if len(leaves):
            a, b = leaves[:, 0], leaves[:, 2]
            near = (np.bitwise_count(values[a] ^ values[b]) <= budget) & (a != b)
            if sides is not None:
                near &= sides[a] != sides[b]
            forest.link(a[near], b[near])
        pairs = pairs[~single]
        if bit < 0 or not len(pairs):
            continue
        # both nodes whole in one group: nothing to add below them
        roots = forest.roots()
        cuts = np.concatenate(([0], np.cumsum(roots[1:] != roots[:-1])))
        settled = (
            (cuts[pairs[:, 0]] == cuts[pairs[:, 1] - 1])
            & (cuts[pairs[:, 2]] == cuts[pairs[:, 3] - 1])
            & (roots[pairs[:, 0]] == roots[pairs[:, 2]])
        )
        pairs = pairs[~settled]
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        a0, a1, b0, b1, err = pairs.T
        allowed = 0 if BITS - 1 - bit < exact else budget
        a_cut, b_cut = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = pairs[:, 0] == pairs[:, 2]
        below = [
            np.stack((a0, a_cut, b0, b_cut, err), 1),
            np.stack((a_cut, a1, b_cut, b1, err), 1),
            np.stack((a0, a_cut, b_cut, b1, err + 1), 1),
            np.stack((a_cut, a1, b0, b_cut, err + 1), 1)[~same],  # the mirror of the pair before
        ]
        below = np.concatenate(below)
        keep = (below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= allowed)
        alone = (below[:, 0] == below[:, 2]) & (below[:, 1] - below[:, 0] == 1)
        below = below[keep & ~alone]
        if len(below):
            stack.append((bit - 1, below))
    return forest.roots()


def _turn(values: np.ndarray, by: int) -> np.ndarray:
    """Bits rotated to the left."""
    return (values << np.uint64(by)) | (values >> np.uint64(BITS - by)) if by else values


def _cell_links(budget: int):
    width = BITS // (budget + 1)

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        turned = _turn(frame["_fp"].to_numpy(np.int64).view(np.uint64), width * int(frame["_block"].iloc[0]))
        order = np.argsort(turned, kind="stable")
        values, parts, signed = turned[order], frame["_part"].to_numpy()[order], frame["_fp"].to_numpy()[order]
        across = parts.min() != parts.max()
        roots = trie_links(values, (parts != parts.min()).astype(np.int8) if across else None, budget, width)
        tied = roots != np.arange(len(values))
        return pd.DataFrame({"a": signed[tied], "b": signed[roots[tied]]})

    return join


def links(prints: DataFrame, n: int, work: Scratch, budget: int = BUDGET, cell: int = CELL) -> DataFrame:
    """(a, b): a spanning forest, for each cell, of the ``n`` distinct fingerprints within ``budget`` bits."""
    blocks = budget + 1
    width = BITS // blocks
    shift = (F.col("_block") * width).cast("int")
    turned = F.call_function("shiftleft", F.col("_fp"), shift).bitwiseOR(
        F.call_function("shiftrightunsigned", F.col("_fp"), F.lit(BITS) - shift)
    )
    keyed = prints.select("_fp", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")).withColumn(
        "_value", F.call_function("shiftrightunsigned", turned, F.lit(BITS - width))
    )
    # at most blocks * n / cell rows
    large = work.keep(
        keyed.groupBy("_block", "_value").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cell)
        .select("_block", "_value", F.ceil(F.col("_n") / cell).cast("int").alias("_parts")),
        "large",
    )
    groups = max(1, -(-n // cell))
    parts = F.coalesce("_parts", F.lit(1))
    cells = (
        keyed.join(large, ["_block", "_value"], "left")
        .withColumn("_part", F.pmod(F.xxhash64("_fp", F.lit(11)), parts).cast("int"))
        .withColumn("_cell", F.when(F.col("_parts").isNull(), F.pmod(F.xxhash64("_value"), F.lit(groups))).otherwise(F.col("_value") + groups))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("_fp", "_block", "_cell", "_part", F.least("_part", "_other").alias("_low"), F.greatest("_part", "_other").alias("_high"))
    )
    return cells.groupBy("_block", "_cell", "_low", "_high").applyInPandas(_cell_links(budget), "a long, b long")


# ---- connected components -----------------------------------------------------------------


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    Each round every node learns the smallest label among its neighbours (large star), then labels
    are shortened through their own labels (pointer jump), until no edge joins two labels. Both
    sides of every join are written tables, so that a node with very many links can be split.
    """
    edges = work.keep(edges.where("a <> b").distinct(), "links")
    labels = work.keep(
        edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "labels"
    )
    current = edges.select("a", "b")
    while True:
        # the smallest neighbour of every label on the edges that still join two labels
        both = current.union(current.select("b", "a"))
        least, n = work.keep_counted(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "least")
        if n == 0:
            return labels
        jumped = work.keep(_jump(least, work), "jumped")
        moved = labels.join(jumped.select(F.col("a").alias("root"), "low"), "root", "left")
        labels = work.keep(moved.select("node", F.coalesce("low", "root").alias("root")), "labels")
        left = current.join(jumped.withColumnRenamed("low", "a2"), "a").select("b", "a2")
        right = left.join(jumped.select(F.col("a").alias("b"), F.col("low").alias("b2")), "b")
        current = work.keep(right.where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), "left")


def _jump(least: DataFrame, work: Scratch) -> DataFrame:
    """Follow label -> label to its end; every label points to itself or a smaller one."""
    while True:
        ahead = least.select(F.col("a").alias("low"), F.col("low").alias("_next"))
        step, n_moved = work.keep_counted(
            least.join(ahead, "low").select("a", F.col("_next").alias("low"), (F.col("_next") < F.col("low")).alias("_moved")), "step"
        )
        moved = step.where("_moved").limit(1).count()
        least = step.drop("_moved")
        if not moved:
            return least


def near_duplicates(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", budget: int = BUDGET, extra: tuple[str, ...] = ()
) -> DataFrame:
    """(id, *extra, _fp, _group, component): groups of rows whose fingerprints link, named by their smallest id.

    ``_group`` tells groups apart also where no row has an id.
    """
    work = scratch(documents.sparkSession, "simhash")
    prints = work.keep(fingerprints(documents, id_column, text_column, extra), "fingerprints")
    distinct, n = work.keep_counted(prints.groupBy("_fp").agg(F.min(id_column).alias("_least")), "distinct")
    rooted = components(links(distinct.select("_fp"), n, work, budget), work)
    named = distinct.join(rooted.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("_root", F.coalesce("root", "_fp"))
    names = named.groupBy("_root").agg(F.min("_least").alias("component"))
    placed = work.keep(named.select("_fp", "_root").join(names, "_root").select("_fp", F.col("_root").alias("_group"), "component"), "placed")
    return prints.join(placed, "_fp").select(id_column, *extra, "_fp", "_group", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = near_duplicates(table(spark, sf_dir, "documents"))
    return grouped.select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
