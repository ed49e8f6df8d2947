"""Near copies among vectors by an inverted multi-index.

Unit vectors are cut into halves, and each half has a codebook of its own, so that the pairs of
codes form a product grid. A vector lies in the cell of its two nearest centroids and visits the
cells around it by multi-sequence traversal: pairs of codes in the order of the two squared
distances' sum. It stops when the target recall is reached. That point is a sum of excess
distances, calibrated on the sample: each sampled vector gets a partner at exactly the least
cosine in a random direction, and the sums at which one of the two reaches the other's cell are
cut at the quantile ``RECALL``; pairs that are nearer are found more often. All pairs that meet in
a cell are verified in double precision, on the vectors as given.

A pair counts once for each of its two vectors, whichever of them reached the other: the list of
cells that a vector visits goes with it, so a tile knows whether the pair is met again from the
other side. Tiles give a number of links for each vector and a spanning forest, never pairs.
Equal vectors are one node with a weight. A cell with very many rows is cut into blocks that meet
pairwise, small cells share tasks. Groups are the connected components of the links.

The codebooks are fitted on at most about ``SAMPLE`` vectors, or ``SAMPLE_FLOATS`` components, of
each length, those with the least hashes; every vector is indexed. The codebooks, which are sent
to all tasks, are smaller than the sample.

Defined results: equal rows are one row; rows of one id with different vectors are a row each.
Vectors that are null, empty, zero or hold a null or non-finite component link with nothing and
are groups of their own. Vectors of different lengths never link. Rows with a null id link like
any other but name no group: a group without any id has a null component and is not kept. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import scratch, ship, table
from faultline.llm.simhash import Forest, components
from faultline.session import Scratch

LEAST, RECALL = 0.9, 0.98
SAMPLE, SAMPLE_FLOATS = 16_384, 1 << 22
#: Vectors that a cell of the grid holds on average, as long as the sample can fit so many centroids.
PER_CELL, PER_CENTROID = 8, 32
ROUNDS, SEED = 12, 42
#: Rows of one side that a task compares at a time, and rows of one side of a block of a large cell.
STRIP, BLOCK = 256, 4096
#: Cosines this near to the threshold are summed again without rounding.
DOUBT = 1e-12


# ---- codebooks and traversal --------------------------------------------------------------


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no cosine and keeps squares finite."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def halves(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return rows[:, : rows.shape[1] // 2], rows[:, rows.shape[1] // 2 :]


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances up to a constant for each row, the same whatever rows stand beside it."""
    out = np.broadcast_to((centroids * centroids).sum(axis=1), (len(rows), len(centroids))).copy()
    for d in range(rows.shape[1]):
        out -= rows[:, d, None] * (2 * centroids[:, d])
    return out


def codebook(rows: np.ndarray, k: int) -> np.ndarray:
    """k-means from distinct rows; a centroid without rows stays where it was."""
    rng = np.random.default_rng(SEED)
    centroids = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(ROUNDS):
        code = distances(rows, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, code, rows)
        held = np.bincount(code, minlength=k)
        centroids = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centroids)
    return centroids


def excess(rows: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For both halves, by how much each centroid is farther than the nearest."""
    out = []
    for part, book in zip(halves(rows), books):
        far = distances(part, book)
        out.append(far - far.min(axis=1, keepdims=True))
    return out[0], out[1]


def calibrate(rows: np.ndarray, books: tuple[np.ndarray, np.ndarray], least: float, recall: float) -> float:
    """The sum of excess distances at which ``recall`` of pairs of cosine ``least`` have met."""
    rng = np.random.default_rng(SEED + 1)
    aside = rng.standard_normal(rows.shape)
    aside -= (aside * rows).sum(axis=1, keepdims=True) * rows
    length = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
    partners = least * rows + math.sqrt(1 - least * least) * np.divide(aside, length, out=np.zeros_like(aside), where=length > 0)
    here, there, at = excess(rows, books), excess(partners, books), np.arange(len(rows))
    reach = lambda start, goal: sum(s[at, g.argmin(axis=1)] for s, g in zip(start, goal))
    return float(np.quantile(np.minimum(reach(here, there), reach(there, here)), recall, method="higher"))


def traverse(first: np.ndarray, second: np.ndarray, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all cells that the rows visit: multi-sequence order up to the sum ``stop``.

    Both sequences are sorted, so the cells visited form a staircase: the farther the first code,
    the fewer second codes follow. A step is taken for all rows at once.
    """
    by_first, by_second = first.argsort(axis=1, kind="stable"), second.argsort(axis=1, kind="stable")
    first, second = np.take_along_axis(first, by_first, axis=1), np.take_along_axis(second, by_second, axis=1)
    rows, cells = [], []
    alive = np.arange(len(first))
    for step in range(first.shape[1]):
        alive = alive[first[alive, step] <= stop]
        if not len(alive):
            break
        row, place = np.nonzero(second[alive] <= stop - first[alive, step, None])
        rows.append(alive[row])
        cells.append(by_first[alive[row], step] * second.shape[1] + by_second[alive[row], place])
    return np.concatenate(rows), np.concatenate(cells)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64)


def _fit(least: float, recall: float):
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        rows = unit(_matrix(frame.sort_values("_node")["_vector"]))
        n = int(frame["_nodes"].iloc[0])
        k = max(1, min(len(rows) // PER_CENTROID, 1 << max(0, round(math.log2(max(1.0, n / PER_CELL)) / 2))))
        books = tuple(codebook(part, k) for part in halves(rows))
        stop = calibrate(rows, books, least, recall)
        return pd.DataFrame({"_size": [rows.shape[1]], "books": [np.concatenate(books, axis=1).ravel()], "k": [k], "stop": [stop]})

    return fit


Model = dict[int, tuple[tuple[np.ndarray, np.ndarray], float]]


def learn(nodes: DataFrame, least: float, recall: float) -> Model:
    """Codebooks and stop for each vector length, from a bounded sample of ``nodes`` (_node, _size, _vector)."""
    sizes = nodes.groupBy("_size").agg(F.count(F.lit(1)).alias("_nodes"))
    wanted = F.least(F.lit(SAMPLE), F.greatest(F.lit(64), F.floor(F.lit(SAMPLE_FLOATS) / F.col("_size"))))
    # the hash of a node is uniform: those in the first wanted / nodes of its range are the sample
    place = F.pmod(F.xxhash64("_node", F.lit(3)), F.lit(1 << 32)) / (1 << 32)
    # one row for each vector length, as the model itself
    sample = nodes.join(F.broadcast(sizes), "_size").where(place < wanted / F.col("_nodes"))
    fitted = sample.select("_node", "_size", "_vector", "_nodes").groupBy("_size").applyInPandas(
        _fit(least, recall), "_size int, books array<double>, k int, stop double"
    )
    model = {}
    for row in fitted.collect():  # one row for each vector length, smaller than its sample
        model[row["_size"]] = (halves(np.array(row["books"]).reshape(row["k"], row["_size"])), row["stop"])
    return model


def _code(model: Model):
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for size, part in frame.groupby("_size"):
                if size not in model:  # so few vectors of this length that none was sampled
                    yield part.assign(_cell=0, _reach=[[0]] * len(part))
                    continue
                books, stop = model[size]
                first, second = excess(unit(_matrix(part["_vector"])), books)
                rows, cells = traverse(first, second, stop)
                order = np.lexsort((cells, rows))
                reach = np.split(cells[order], np.cumsum(np.bincount(rows, minlength=len(part)))[:-1])
                yield part.assign(_cell=first.argmin(axis=1) * second.shape[1] + second.argmin(axis=1), _reach=reach)

    return code


# ---- verification in tiles ----------------------------------------------------------------


def _again(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum((a * b).tolist()) / (math.sqrt(math.fsum((a * a).tolist())) * math.sqrt(math.fsum((b * b).tolist())))


def _linked(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Whether each row of ``left`` and each of ``right`` has at least the cosine ``least``."""
    norms = np.sqrt((left * left).sum(axis=1))[:, None] * np.sqrt((right * right).sum(axis=1))[None, :]
    cosine = (left @ right.T) / norms
    linked = cosine >= least
    for i, j in zip(*np.nonzero(np.abs(cosine - least) < DOUBT)):
        linked[i, j] = _again(left[i], right[j]) >= least
    return linked


def _tile(least: float):
    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, local = np.unique(frame["_node"].to_numpy(object).astype(str), return_inverse=True)
        links, forest = np.zeros(len(nodes), np.int64), Forest(len(nodes))
        asks, cells, homes = frame["_asks"].to_numpy(bool), frame["_at"].to_numpy(), frame["_cell"].to_numpy()
        many = frame["_many"].to_numpy(np.int64)
        for cell in np.unique(cells[asks]):
            here = cells == cell
            offered = np.flatnonzero(here & ~asks)
            asking = np.flatnonzero(here & asks)
            if not len(offered):
                continue
            theirs = scaled(_matrix(frame["_vector"].iloc[offered]))
            # (offered vector, cell) for every cell that an offered vector visits itself
            visits = [np.asarray(cells, np.int64) for cells in frame["_reach"].iloc[offered]]
            visits = set(zip(np.repeat(np.arange(len(offered)), [len(v) for v in visits]).tolist(), np.concatenate(visits).tolist()))
            for at in range(0, len(asking), STRIP):
                strip = asking[at : at + STRIP]
                linked = _linked(scaled(_matrix(frame["_vector"].iloc[strip])), theirs, least)
                linked &= local[strip][:, None] != local[offered][None, :]
                links[local[strip]] += linked @ many[offered]
                x, y = np.nonzero(linked)
                forest.link(local[strip[x]], local[offered[y]])
                # a pair that the offered vector does not meet on its own visits counts for it here
                other = homes[strip[x]] != cell
                x, y = x[other], y[other]
                unmet = np.array([pair not in visits for pair in zip(y.tolist(), homes[strip[x]].tolist())], bool)
                np.add.at(links, local[offered[y[unmet]]], many[strip[x[unmet]]])
        roots = forest.roots()
        found = (links > 0) | (roots != np.arange(len(nodes)))
        return pd.DataFrame({"node": nodes[found], "links": links[found], "root": nodes[roots[found]]})

    return verify


def tiles(coded: DataFrame, work: Scratch, block: int = BLOCK) -> DataFrame:
    """Rows that ask and rows that are offered, by the task and cell in which they meet."""
    shared = ("_node", "_size", "_cell", "_vector", "_many")
    asking = coded.select(*shared, F.lit(True).alias("_asks"), F.explode("_reach").alias("_at"), F.lit(None).cast("array<long>").alias("_reach"))
    offered = coded.select(*shared, F.lit(False).alias("_asks"), F.col("_cell").alias("_at"), "_reach")
    held = offered.groupBy("_size", "_at").agg(F.count(F.lit(1)).alias("_offered"))
    asked = coded.select("_size", F.explode("_reach").alias("_at")).groupBy("_size", "_at").agg(F.count(F.lit(1)).alias("_asking"))
    counted = work.keep(held.join(asked, ["_size", "_at"]), "cells")  # cells without vectors are not visited
    total = counted.agg(F.sum(F.col("_offered") + F.col("_asking"))).first()[0] or 0
    groups = max(1, -(-total // (2 * block)))
    large = (F.col("_offered") > block) | (F.col("_asking") > block)
    placed = counted.select(
        "_size", "_at",
        F.when(large, F.xxhash64("_at")).otherwise(F.pmod(F.xxhash64("_at"), F.lit(groups))).alias("_group"),
        F.ceil(F.col("_offered") / block).cast("int").alias("_rows"), F.ceil(F.col("_asking") / block).cast("int").alias("_columns"),
    )
    spread = F.xxhash64("_node", F.lit(5))
    dealt = asking.unionByName(offered).join(placed, ["_size", "_at"])
    own = F.pmod(spread, F.when(F.col("_asks"), F.col("_columns")).otherwise(F.col("_rows"))).cast("int")
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("_asks"), F.col("_rows")).otherwise(F.col("_columns")) - 1))
    met = dealt.withColumn("_own", own).withColumn("_across", across)
    return met.select(
        *shared, "_asks", "_at", "_reach", "_group",
        F.when(F.col("_asks"), F.col("_across")).otherwise(F.col("_own")).alias("_row"),
        F.when(F.col("_asks"), F.col("_own")).otherwise(F.col("_across")).alias("_column"),
    )


def near_vectors(
    vectors: DataFrame, least: float = LEAST, recall: float = RECALL, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """(id, n_links, component): links of cosine ``least`` or more, and the least id of each row's group."""
    spark = vectors.sparkSession
    ship(spark)
    work = scratch(spark, "multi-index")
    narrow = dict(vectors.dtypes)[vector_column] == "array<float>"  # half the shuffle of doubles
    vector = F.col(vector_column) if narrow else F.col(vector_column).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = F.col("_vector").isNotNull() & F.forall("_vector", finite) & F.exists("_vector", lambda x: x != 0)
    key = F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), "_vector")), 16, "0") for seed in (1, 2)))
    read = vectors.select(F.col(id_column).alias("_id"), vector.alias("_vector")).select(
        "_id", "_vector", F.coalesce(whole, F.lit(False)).alias("_whole"), F.coalesce(F.size("_vector"), F.lit(0)).alias("_size"), key.alias("_node")
    )
    rows = work.keep(read.dropDuplicates(["_id", "_node", "_size", "_whole"]), "rows")
    nodes = work.keep(
        rows.where("_whole").groupBy("_node", "_size").agg(F.first("_vector").alias("_vector"), F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_many")),
        "nodes",
    )
    model = learn(nodes, least, recall)
    kind = "float" if narrow else "double"
    coded = work.keep(
        nodes.select("_node", "_size", "_vector", "_many").mapInPandas(
            _code(model), f"_node string, _size int, _vector array<{kind}>, _many long, _cell long, _reach array<long>"
        ),
        "coded",
    )
    met = tiles(coded, work, block).groupBy("_size", "_group", "_row", "_column").applyInPandas(_tile(least), "node string, links long, root string")
    found = work.keep(met, "found")
    rooted = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), work)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(rooted.withColumnRenamed("node", "_node"), "_node", "left").withColumn("_root", F.coalesce("root", "_node"))
    names = named.groupBy("_root").agg(F.min("_least").alias("component"))
    placed = (
        named.join(names, "_root").join(counts.withColumnRenamed("node", "_node"), "_node", "left")
        .select("_node", (F.coalesce("links", F.lit(0)) + F.col("_many") - 1).alias("n_links"), "component", F.lit(True).alias("_whole"))
    )
    placed = work.keep(placed, "placed")
    out = rows.select("_id", "_node", "_whole").join(placed, ["_node", "_whole"], "left")
    return out.select(
        F.col("_id").alias(id_column), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("_whole"), F.col("component")).otherwise(F.col("_id")).alias("component"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(
        "vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept")
    )


#: All pairs compared: what the query returns where the traversal misses no link.
ORACLE = """
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS n, vec_id, e,
        coalesce(len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0, false) AS whole
    FROM (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
w AS MATERIALIZED (SELECT n, vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v WHERE whole),
l AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM w a JOIN w b ON a.n <> b.n AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.9),
reach AS (SELECT n AS a, n AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
named AS (SELECT r.a AS n, min(w.vec_id) AS component FROM reach r JOIN w ON w.n = r.b GROUP BY r.a),
counted AS (SELECT a AS n, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(c.n_links, 0) AS n_links, CASE WHEN v.whole THEN m.component ELSE v.vec_id END AS component_id,
    coalesce(v.vec_id = CASE WHEN v.whole THEN m.component ELSE v.vec_id END, false) AS kept
FROM v LEFT JOIN counted c ON c.n = v.n LEFT JOIN named m ON m.n = v.n
"""
