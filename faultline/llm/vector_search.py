"""Exact nearest neighbours by inner product, from int8 tiles with error bounds.

Vectors are dealt by hash to query groups and candidate groups of bounded size; the pair of groups
is the key on which the two sides meet, so a task holds one tile. In a tile the vectors are
quantised to int8 with one scale each. The tile product of the integers gives every inner product
up to ||ex|| ||y|| + ||x'|| ||ey|| (ex, ey: rounding residues, x': the rounded vector), and only
pairs whose upper bound reaches the k-th lower bound are recomputed from the original components
in double precision, added in component order. Each tile keeps its k best per query in a heap
merge over candidate blocks, and a ranking over the k rows of each tile merges the tiles.

Defined results: rows with a null id, or a vector that is null, empty, zero or holds a null or
non-finite component, take no part. Equal rows count once; rows of one id with different vectors
are answered, and found, each on its own. Vectors of different lengths are never compared. The
query's own id is no candidate. Ties go to the smaller id. Fewer candidates than k: all of them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.common import ship, table

K, QUERY_STEP = 20, 20
#: Rows that one side of a tile may have on average; a tile's memory follows from them.
QUERY_GROUP, CANDIDATE_GROUP = 2048, 4096
#: Candidates multiplied at a time inside a tile.
BLOCK = 1024
#: Products and sums of int8 pairs are exact in float32 up to this many components.
EXACT_FLOAT32 = (1 << 24) // (127 * 127)


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, norms of the rounded rows, norms of the residues)."""
    scale = np.abs(rows).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # components so small that the scale underflows
    q = np.rint(rows / scale[:, None]).clip(-127, 127)
    rounded = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(rows - rounded, axis=1)


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.add.accumulate(rows * query, axis=1)[:, -1]


def tile_neighbours(query_ids, queries, ids, rows, k: int):
    """For each query (score, id) of its k best candidates in the tile, best first."""
    kind = np.float32 if rows.shape[1] <= EXACT_FLOAT32 else np.float64
    qq, qs, qn, qe = quantise(queries)
    qq = qq.astype(kind)
    full = np.linalg.norm(queries, axis=1)
    best: list[list[tuple[float, int]]] = [[] for _ in query_ids]  # heaps of (score, -id), worst first
    for at in range(0, len(ids), BLOCK):
        part, part_ids = rows[at : at + BLOCK], ids[at : at + BLOCK]
        cq, cs, cn, ce = quantise(part)
        product = (qq @ cq.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
        # a little is added for the rounding of the double arithmetic itself
        slack = (qe[:, None] * np.linalg.norm(part, axis=1)[None, :] + qn[:, None] * ce[None, :]) * (1 + 1e-9)
        slack += 1e-12 * full[:, None] * (cn + ce)[None, :]
        own = query_ids[:, None] == part_ids[None, :]
        lower = np.where(own, -np.inf, product - slack)
        upper = np.where(own, -np.inf, product + slack)
        if len(part_ids) > k:
            floor = np.partition(lower, len(part_ids) - k, axis=1)[:, len(part_ids) - k]
        else:
            floor = np.full(len(query_ids), -np.inf)
        for i, heap in enumerate(best):
            least = max(floor[i], heap[0][0]) if len(heap) == k else floor[i]
            alive = np.flatnonzero((upper[i] >= least) & ~own[i])
            if not len(alive):
                continue
            scores = exact_scores(queries[i], part[alive])
            for score, j in sorted(zip(scores.tolist(), (-part_ids[alive]).tolist()), reverse=True)[:k]:
                if len(heap) < k:
                    heapq.heappush(heap, (score, j))
                elif (score, j) > heap[0]:
                    heapq.heapreplace(heap, (score, j))
                else:
                    break
    return [sorted(heap, reverse=True) for heap in best]


def _tile(k: int):
    def search(frame: pd.DataFrame) -> pd.DataFrame:
        asked = frame["_asks"].to_numpy()
        vectors = np.array(frame["_vector"].tolist(), np.float64)
        ids, keys = frame["_id"].to_numpy(), frame["_key"].to_numpy()
        out = []
        if asked.any() and not asked.all():
            found = tile_neighbours(ids[asked], vectors[asked], ids[~asked], vectors[~asked], k)
            for query_id, key, near in zip(ids[asked], keys[asked], found):
                out += [(query_id, key, -j, score) for score, j in near]
        return pd.DataFrame(out, columns=["query_id", "_key", "vec_id", "score"])

    return search


def nearest(
    vectors: DataFrame, is_query, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding",
    query_group: int = QUERY_GROUP, candidate_group: int = CANDIDATE_GROUP,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row for which ``is_query`` holds."""
    ship(vectors.sparkSession)
    narrow = dict(vectors.dtypes)[vector_column] == "array<float>"  # half the shuffle of doubles
    vector = F.col(vector_column) if narrow else F.col(vector_column).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = (
        vectors.select(F.col(id_column).cast("long").alias("_id"), vector.alias("_vector"), is_query.alias("_is_query"))
        .where(F.col("_id").isNotNull() & F.col("_vector").isNotNull())
        .where(F.forall("_vector", finite) & F.exists("_vector", lambda x: x != 0))
        .withColumn("_key", F.xxhash64("_id", "_vector"))
        .dropDuplicates(["_id", "_key"])
        .withColumn("_size", F.size("_vector"))
    )
    # one row of numbers: how many groups each side needs
    counts = vectors.agg(
        F.greatest(F.ceil(F.count(F.when(is_query, 1)) / query_group), F.lit(1)).cast("int").alias("q"),
        F.greatest(F.ceil(F.count(F.lit(1)) / candidate_group), F.lit(1)).cast("int").alias("c"),
    ).first()
    spread = F.xxhash64(F.col("_key"), F.lit(7))
    own_q, own_c = F.pmod(spread, F.lit(counts.q)).cast("int"), F.pmod(spread, F.lit(counts.c)).cast("int")
    asking = rows.where("_is_query").select(
        "_id", "_key", "_vector", "_size", F.lit(True).alias("_asks"), own_q.alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(counts.c - 1))).alias("_c")
    )
    offered = rows.select(
        "_id", "_key", "_vector", "_size", F.lit(False).alias("_asks"), F.explode(F.sequence(F.lit(0), F.lit(counts.q - 1))).alias("_q"), own_c.alias("_c")
    )
    tiles = (
        asking.unionByName(offered)
        .groupBy("_size", "_q", "_c")
        .applyInPandas(_tile(k), "query_id long, _key long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id", "_key").orderBy(F.desc("score"), "vec_id")
    return (
        tiles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % QUERY_STEP == 0, F.lit(False)))


ORACLE = """
WITH v AS (
    SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
    SELECT q.vec_id AS query_id, q.e AS qe, c.vec_id, list_inner_product(q.e, c.e) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, qe ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
