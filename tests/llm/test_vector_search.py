import random

import numpy as np
from pyspark.sql import functions as F

from faultline.llm import vector_search as V


def inner(x, y):
    out = 0.0
    for a, b in zip(x, y):  # the built-in sum would compensate for rounding
        out += a * b
    return out


def brute(rows, k):
    seen = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, qv in seen:
        if q % 20 == 0:
            scores = sorted((-inner(qv, v), i) for i, v in seen if i != q and len(v) == len(qv))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def search(spark, rows, k, **groups):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("_asks", F.lit(1))
    return sorted(map(tuple, V.nearest(frame, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), k, **groups).collect()))


def test_ties_repeats_and_vectors_without_part(spark):
    random.seed(4)
    grid = lambda: [random.randint(-2, 2) / 4 for _ in range(5)]  # noqa: E731  many ties
    rows = [(i, grid()) for i in range(400)]
    rows += [(7, rows[7][1]), (8, grid()), (20, grid()), (None, grid()), (401, None), (402, []), (403, [0.0] * 5)]
    rows += [(404, [1.0, None, 1.0, 1.0, 1.0]), (405, [float("nan")] * 5), (406, [float("inf")] * 5), (407, [1.0, 2.0]), (440, [2.0, 1.0])]
    assert search(spark, rows, 20, query_group=7, candidate_group=60) == brute(rows, 20)


def test_one_common_vector_and_few_candidates(spark):
    common = [0.5, 0.25, 0.125]
    rows = [(i, common if i % 3 else [i / 100, 1.0, -1.0]) for i in range(1, 200)]
    assert search(spark, rows, 20, query_group=4, candidate_group=30) == brute(rows, 20)
    assert search(spark, [(20, [1.0]), (1, [2.0])], 20) == [(20, 1, 1, 2.0)]
    assert search(spark, [(1, [2.0])], 20) == []
    assert search(spark, [(0, None)], 20) == []


def test_bounds_hold_for_uneven_scales():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 24)) * np.exp(rng.normal(size=(300, 1)) * 6)
    ids = np.arange(300)
    found = V.tile_neighbours(ids[:40] + 1000, x[:40] * 1e-3, ids, x, 10)
    for i, near in enumerate(found):
        scores = V.exact_scores(x[i] * 1e-3, x)
        assert [-j for _, j in near] == sorted(range(300), key=lambda j: (-scores[j], j))[:10]
