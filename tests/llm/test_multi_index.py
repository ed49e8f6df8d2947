import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import multi_index

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def brute(rows, least=0.9):
    """{(id, vector): (links, component)} of distinct rows with whole vectors."""
    rows = list(dict.fromkeys((i, tuple(np.float32(v).tolist())) for i, v in rows))
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= least - 1e-15
    np.fill_diagonal(near, False)
    out, seen = {}, set()
    for start in range(len(rows)):
        if start in seen:
            continue
        group, stack = {start}, [start]
        while stack:
            for j in np.flatnonzero(near[stack.pop()]).tolist():
                if j not in group:
                    group.add(j)
                    stack.append(j)
        seen |= group
        name = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        out |= {rows[i]: (int(near[i].sum()), name) for i in group}
    return out


def planted(n=1500, size=24, copies=200, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, size))
    near = base[rng.integers(0, n, copies)] + 0.25 * rng.standard_normal((copies, size))
    group = base[0] + 0.2 * rng.standard_normal((copies, size))
    same = np.repeat(base[1:2], 60, axis=0)
    return [(i, v.tolist()) for i, v in enumerate(np.concatenate((base, near, group, same, 3 * base[2:9])))]


def found(spark, rows, **kw):
    out = multi_index.near_vectors(spark.createDataFrame(rows, SCHEMA), **kw)
    return out


@pytest.mark.parametrize("block", [multi_index.BLOCK, 64])
def test_links_of_planted_copies(spark, block):
    rows = planted()
    want = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component"]) for r in found(spark, rows, block=block).collect()}
    assert len(got) == len(rows)
    right = {i: want[i, tuple(np.float32(v).tolist())] for i, v in rows}
    assert all(got[i][0] <= right[i][0] for i in got)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in right.values())
    assert sum(got[i][1] == right[i][1] for i in got) >= 0.97 * len(got)


def test_all_cells_visited_is_brute_force(spark):
    rows = planted(300, 9, 80, 5)
    want = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component"]) for r in found(spark, rows, recall=1.0).collect()}
    assert {i: want[i, tuple(np.float32(v).tolist())] for i, v in rows} == got


def test_staircase_is_all_sums_below_the_stop():
    rng = np.random.default_rng(1)
    first, second = rng.random((40, 7)), rng.random((40, 5))
    first -= first.min(axis=1, keepdims=True)
    second -= second.min(axis=1, keepdims=True)
    rows, cells = multi_index.traverse(first, second, 0.6)
    want = {(r, i * 5 + j) for r in range(40) for i in range(7) for j in range(5) if second[r, j] <= 0.6 - first[r, i]}
    assert len(rows) == len(want) and set(zip(rows.tolist(), cells.tolist())) == want


def test_rest_of_a_cosine_on_the_threshold(spark):
    a, b = [1.0, 0.0], [0.9, float(np.sqrt(0.19))]
    out = {r["vec_id"]: r["n_links"] for r in found(spark, [(1, a), (2, b), (3, [0.0, 1.0])], recall=1.0).collect()}
    x = np.array([a, b], np.float32).astype(float)
    linked = x[0] @ x[1] / np.linalg.norm(x[0]) / np.linalg.norm(x[1]) >= 0.9
    assert out == {1: int(linked), 2: int(linked), 3: 0}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
        (7, [inf, 1.0]), (8, [None, 1.0]), (None, [3.0, 0.01]), (None, None), (None, [-1.0, 0.0]), (9, [1.0]), (10, [5.0]), (11, [1e-38, 0.0]), (12, [3e38, 0.0]),
    ]
    made = spark.createDataFrame(rows, SCHEMA)
    for name in ("_node", "node", "_id", "_vector", "links", "label", "_cell"):
        made = made.withColumn(name, F.lit("x"))
    got = sorted(((r["vec_id"], r["n_links"], r["component"]) for r in multi_index.near_vectors(made).collect()), key=repr)
    want = [(1, 4, 1), (1, 0, 1), (2, 4, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (None, 4, 1), (None, 0, None), (None, 0, None)]
    want += [(9, 1, 9), (10, 1, 9), (11, 4, 1), (12, 4, 1)]
    # the other vector of id 1 links with nothing, but its group is named by the same id
    assert got == sorted(want, key=repr)


def test_empty(spark):
    assert found(spark, []).count() == 0
