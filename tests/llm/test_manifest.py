import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from faultline.llm import manifest
from tests.llm.conftest import CLASHING, DOCUMENT


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, n_chars=None):
    doc_id, text, lang, source, count = row
    fields = (doc_id, source, lang, count if n_chars is None else n_chars, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(nodes, fan):
    """(root, path by leaf): a path lists (left, right) digests of the run's others."""
    paths, at, levels = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(levels) > 1:
        for i, place in enumerate(at):
            run = levels[place // fan * fan : place // fan * fan + fan]
            paths[i].append(("".join(run[: place % fan]), "".join(run[place % fan + 1 :])))
        levels = [h(*levels[i : i + fan]) for i in range(0, len(levels), fan)]
        at = [place // fan for place in at]
    return levels[0], paths


def brute(rows, fan=2):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    placed = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in order}
    trees = {g: tree([leaf(r) for r in placed[g]], fan) for g in order}
    root, above = tree([trees[g][0] for g in order], fan)
    out = []
    for k, g in enumerate(order):
        for row, path in zip(placed[g], trees[g][1]):
            path = path + above[k]
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None
            folded = leaf(row, row[4] + 1) if tampered else leaf(row)
            for left, right in path:
                folded = h(left, folded, right)
            out.append((row[0], leaf(row), trees[g][0], root, h(*(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


def run(spark, rows, fan=2, extra=()):
    made = spark.createDataFrame(rows, DOCUMENT)
    for name in extra:
        made = made.withColumn(name, F.lit("x"))
    out = manifest.manifest(made, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, fan)
    return sorted(
        (tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", manifest.digest(manifest.proof_text(F.col("proof"))), "folded_root", "verified").collect()), key=repr
    )


def made(n, seed=0):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.choice(["", "é text", "a" * rng.randrange(40), None]), rng.choice(["en", "en", "en", "fr", "", None]), rng.choice(["s", None]), rng.choice([None, 5, 0])) for _ in range(n)]


@pytest.mark.parametrize("n,fan", [(1, 2), (2, 2), (3, 2), (61, 2), (40, 3), (33, 5)])
def test_against_a_tree_built_whole(spark, n, fan):
    rows = made(n, n)
    got = run(spark, rows, fan)
    assert got == brute(rows, fan)
    assert n < 60 or {r[-1] for r in got} == {True, False}


def test_odd_rows_and_clashing_columns(spark):
    long = "word " * 200_000
    rows = [(None, None, None, None, None), (1, long, "en", "s", 9_223_372_036_854_775_807), (1, long, "en", "s", 9_223_372_036_854_775_807), (-3, "", "", "", -1), (12, "x", "zz", None, 1)]
    rows += [(i, "x", "en", "s", 9_223_372_036_854_775_807) for i in range(12)]
    assert run(spark, rows, extra=(*CLASHING, "_at", "_tree", "_digest", "_size", "_path", "_left", "root", "leaf", "_lang", "_position")) == brute(rows)


def test_empty(spark, empty):
    assert manifest.manifest(empty).count() == 0
