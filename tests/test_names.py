"""Folding and look-alike pairs against all-pairs brute force."""

import random

from pyspark.sql import functions as F

from faultline.functions import names as N
from faultline.operators.people import look_alike_report, rank_look_alikes
from faultline.operators.typosquat import _met, look_alikes, typosquat_edges


def fold(name):
    text = name.lower().translate(str.maketrans("01345789", "oleastbg", "-_."))
    return text.replace("rn", "m").replace("vv", "w")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(previous, i, x, b):
    current = [i]
    for j, y in enumerate(b, 1):
        current.append(min(previous[j] + 1, current[-1] + 1, previous[j - 1] + (x != y)))
    return current


def scope(name):
    return name.split("/")[0] if name.startswith("@") and "/" in name else None


def brute(packages):
    out = {}
    for cid, c, cd in packages:
        for tid, t, td in packages:
            if td is None or td < 1_000_000 or c == t or (cd is not None and cd >= td):
                continue
            if scope(c) is not None and scope(c) == scope(t):
                continue
            a, b = fold(c), fold(t)
            d = distance(a, b)
            if d <= 2:
                out[(cid, tid)] = (d, round(1 - d / max(len(a), len(b), 1), 4))
    return out


def test_fold(spark):
    names = ["URL-Parse-1ite", "corn.er", "vvide_0ne", "a", "r-n", "node-fetch"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.f for r in df.select("n", N.fold(F.col("n")).alias("f")).collect()} == {n: fold(n) for n in names}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(11)
    stems = ["react", "lodash", "express", "ab", "a", "x", "corner", "vvide", "@types/react", "@types/reacts", "@s/lodash", "url-parse-lite", "url-parse-1ite"]
    names = set(stems)
    while len(names) < 160:
        s = list(rng.choice(stems))
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(s) + 1)
            action = rng.random()
            if action < 0.4:
                s.insert(at, rng.choice("abrnv01-"))
            elif action < 0.7 and len(s) > 1:
                del s[min(at, len(s) - 1)]
            elif s:
                s[min(at, len(s) - 1)] = rng.choice("abcl1o0")
        names.add("".join(s) or "q")
    packages = [(i, n, rng.choice([None, 5, 999_999, 1_000_000, 2_000_000, 3_000_000])) for i, n in enumerate(sorted(names))]
    df = spark.createDataFrame(packages, "id bigint, name string, downloads_weekly bigint")
    got = {(r.src, r.dst): (r.edit_distance, r.similarity_score) for r in typosquat_edges(df).collect()}
    want = brute(packages)
    assert got == want and any(d == 0 for d, _ in want.values()) and any(d == 2 for d, _ in want.values())


def test_candidates_can_be_limited_to_ingested_names(spark):
    df = spark.createDataFrame([(1, "react", 2_000_000), (2, "reakt", 1), (3, "reactt", 1)], "id bigint, name string, downloads_weekly bigint")
    only = typosquat_edges(df, spark.createDataFrame([("reakt",)], "name string"))
    assert [(r.src, r.dst) for r in only.collect()] == [(2, 1)]


def test_report_merges_directions(spark, scratch):
    edges = spark.createDataFrame([(2, 1, 1, 0.8), (1, 2, 2, 0.6), (3, 1, 0, 1.0), (1, 1, 0, 1.0)], "src bigint, dst bigint, edit_distance bigint, similarity_score double")
    packages = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id bigint, name string").withColumn("last_published_at", F.lit(None).cast("timestamp_ntz"))
    got = [(r.package_id, r.candidate_id, r.edit_distance, r["rank"]) for r in rank_look_alikes(look_alike_report(edges, packages), scratch).collect()]
    assert sorted(got) == [(1, 2, 1, 2), (1, 3, 0, 1), (2, 1, 2, 1), (3, 1, 0, 1)]


def test_few_names_are_spread_before_they_become_forms(spark):
    names = spark.createDataFrame([("large-ring-1",), ("hot-bolt-2",)], "folded string")
    found = look_alikes(names.withColumnRenamed("folded", "folded_candidate"), names.withColumnRenamed("folded", "folded_target"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Spark drops a spread by the distinct names' own key, and then puts their small partitions together
    assert "REPARTITION_BY_NUM" in plan


def test_forms_of_no_popular_name_stay_out_of_the_join(spark):
    rng = random.Random(11)
    numbers = [rng.getrandbits(64) - 2**63 for _ in range(3000)]
    forms = spark.createDataFrame([(n,) for n in numbers + [0, -1, 2**63 - 1, -(2**63)]], "form long")
    popular = spark.createDataFrame([(n,) for n in numbers[:200] + [-1, -(2**63)]], "form long")
    left = [r.form for r in _met(forms, popular).collect()]
    assert set(numbers[:200]) | {-1, -(2**63)} <= set(left)
    assert len(left) < 300


def test_forms_are_the_string_without_up_to_two_characters(spark):
    words = ["", "a", "ab", "aba", "aabb", "ünï-x"]
    rows = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string").select("w", N.without_up_to_two(F.col("w")).alias("f")).collect()
    for r in rows:
        if r.w is not None:
            want = {r.w} | {r.w[:i] + r.w[i + 1:] for i in range(len(r.w))}
            want |= {r.w[:i] + r.w[i + 1:j] + r.w[j + 1:] for j in range(len(r.w)) for i in range(j)}
            assert len(r.f) == len(set(r.f)) and set(r.f) == want
