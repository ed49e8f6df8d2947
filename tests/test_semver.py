"""Version order, range parsing and matching, against written cases and a second implementation."""

import itertools
import random
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F

from faultline.functions import semver as V
from faultline.operators import versions as N

CASES = [
    ("1.2.3", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("2.0.0-beta", "^1.2.0", False),
    ("1.2.4-beta", "^1.2.3-alpha", False), ("1.2.3-beta", "^1.2.3-alpha", True),
    ("0.2.5", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("0.0.3", "^0.0.3", True), ("0.0.4", "^0.0.3", False),
    ("0.0.9", "^0.0.x", True), ("0.1.0", "^0.0.x", False), ("0.5.0", "^0.x", True), ("1.0.0", "^0", False),
    ("1.2.9", "~1.2.3", True), ("1.3.0", "~>1.2.3", False), ("1.9.0", "~1", True), ("2.0.0", "~1", False),
    ("1.5.0", "1.x", True), ("2.0.0", "<=1.x", False), ("1.9.9", "<=1.x", True), ("2.0.0", ">1.x", True),
    ("1.3.0", ">1.2.x", True), ("1.2.9", ">1.2.x", False), ("1.1.9", "<1.2.x", True), ("1.2.0", "<1.2.x", False),
    ("1.0.0", ">=1", True), ("0.9.0", ">=1", False), ("1.2.9", "<=1.2", True), ("1.3.0", "<=1.2", False),
    ("1.2.3", "1.2.3 - 2.3.4", True), ("2.3.9", "1.2 - 2.3", True), ("2.4.0", "1.2 - 2.3", False),
    ("2.3.5", "1.2.3 - 2.3.4", False), ("9.0.0", "1.0.0 - *", True), ("0.1.0", "* - 1.0.0", True),
    ("1.0.0", "x.1", False), ("1.0.0", "1.x.3", False), ("1.0.0", "", True), ("1.0.0", "*", True), ("1.0.0", "  ", True),
    ("1.0.0-a", "*", False), ("1.0.0-a", ">=0.0.0", False), ("1.0.0", ">*", False), ("1.0.0", ">=*", True), ("1.0.0", "<*", False),
    ("1.0.0", "garbage", False), ("1.0.0", ">= 1.0.0 < 2", True), ("2.0.0", ">= 1.0.0 < 2", False),
    ("3.0.0", "^1 || ^3", True), ("2.0.0", "^1 || ^3", False), ("1.0.0", "^1 || bad^", False), ("1.2.3", "||", True),
    ("1.0.0", "==1.0.0", False), ("1.0.0", "=v1.0.0", True), ("v1.0.0", "1.0.0", True), (" 1.0.0 ", "1.0.0", True),
    ("1.0.0+b", "1.0.0", True), ("1.0.0", "1.0.0+x", True), ("1.2.3", "^9007199254740991.0.0", False),
    ("9007199254740991.0.0", ">=1.0.0", True), ("9007199254740992.0.0", ">=1.0.0", False),
    ("1.2.3", "> =1.2.3", True), ("01.2.3", ">=1.0.0", False), ("1.2.3-01", ">=1.0.0", False), ("1.2", ">=1.0.0", False),
    ("1.2.3-rc.1", ">=1.2.3-rc.1 <2.0.0", True), ("1.2.3-rc.10", ">1.2.3-rc.9", True), ("1.2.4-rc.1", ">1.2.3-rc.9", False),
    ("2.0.0-rc.1", "<2.0.0", False), ("2.0.0-0", "<2.0.0-1", True), ("1.0.0", "^1.0.0 >=1.0.0", True), ("1.0.0", "latest", False),
    ("1.0.0", "npm:x@1", False), ("1.0.0", "lockfile", False), (None, "*", False), ("1.0.0", None, False),
    ("1.0.0-" + "a" * 300, ">=0.0.0", False), ("1.0.0", ">=1.0.0-" + "a" * 300, False), ("1.2.3", "^ 1.2.3", True), ("1.2.3", "~> 1.2", True),
]


def test_written_cases(spark):
    df = spark.createDataFrame(CASES, "v string, r string, e boolean")
    got = df.select("v", "r", "e", V.satisfies(V.strict_key(F.col("v")), V.range_sets(F.col("r"))).alias("g")).collect()
    assert [(x.v, x.r) for x in got if x.e != x.g] == []


# A second, direct reading of the rules: lists of (op, version) compared in Python.


def _identifier(text):
    return (0, int(text), "") if text.isdigit() else (1, 0, text)


def _parse(version):
    core, _, pre = version.partition("-")
    return (*[int(x) for x in core.split(".")], 0 if pre else 1, tuple(_identifier(p) for p in pre.split(".")) if pre else ())


def _matches(version, comparators):
    v = _parse(version)
    tests = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}
    if not all(tests[op](v, _parse(c)) for op, c in comparators):
        return False
    return v[3] == 1 or any(_parse(c)[:3] == v[:3] and _parse(c)[3] == 0 for _, c in comparators)


def _random_version(rng):
    core = ".".join(str(rng.choice([0, 1, 2, 9, 10, 11])) for _ in range(3))
    pre = rng.choice(["", "", "-0", "-alpha", "-alpha.1", "-alpha.10", "-alpha.9", "-alpha.beta", "-beta", "-rc-1", "-1.x"])
    return core + pre


def test_comparator_sets_against_direct_comparison(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(1500):
        sets = [[(rng.choice(["<", "<=", ">", ">=", "="]), _random_version(rng)) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 2))]
        text = " || ".join(" ".join(op + v for op, v in s) for s in sets)
        version = _random_version(rng)
        rows.append((version, text, any(_matches(version, s) for s in sets)))
    df = spark.createDataFrame(rows, "v string, r string, e boolean")
    got = df.select("v", "r", "e", V.satisfies(V.strict_key(F.col("v")), V.range_sets(F.col("r"))).alias("g")).collect()
    assert [x for x in got if x.e != x.g] == []
    assert 0.05 < sum(x.e for x in got) / len(got) < 0.95


def test_caret_and_tilde_against_their_definition(spark):
    versions = [".".join(map(str, p)) for p in itertools.product((0, 1, 2), repeat=3)]

    def caret(base):
        a, b, c = map(int, base.split("."))
        top = f"{a + 1}.0.0-0" if a else f"0.{b + 1}.0-0" if b else f"0.0.{c + 1}-0"
        return [(">=", base), ("<", top)]

    def tilde(base):
        a, b, _ = map(int, base.split("."))
        return [(">=", base), ("<", f"{a}.{b + 1}.0-0")]

    rows = [
        (v, op + base, _matches(v, rule(base)))
        for v in versions for base in versions for op, rule in (("^", caret), ("~", tilde))
    ]
    df = spark.createDataFrame(rows, "v string, r string, e boolean")
    got = df.select("e", V.satisfies(V.strict_key(F.col("v")), V.range_sets(F.col("r"))).alias("g")).where("e <> g")
    assert got.count() == 0


def test_key_order_is_version_order(spark):
    rng = random.Random(3)
    versions = sorted({_random_version(rng) for _ in range(400)} | {"123456789012345.0.0", "99999.0.0", "1.0.0-99999999999999999999", "1.0.0-100000000000000000000"})
    df = spark.createDataFrame([(v,) for v in versions], "v string")
    got = [r.v for r in df.select("v", V.strict_key(F.col("v")).alias("k")).orderBy("k").collect()]
    want = sorted(versions, key=cmp_to_key(lambda a, b: (_parse(a) > _parse(b)) - (_parse(a) < _parse(b))))
    assert got == want


def test_lenient_key(spark):
    rows = [("v1.2.3", "1.2.3"), ("= 01.002.3", "1.2.3"), ("1.2.3-rc.01", "1.2.3-rc.1"), ("1.2.3+b.1", "1.2.3")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(V.lenient_key(F.col("a")) == V.lenient_key(F.col("b"))).count() == len(rows)
    bad = spark.createDataFrame([("1.2",), ("x",), ("",), ("1.2.3.4",)], "a string")
    assert bad.where(V.lenient_key(F.col("a")).isNotNull()).count() == 0


@pytest.mark.parametrize(
    "bad,expected",
    [("2.0.0", ("1.9.0", "found")), ("1.0.0", (None, "nothing_below")), ("junk", (None, "unordered")), ("1.5.0", ("1.0.0", "found")), ("1.0.1", ("1.0.0", "found"))],
)
def test_safe_version_reasons(spark, bad, expected):
    versions = spark.createDataFrame(
        [(1, 10, "1.0.0", False), (2, 10, "1.5.0", True), (3, 10, "1.9.0", False), (4, 10, "2.0.0", True), (5, 10, "nonsense", False)],
        "id bigint, package_id bigint, semver string, compromised_window boolean",
    ).withColumn("published_at", F.lit(None).cast("timestamp_ntz"))
    asked = spark.createDataFrame([(10, bad)], "package_id bigint, bad_version string")
    row = N.safe_version(asked, versions).first()
    assert (row.safe_version, row.reason) == expected


def test_safe_version_without_candidates(spark):
    schema = "id bigint, package_id bigint, semver string, compromised_window boolean"
    versions = spark.createDataFrame([(1, 10, "1.0.0", True), (2, 10, "2.0.0", True)], schema).withColumn("published_at", F.lit(None).cast("timestamp_ntz"))
    asked = spark.createDataFrame([(10, "2.0.0"), (11, "2.0.0")], "package_id bigint, bad_version string")
    got = {r.package_id: r.reason for r in N.safe_version(asked, versions).collect()}
    assert got == {10: "all_windowed", 11: "unrecorded"}


def test_max_satisfying_ties_and_misses(spark, scratch):
    versions = spark.createDataFrame(
        [(1, 10, "v1.2.0"), (2, 10, "1.2.0"), (3, 10, "1.3.0-rc.1"), (4, 10, "bad"), (5, 10, "2.0.0")], "id bigint, package_id bigint, semver string"
    )
    asked = spark.createDataFrame([(10, "^1.0.0"), (10, "^1.3.0-0"), (10, "^5"), (10, "nope"), (10, "")], "package_id bigint, constraint_ string")
    got = {r.constraint_: r.semver for r in N.max_satisfying(asked, versions, scratch).collect()}
    assert got == {"^1.0.0": "v1.2.0", "^1.3.0-0": "1.3.0-rc.1", "^5": None, "nope": None, "": "2.0.0"}


def test_bad_version_order(spark):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    versions = spark.createDataFrame(
        [(1, 10, "1.0.0", True), (2, 10, "3.0.0", False), (3, 11, "1.0.0", True), (4, 12, "1.0.0", False), (5, 12, "1.10.0", False)],
        "id bigint, package_id bigint, semver string, compromised_window boolean",
    ).withColumn("published_at", at)
    packages = spark.createDataFrame([(p,) for p in (9, 10, 11, 12)], "id bigint")
    named = spark.createDataFrame([(10, "2.0.0"), (10, "10.0.0"), (10, "99.0.0-rc.1"), (12, None)], "package_id bigint, exact_version string")
    got = {r.package_id: (r.bad_version, r.source, r.windowed) for r in N.bad_version(packages, versions, named).collect()}
    assert got == {9: (None, None, False), 10: ("10.0.0", "malicious", True), 11: ("1.0.0", "windowed", True), 12: ("1.10.0", "newest", False)}
    requested = spark.createDataFrame([(12, "7.7.7")], "package_id bigint, semver string")
    asked = {r.package_id: (r.bad_version, r.source, r.windowed) for r in N.bad_version(packages, versions, named, requested).collect()}
    assert asked[12] == ("7.7.7", "requested", True)
