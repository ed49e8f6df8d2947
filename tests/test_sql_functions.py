"""Functions under SQL names give what the column functions give."""

from pyspark.sql import functions as F

from faultline.functions import names as N
from faultline.functions import semver as V
from faultline.functions import sql as Q

VERSIONS = ["1.2.3", "v1.0.0-rc.1+b", " 1.2.3 ", "01.2.3", "=1.2.3-0a.01", "bad", "1.2", "9007199254740993.0.0", "1.2.3-alpha.10", "", None, "rn-O1.vv"]
RANGES = ["^1.0.0", "~1.2", "nope", ">=1.2.3-alpha <2", "*", "1.x || >=9", None]


def test_sql_functions(spark, scratch):
    Q.register(spark, spark.createDataFrame([(r,) for r in RANGES], "constraint_ string"), scratch)
    asked = spark.createDataFrame([(v, r) for v in VERSIONS for r in [*RANGES, "unlisted"]], "v string, r string")
    asked.createOrReplaceTempView("asked")
    got = spark.sql("SELECT v, r, satisfies(v, r) AS s, semver_key(v) AS k, semver_lenient_key(v) AS l, normalize_name(v) AS n FROM asked")
    v, r = F.col("v"), F.col("r")
    known = F.when(r == "unlisted", False).otherwise(V.satisfies(V.strict_key(v), V.range_sets(r)))
    want = asked.select("v", "r", known.alias("s"), V.strict_key(v).alias("k"), V.lenient_key(v).alias("l"), N.fold(v).alias("n"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sum(row.s for row in got.collect()) > 8
    assert "Python" not in got._jdf.queryExecution().toString()
