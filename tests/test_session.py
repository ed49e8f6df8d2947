"""What the graph queries set on a session."""

from pyspark.sql import functions as F

from faultline.session import MOST_BROADCAST, weigh_files

SETTINGS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_no_join_sends_a_large_table_through_the_driver(spark):
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    try:
        for given, want in (("10MB", str(MOST_BROADCAST)), ("10485760b", str(MOST_BROADCAST)), ("256k", "256k"), ("-1", "-1")):
            spark.conf.set(SETTINGS[0], given)
            weigh_files(spark)
            assert spark.conf.get(SETTINGS[0]) in (want, want + "b")
        # a session that sets nothing has Spark's own 10 MB
        for name in SETTINGS:
            spark.conf.unset(name)
        weigh_files(spark)
        long = spark.range(300_000).withColumn("x", F.col("id") * 2)  # 4.8 MB
        assert "BroadcastHashJoin" not in spark.range(10**7).join(long, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_a_table_asked_for_by_several_threads_is_derived_once(spark):
    import time

    from faultline.sources.binding import bind
    from faultline.session import together

    graph, built = bind(spark, "/absent"), []

    def build():
        built.append(1)
        time.sleep(0.3)
        return "table"

    assert together({n: lambda: graph.once("t", build) for n in range(4)}) == dict.fromkeys(range(4), "table") and len(built) == 1
