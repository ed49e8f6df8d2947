"""The refined plan from the releases of the roots alone, on own rows with null, double and unlisted keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultline import schema as X
from faultline.catalog import precision as C
from faultline.catalog import reports as R
from faultline.catalog.versions import chosen, incidents, safe
from faultline.operators import precision as P
from faultline.operators import remediation as M
from faultline.sources.binding import bind

TABLES = {
    "part": "p_partkey bigint, p_name string",
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz, value double",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    rng = random.Random(18)
    day = lambda: dt.datetime(1998, 5, 1) + dt.timedelta(days=rng.randrange(90))
    rows = {
        # 7 twice, 39 and 40 not listed
        "part": [(k, f"red part{k}") for k in [*range(1, 39), 7]],
        "customer": [(k, f"c{k}", rng.choice(["MACHINERY", "BUILDING", None])) for k in range(1, 13)],
        "orders": [(k, rng.choice([None, *range(1, 13)]), rng.choice(["1-URGENT", "1-URGENT", "2-HIGH"]), day()) for k in range(1, 121)],
        "lineitem": [
            (o, rng.choice([None, *range(1, 41)]), n, float(rng.randrange(1, 50)), rng.randrange(11) / 100, rng.choice("RN"), rng.choice([None, day(), day()]))
            for o in range(1, 121) for n in range(1, 8) for _ in range(rng.choice([1, 1, 2])) if rng.random() < 0.6
        ],
        "events": [(k, rng.randrange(1, 41), rng.choice(["error", "click"]), day(), rng.random() * 9) for k in range(0, 200, 2)],
    }
    folder = tmp_path_factory.mktemp("tables")
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).write.parquet(f"{folder}/{name}.parquet")
    return bind(spark, str(folder))


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_refined_plan_reads_the_releases_of_roots_alone(graph):
    got = rows_of(R.planned(graph, refined=True))
    assert not {"version", "located", "package", "closure"} & set(graph._kept)

    # the same plan from every release and the marked closure
    bad = chosen(graph).select(F.col("package_id").alias("root"), "bad_version", "windowed", "published_at").join(graph.roots, "root", "left_semi")
    assert rows_of(incidents(graph)) == rows_of(bad)
    pins = P.lockfile_pins(graph.located, graph.version, bad, graph.ids)
    live = pins.where("windowed").select("root", F.col("node").alias("lockfile_id")).distinct()
    safe_ = safe(graph).withColumnRenamed("package_id", "root").join(graph.roots, "root", "left_semi")
    assert rows_of(R.safe_for_roots(graph)) == rows_of(safe_)
    refined = P.refine(graph.dependents, graph.closure(6), bad, P.hop1_gate(graph.depends_on, bad), P.clean_lockfiles(pins), 6, graph.scratch)
    exposed = refined.where("kept").where(graph.ids.is_label(F.col("node"), X.SERVICE)).select("root", F.col("node").alias("service_id"))
    want = M.plan(graph.lockfile, graph.service, R.pinned(graph), live, safe_, exposed)
    assert got and got == rows_of(want)


def test_roots_are_all_packages_with_a_windowed_release(graph):
    want = graph.version.where("compromised_window").select(F.col("package_id").alias("root")).distinct()
    assert rows_of(graph.roots) == rows_of(want)
    # the unlisted package has no incident and keeps its whole closure
    unlisted = graph.roots.join(incidents(graph), "root", "left_anti").where("root IS NOT NULL")
    before, after = (rows_of(df.select("root", "node").join(unlisted, "root", "left_semi")) for df in (graph.closure(6), C.kept(graph)))
    assert before and before == after
