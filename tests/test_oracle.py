"""Every registered query against its SQL, and on a copy of the tables with hot keys."""

import duckdb
import pytest

from check import TABLES, compare, connect
from faultline.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
# A third of the line items on one part, a third of the rest on one order, and so on.
HOT = {
    "lineitem": "SELECT * REPLACE (CASE WHEN i%3=0 THEN 150 ELSE l_partkey END AS l_partkey, CASE WHEN i%5=0 THEN (SELECT min(o_orderkey) FROM 'DIR/orders.parquet' WHERE o_orderpriority='1-URGENT') ELSE l_orderkey END AS l_orderkey, "
    "CASE WHEN i%4=0 THEN 3 ELSE l_suppkey END AS l_suppkey) FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_shipdate,l_quantity) AS i FROM 'DIR/lineitem.parquet')",
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey%3=0 THEN 7 ELSE o_custkey END AS o_custkey) FROM 'DIR/orders.parquet'",
    "events": "SELECT * REPLACE (CASE WHEN event_id%3=0 THEN 3 ELSE user_id END AS user_id) FROM 'DIR/events.parquet'",
}
ON_HOT_KEYS = (
    "closure_depth6 routes blast_radius refined_closure refined_blast version_history max_satisfying safe_version maintainer_risk "
    "timeline incident_report remediation_plan override_merge advisory_match apply_advisories lock_npm lock_npm_v1 lock_yarn lock_pnpm "
    "dev_reachability transitive_depth ingest_report ingest_packages rescan_stream"
).split()


def hot_copy(folder: str) -> str:
    db = duckdb.connect()
    for table in TABLES:
        statement = HOT.get(table, f"SELECT * FROM 'DIR/{table}.parquet'").replace("DIR", SMALL)
        columns = [c[0] for c in db.execute(f"DESCRIBE SELECT * FROM '{SMALL}/{table}.parquet'").fetchall()]
        db.execute(f"COPY (SELECT {','.join(columns)} FROM ({statement})) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return folder


@pytest.fixture(scope="module")
def small():
    return connect(SMALL)


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    folder = hot_copy(str(tmp_path_factory.mktemp("hot")))
    return folder, connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, name):
    assert name in ORACLES
    problem = compare(spark, small, name, SMALL)
    assert problem is None or problem == "equal but empty"


@pytest.mark.parametrize("name", ON_HOT_KEYS)
def test_query_equals_sql_on_hot_keys(spark, hot, name):
    folder, db = hot
    assert compare(spark, db, name, folder) is None
