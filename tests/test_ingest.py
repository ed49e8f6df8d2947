"""Whole ingest, advisories, upserts, ids and the streaming jobs."""

import json

import pytest
from pyspark.sql import functions as F

from faultline import schema as X
from faultline.operators import advisories as A
from faultline.operators import remediation as M
from faultline.operators import upsert as U
from faultline.operators.expectations import check
from faultline.operators.store import Buckets, Commits, Part
from faultline.plans import ingest as P
from faultline.session import Scratch
from faultline.sources import lockfiles as L
from faultline.sources import osv as O
from faultline.streaming.advisories import Sweep
from faultline.streaming.rescan import Rescan
from tests.test_lockfiles import MANIFEST, NPM1, YARN, YARN_MANIFEST

IDS = X.IdSpace()
ADVISORY = {
    "id": "MAL-1", "details": "\n bad thing \nmore", "published": "2024-01-01T00:00:00Z", "aliases": ["CVE-1"],
    "affected": [
        {"package": {"name": "a", "ecosystem": "npm"}, "versions": ["1.1.0", "1.1.0"], "ranges": [{"type": "SEMVER", "events": [{"introduced": "1.0.0"}, {"fixed": "1.2.0"}]}]},
        {"package": {"name": "b", "ecosystem": "NPM"}, "versions": [], "ranges": [{"type": "GIT", "events": [{"introduced": "0"}]}, {"type": "SEMVER", "events": [{"introduced": "2"}]}]},
    ],
}


def records(spark, *items):
    lines = spark.createDataFrame([(json.dumps(i),) for i in items], "value string")
    return lines.select(F.from_json("value", O.RECORD).alias("r")).select("r.*")


def test_osv_record_is_scoped_to_each_package(spark):
    got = {r.package: r for r in O.advisories_of(records(spark, ADVISORY, {"id": ""})).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].summary, got["a"].malicious, got["a"].affected_versions, got["a"].aliases) == ("bad thing ", True, ["1.1.0"], ["CVE-1"])
    assert [(r.introduced, r.fixed) for r in got["a"].ranges] == [("1.0.0", "1.2.0")]
    assert [(r.introduced, r.fixed) for r in got["b"].ranges] == [("2", None)]
    first = O.advisories_of(records(spark, ADVISORY), first_only=True).collect()
    assert [r.package for r in first] == ["a"]


@pytest.mark.parametrize("events,pairs", [
    ([{"introduced": "0"}, {"fixed": "1.0.0"}, {"introduced": "2.0.0"}, {"fixed": "2.1.0"}], [("0", "1.0.0"), ("2.0.0", "2.1.0")]),
    ([{"introduced": "1.0.0"}, {"introduced": "2.0.0"}], [("1.0.0", None), ("2.0.0", None)]),
    ([{"introduced": "1.0.0"}, {"last_affected": "1.5.0"}], [("1.0.0", None)]),
    ([{"fixed": "1.0.0"}], [(None, "1.0.0")]), ([], []),
])
def test_event_lists(spark, events, pairs):
    record = {"id": "G", "affected": [{"package": {"name": "p"}, "ranges": [{"type": "SEMVER", "events": events}]}]}
    row = O.advisories_of(records(spark, record)).first()
    assert [(r.introduced, r.fixed) for r in row.ranges] == pairs


def _advisory_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, package_id bigint, malicious boolean, affected_versions array<string>, ranges array<struct<introduced:string,fixed:string>>")


def test_affected_versions(spark, scratch):
    versions = spark.createDataFrame(
        [(1, 10, "1.0.0", False), (2, 10, "1.5.0", False), (3, 10, "1.5.0-rc.1", False), (4, 10, "2.0.0", True), (5, 11, "1.0.0", False), (6, 10, "weird", False)],
        "id bigint, package_id bigint, semver string, compromised_window boolean",
    )
    advisories = _advisory_rows(spark, [("G1", 10, False, ["weird"], [("1.1.0", "2.0.0")]), ("G2", 10, False, [], [(None, "1.0.1")]), ("G3", 11, False, [], [("junk", None)])])
    assert {r.id for r in A.affected_versions(versions, advisories, scratch).collect()} == {1, 2, 6}


def test_applying_advisories_bumps_caps_and_flags_once(spark, scratch):
    packages = spark.createDataFrame([(1, False, 0.05), (2, False, None), (3, True, 1.0), (4, False, 0.85), (5, False, 0.05)], "id bigint, is_compromised boolean, risk_score double")
    versions = spark.createDataFrame([(20, 1, "1.0.0", False)], "id bigint, package_id bigint, semver string, compromised_window boolean")
    none = spark.createDataFrame([], "package_id bigint, advisory_id string")
    rows = [("GHSA-1", 1, False, [], [("0", None)]), ("GHSA-2", 1, False, [], []), ("MAL-1", 2, False, ["9.9.9"], []), ("MAL-2", 3, True, [], []), ("GHSA-3", 4, False, [], []), ("GHSA-4", 99, False, [], [])]
    done = A.apply_advisories(packages, none, versions, _advisory_rows(spark, rows), scratch)
    got = {r.id: (r.risk_score, r.is_compromised, r.newly_flagged, r.new_ids) for r in done.packages.collect()}
    assert got == {1: (0.35, False, False, 2), 2: (1.0, True, True, 1), 3: (1.0, True, False, 1), 4: (0.9, False, False, 1)}
    assert [r.id for r in done.windowed.collect()] == [20]
    assert [(r.package_id, r.semver) for r in done.malicious_releases.collect()] == [(2, "9.9.9")]
    state = packages.join(done.packages.select("id", F.col("risk_score").alias("r"), F.col("is_compromised").alias("c")), "id").select("id", F.col("c").alias("is_compromised"), F.col("r").alias("risk_score"))
    again = A.apply_advisories(state, done.links, versions, _advisory_rows(spark, rows), scratch)
    assert {r.id: r.risk_score for r in again.packages.collect()} == {1: 0.35, 2: 1.0, 3: 1.0, 4: 0.9}
    assert again.packages.where("newly_flagged OR new_ids > 0").count() == 0


def _written(scratch, of):
    """Rows of each table that a scratch area holds under a name."""
    return [df.count() for df, path in scratch._written.values() if path.endswith(f"-{of}")]


def test_releases_of_packages_without_advisories_go_no_further(spark, scratch):
    versions = spark.createDataFrame(
        [(n, 10 + n % 50, f"1.{n}.0", False) for n in range(500)] + [(900, None, "1.0.0", False)],
        "id bigint, package_id bigint, semver string, compromised_window boolean",
    )
    advisories = _advisory_rows(spark, [("G1", 10, False, [], [("1.100.0", "1.300.0")]), ("G2", 10, False, ["1.450.0"], []), ("G3", None, False, [], [("1.0.0", None)])])
    got = {r.id for r in A.affected_versions(versions, advisories, scratch).collect()}
    assert got == {100, 150, 200, 250, 450, 900}  # null stands for a package like any other
    # ten releases of the named package, one of the unnamed, two range bounds
    assert _written(scratch, "asked-releases") == [11] and sorted(_written(scratch, "events")) == [0, 13]


def test_package_state_alone_matches_no_release(spark, scratch):
    packages = spark.createDataFrame([(1, False, 0.05)], "id bigint, is_compromised boolean, risk_score double")
    versions = spark.createDataFrame([(20, 1, "1.0.0", False)], "id bigint, package_id bigint, semver string, compromised_window boolean")
    none = spark.createDataFrame([], "package_id bigint, advisory_id string")
    done = A.apply_advisories(packages, none, versions, _advisory_rows(spark, [("G", 1, False, [], [("0", None)])]), scratch)
    assert done.packages.first().new_ids == 1 and _written(scratch, "events") == []
    assert [r.id for r in done.windowed.collect()] == [20] and len(_written(scratch, "events")) == 2
    assert done.windowed is done.windowed


def test_lookup_and_first_seen(spark):
    packages = spark.createDataFrame([("npm", "b", 0), ("npm", "a", 1), ("npm", "c", 2)], "ecosystem string, name string, position int")
    rows = O.advisories_of(records(spark, ADVISORY))
    assert {(r.key, r.advisory_id) for r in A.lookup(packages, rows).collect()} == {("npm:a", "MAL-1"), ("npm:b", "MAL-1"), ("npm:c", None)}
    assert [(r.id, r.package) for r in A.first_seen(packages, rows).collect()] == [("MAL-1", "b")]


def test_null_never_overwrites_and_first_edge_wins(spark):
    current = spark.createDataFrame([(1, "old", 5), (2, "two", None)], "id bigint, name string, n int")
    batch = spark.createDataFrame([(1, None, 7, 1), (1, "mid", None, 2), (1, None, None, 3), (3, "new", None, 1)], "id bigint, name string, n int, seq int")
    got = {r.id: (r.name, r.n) for r in U.upsert_nodes(current, batch, F.col("seq")).collect()}
    assert got == {1: ("mid", 7), 2: ("two", None), 3: ("new", None)}
    edges = spark.createDataFrame([(1, 2, "keep", "x")], "src bigint, dst bigint, a string, b string").withColumn("eid", X.edge_id("T", F.col("src"), F.col("dst")))
    updates = spark.createDataFrame([(1, 2, None, "first", 1), (1, 2, "late", "late", 2), (3, 4, "n", "n", 1)], "src bigint, dst bigint, a string, b string, seq int")
    got = {(r.src, r.dst): (r.a, r.b) for r in U.upsert_edges(edges, updates, "T", F.col("seq")).collect()}
    assert got == {(1, 2): ("keep", "first"), (3, 4): ("n", "n")}


def test_ids_are_reused_and_continue_after_the_highest(spark, scratch):
    known = spark.createDataFrame([("b", 1_000_007)], "key string, id bigint")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "key string")
    got = {r.key: (r.id, r.created) for r in U.allocate_ids(keys, known, 1_000_000, scratch).collect()}
    assert got == {"a": (1_000_008, True), "b": (1_000_007, False), "c": (1_000_009, True)}
    empty = known.where("false")
    assert {r.key: r.id for r in U.allocate_ids(keys, empty, 1_000_000, scratch).collect()} == {"a": 1_000_000, "b": 1_000_001, "c": 1_000_002}
    with pytest.raises(Exception, match="no id left"):
        U.allocate_ids(keys, empty, 1_000_000, scratch, span=2).collect()


def test_expectations(spark):
    metrics = spark.createDataFrame([("a", 1.0), ("b", 5.0)], "metric string, actual double")
    expected = spark.createDataFrame([("a", "eq", 1.0), ("a", "gte", 2.0), ("b", "lte", 5.0), ("c", "eq", 0.0)], "metric string, op string, expected double")
    assert {(r.metric, r.op): r.ok for r in check(metrics, expected).collect()} == {("a", "eq"): True, ("a", "gte"): False, ("b", "lte"): True, ("c", "eq"): False}


def test_manifest_overrides(spark):
    text = json.dumps({"name": "x", "overrides": {"keep": "1.0.0", "nested": {"deep": "2.0.0"}, "bad": "0.1.0"}, "dependencies": {"bad": "^1", "ok": "^2"}})
    df = spark.createDataFrame([(text, {"bad": "1.4.0"})], "t string, pins map<string,string>").select(F.from_json("t", M.MANIFEST).alias("m"), "pins")
    m, pins = F.col("m"), F.col("pins")
    row = df.select(M.merge_overrides(m, pins).alias("o"), M.pin_direct(m, "dependencies", pins).alias("d"), M.declares(m, F.lit("bad")).alias("yes"), M.declares(m, F.lit("keep")).alias("no")).first()
    assert row.o == {"keep": "1.0.0", "nested": '{"deep":"2.0.0"}', "bad": "1.4.0"}
    assert row.d == {"bad": "1.4.0", "ok": "^2"} and row.yes and not row.no
    ranges = spark.createDataFrame([("=4.28.0",), ("^1.0.0",), ("=junk",), ("=v01.2.3",)], "c string")
    assert [r[0] for r in ranges.select(M.manifest_range(F.col("c"))).collect()] == ["^4.28.0", "^1.0.0", "=junk", "^1.2.0"]
    files = spark.createDataFrame([("yarn.lock",), ("pnpm-lock.yaml",), ("package-lock.json",), ("what",)], "f string")
    assert [tuple(r) for r in files.select(M.manager(F.col("f")), M.override_field(F.col("f"))).collect()] == [
        ("yarn", "resolutions"), ("pnpm", "pnpm.overrides"), ("npm", "overrides"), ("npm", "overrides")]


def _inputs(spark):
    documents = spark.createDataFrame(
        [("n1", "org/one", "package-lock.json", json.dumps(NPM1), MANIFEST), ("y", "org/two", "yarn.lock", YARN, YARN_MANIFEST), ("bad", "org/two", "web/package-lock.json", "<html>", None)],
        "doc string, repo string, path string, text string, manifest string",
    )
    packages = spark.createDataFrame([("a", 40, "1.1.0"), ("b", 2_000_000, "2.1.0"), ("d", None, "3.0.0")], "name string, downloads_weekly bigint, latest string")
    publications = spark.createDataFrame([("a", "1.1.0", "2024-01-01 00:00:00"), ("a", "1.0.0", "2023-01-01 00:00:00")], "name string, semver string, t string").select("name", "semver", F.col("t").cast("timestamp_ntz").alias("published_at"))
    owners = spark.createDataFrame([("a", "ann", "ann@x"), ("b", "ann", "ann@x"), ("zz", "zed", None)], "name string, username string, email string")
    return documents, P.Metadata(packages, publications, owners), O.advisories_of(records(spark, ADVISORY))


def test_ingest_twice_changes_nothing(spark, scratch):
    documents, metadata, advisories = _inputs(spark)
    good = documents.where("doc <> 'bad'")
    parsed = L.parse_documents(good, scratch)
    parsed = L.Parsed(scratch.keep(parsed.releases, "r"), scratch.keep(parsed.edges, "e"))
    none = F.lit(None).cast("string")
    scan = P.Scan(
        good.select("repo").distinct().select("repo", none.alias("repo_url"), none.alias("commit_hash")),
        good.select("doc", "repo", "path", L.kind_of(F.col("path")).alias("kind")), parsed,
    )
    first, report = P.ingest(P.Store.empty(spark), scan, metadata, advisories, IDS, scratch)
    counts = {r.kind: r.touched for r in report.collect()}
    assert counts == {
        "Service": 2, "Package": 7, "Version": 9, "Lockfile": 2, "Maintainer": 1, "DEPENDS_ON": 13, "RESOLVED_IN": 18,
        "MAINTAINED_BY": 2, "TYPOSQUAT_OF": counts["TYPOSQUAT_OF"], "newly_flagged": 2,
    }
    state = {r.name: (r.is_compromised, r.risk_score, r.downloads_weekly) for r in first.nodes[X.PACKAGE].collect()}
    assert state["a"] == (True, 1.0, 40) and state["e"] == (False, 0.05, None)
    windows = {r.name for r in first.nodes[X.VERSION].where("compromised_window").collect()}
    assert windows == {"a@1.1.0", "b@2.0.0", "b@2.1.0"}
    depth = {r.constraint_: r.transitive_depth for r in first.edges[X.DEPENDS_ON].collect()}
    assert depth["lockfile"] == 0 and depth["^2.0.0"] == 2 and depth["npm:real@^3"] == 1
    since = {r.src: r.since for r in first.edges[X.MAINTAINED_BY].collect()}
    assert sorted(str(s) for s in since.values()) == ["2023-01-01 00:00:00", "None"]

    second, again = P.ingest(first, scan, metadata, advisories, IDS, scratch)
    assert {r.kind: r.touched for r in again.collect()} == {**counts, "newly_flagged": 0}
    for name, table in first.tables().items():
        other = second.tables()[name]
        assert table.exceptAll(other).count() == 0 and other.exceptAll(table).count() == 0, name


def test_store_keeps_untouched_buckets(spark, tmp_path):
    rows = spark.range(2000).select("id", F.concat(F.lit("k"), "id").alias("key"), F.lit("old").alias("name"), F.lit(None).cast("string").alias("email"))
    table = Buckets(spark, P.NODE_COLUMNS[X.MAINTAINER], "key", 16)
    first = table.rewritten(rows, table.touched(rows), str(tmp_path / "one"))
    assert len(first.folders) == 16 and first.read().count() == 2000
    change = spark.createDataFrame([(7, "k7", "new")], "id bigint, key string, name string")
    part = Part(first, change)
    part.rows = U.upsert_nodes(part.rows, change, F.lit(0))
    second = part.written(str(tmp_path / "two"))
    moved = [b for b in range(16) if second.folders[b] != first.folders[b]]
    assert len(moved) == 1 and second.read().count() == 2000
    assert {(r.key, r.name) for r in second.read().where("name = 'new'").collect()} == {("k7", "new")}
    assert {r.key for r in part.whole().collect()} == {r.key for r in rows.collect()}
    commits = Commits(spark, str(tmp_path / "log"))
    commits.begin()
    assert commits.latest() == -1
    commits.write(4, -1, {X.MAINTAINER: second}, {X.MAINTAINER: 2000})
    commits.begin()
    assert (commits.latest(), commits.latest(before=4)) == (4, -1)
    assert commits.read(4) == ({X.MAINTAINER: second.folders}, {X.MAINTAINER: 2000})


def test_snapshot_manifest(spark, tmp_path):
    tables = {"one": spark.range(3), "none": spark.range(0)}
    assert {r.table: r.rows for r in U.write_snapshot(tables, str(tmp_path / "snap")).collect()} == {"one": 3, "none": 0}
    assert spark.read.json(str(tmp_path / "snap" / "one")).count() == 3


def test_sweep_is_idempotent_and_monotone(spark, tmp_path):
    packages = spark.createDataFrame([(1, "a", "npm", False, 0.05), (2, "b", "npm", False, 0.05)], "id bigint, name string, ecosystem string, is_compromised boolean, risk_score double")
    versions = spark.createDataFrame([(10, 1, "1.1.0", False), (20, 2, "2.5.0", False)], "id bigint, package_id bigint, semver string, compromised_window boolean")
    sweep = Sweep(spark, str(tmp_path / "state"), packages, versions).prepare()
    mild = {"id": "GHSA-9", "affected": [{"package": {"name": "a", "ecosystem": "npm"}, "ranges": []}]}
    sweep.on_batch(sweep.matched(records(spark, ADVISORY)), 0)
    sweep.on_batch(sweep.matched(records(spark, ADVISORY)), 0)  # replay
    sweep.on_batch(sweep.matched(records(spark, ADVISORY, mild)), 1)  # seen before, plus one new
    state = {r.id: (r.is_compromised, r.risk_score, r.new_ids) for r in sweep.current().collect()}
    assert state == {1: (True, 1.0, 2), 2: (True, 1.0, 1)}
    deltas = {r.batch: (r.advisories, r.newly_flagged, r.newly_windowed) for r in sweep.deltas().collect()}
    assert deltas == {0: (2, 2, 2), 1: (3, 0, 0)}
    assert {r.id for r in sweep.raised().collect()} == {10, 20}
    preview = {r.key: (r.advisories, r.malicious) for r in sweep.preview(records(spark, mild)).collect()}
    assert preview == {"npm:a": (1, 0), "npm:b": (0, 0)}


def test_sweep_resumes_from_files(spark, tmp_path):
    packages = spark.createDataFrame([(1, "a", "npm", False, 0.05)], "id bigint, name string, ecosystem string, is_compromised boolean, risk_score double")
    versions = spark.createDataFrame([(10, 1, "1.1.0", False), (11, 1, "7.0.0", False)], "id bigint, package_id bigint, semver string, compromised_window boolean")
    drop = tmp_path / "drop"
    drop.mkdir()
    sweep = Sweep(spark, str(tmp_path / "state"), packages, versions, compact_every=2).prepare()
    wider = {**ADVISORY, "affected": [{"package": {"name": "a", "ecosystem": "npm"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "7.0.0"}]}]}]}
    # the second file repeats the first; the fourth has the same id with other contents
    for n, record in enumerate((ADVISORY, ADVISORY, {**ADVISORY, "id": "GHSA-2"}, wider, ADVISORY)):
        (drop / f"{n}.json").write_text(json.dumps(record))
        Sweep(spark, str(tmp_path / "state"), packages, versions, compact_every=2).prepare().run_once(str(drop))
    told = [(r.advisories, r.newly_flagged, r.newly_windowed) for r in sweep.deltas().where("advisories > 0").orderBy("batch").collect()]
    assert told == [(1, 1, 1), (1, 0, 0), (1, 0, 1)]  # repeats never reach a batch
    assert sweep.current().first().new_ids == 2 and {r.id for r in sweep.raised().collect()} == {10, 11}
    # batches are merged: only the runs after the pointer are read
    assert sweep.merged_upto() >= sweep.last_batch() - 2 and sweep.merged_upto() >= 1
    before = (sweep.deltas().count(), sweep.raised().count())
    sweep.compact(sweep.last_batch())
    assert (sweep.deltas().count(), sweep.raised().count()) == before and sweep.merged_upto() == sweep.last_batch()
    sweep.on_batch(sweep.matched(records(spark, ADVISORY)), sweep.last_batch())  # a replay of a merged batch
    assert (sweep.deltas().count(), sweep.raised().count()) == before


def _put(root, path, text):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)


def test_rescan_quarantines_and_accumulates(spark, tmp_path):
    documents, metadata, advisories = _inputs(spark)
    root = tmp_path / "tree"
    job = Rescan(spark, str(tmp_path / "state"), metadata, advisories, IDS, buckets=32).prepare()
    for row in documents.where("doc <> 'y'").collect():
        _put(root, f"{row.repo.replace('/', '-')}/r1/{row.path}", row.text)
        if row.manifest:
            _put(root, f"{row.repo.replace('/', '-')}/r1/package.json", row.manifest)
    _put(root, "org-two/r1/other/yarn.lock", "<html>\n")
    _put(root, "org-two/r1/node_modules/x/yarn.lock", "skipped")
    first = job.run_once(str(root))
    assert job.run_once(str(root)) == first  # nothing new
    y = documents.where("doc = 'y'").first()
    _put(root, f"org-two/r2/{y.path}", y.text)
    again = Rescan(spark, str(tmp_path / "state"), metadata, advisories, IDS, buckets=32).prepare()
    second = again.run_once(str(root))
    assert second > first
    _put(root, "org-two/r2/package.json", y.manifest)  # comes after its lockfile
    third = again.run_once(str(root))
    assert third > second and again.run_once(str(root)) == third
    store = again.snapshot(third)
    assert {r.name: r.commit_hash for r in store.nodes[X.LOCKFILE].collect()} == {"org-one/package-lock.json": "r1", "org-two/yarn.lock": "r2"}
    assert {r.name for r in store.nodes[X.SERVICE].collect()} == {"org-one", "org-two"}
    assert {r.name for r in store.nodes[X.PACKAGE].collect()} == {"a", "b", "c", "@s/x", "@s/y", "d", "e"}
    assert {(r.doc, r.reason) for r in again.quarantined().collect()} == {("org-two/web/package-lock.json", "not a JSON object"), ("org-two/other/yarn.lock", "no entries")}
    # the last batch read one folder: buckets without its keys are those of earlier versions
    before, after = again.snapshot(second), store
    kept = [b for b, folder in before.parts[X.VERSION].folders.items() if after.parts[X.VERSION].folders[b] == folder]
    assert kept and any(folder not in before.parts[X.VERSION].folders.values() for folder in after.parts[X.VERSION].folders.values())


def test_rescan_ends_where_a_single_ingest_ends(spark, scratch, tmp_path):
    documents, metadata, advisories = _inputs(spark)
    root = tmp_path / "tree"
    job = Rescan(spark, str(tmp_path / "state"), metadata, advisories, IDS).prepare()
    last = -1
    for row in documents.where("doc <> 'bad'").orderBy("doc").collect():
        _put(root, f"{row.repo.replace('/', '-')}/r1/{row.path}", row.text)
        _put(root, f"{row.repo.replace('/', '-')}/r1/package.json", row.manifest)
        last = job.run_once(str(root))
    good = documents.where("doc <> 'bad'").withColumn("repo", F.replace("repo", F.lit("/"), F.lit("-")))
    scan = P.Scan(
        good.select("repo").distinct().select("repo", F.lit(None).cast("string").alias("repo_url"), F.lit("r1").alias("commit_hash")),
        good.select("doc", "repo", "path", L.kind_of(F.col("path")).alias("kind")), L.parse_documents(good, scratch),
    )
    whole, _ = P.ingest(P.Store.empty(spark), scan, metadata, advisories, IDS, scratch)
    stepwise = job.snapshot(last)
    for name, column in [(label, "name") for label in P.NODE_COLUMNS]:
        rest = [c for c in whole.parts[name].read().columns if c not in ("id", "package_id", "service_id")]
        assert sorted(map(tuple, stepwise.parts[name].read().select(*rest).collect()), key=repr) == sorted(map(tuple, whole.parts[name].read().select(*rest).collect()), key=repr), name
    for kind in P.EDGE_COLUMNS:
        rest = [c for c in whole.parts[kind].read().columns if c not in ("eid", "src", "dst")]
        assert sorted(map(tuple, stepwise.parts[kind].read().select(*rest).collect()), key=repr) == sorted(map(tuple, whole.parts[kind].read().select(*rest).collect()), key=repr), kind


def test_a_larger_tree_comes_in_larger_batches():
    from faultline.catalog.streams import BATCHES, MOST_FILES, files_per_batch

    assert files_per_batch(10) == files_per_batch(8_000) == 4_000
    for files in (60_000, 360_000, 400_000):
        assert -(-files // files_per_batch(files)) <= BATCHES
    assert files_per_batch(10**8) == MOST_FILES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_rows_are_written_by_several_tasks_and_empty_tables_cost_nothing(spark, tmp_path):
    table = Buckets(spark, P.NODE_COLUMNS[X.MAINTAINER], "key", 16)
    assert "LocalTableScan <empty>" in _plan(table.read()) and table.read().columns == ["id", "key", "name", "email"]
    rows = spark.range(400).select("id", F.concat(F.lit("k"), "id").alias("key"), F.lit("x").alias("name"), F.lit(None).cast("string").alias("email"))
    # nothing to merge with: rows are not moved again to meet a table without any
    assert "FullOuter" not in _plan(U.upsert_nodes(table.read(), rows, F.lit(0)))
    first = table.rewritten(rows, table.touched(rows), str(tmp_path / "one"))
    written = [p for p in (tmp_path / "one").rglob("part-*.parquet")]
    assert len(first.folders) == 16 == len(written) and len({p.name.split("-")[1] for p in written}) > 1
    assert sorted(r.id for r in first.read().collect()) == list(range(400))


def test_every_file_of_a_folder_is_read_once(spark, tmp_path):
    root = tmp_path / "tree"
    _put(root, "one/r1/package-lock.json", "{}")
    _put(root, "one/r1/yarn.lock", "text")
    _put(root, "one/r1/package.json", "manifest")
    _put(root, "two/r2/web/package-lock.json", "alone")
    _put(root, "two/r2/package.json", "of another folder")
    _put(root, "three/r1/package-lock.json", "not asked for")
    folders = spark.createDataFrame([(f"file:{root}/{f}",) for f in ("one/r1", "one/r1", "two/r2/web")], "folder string")
    found = L.read_folders(spark, folders, str(root))
    assert _plan(found).count("binaryFile") == 1
    assert {(r.doc, r.revision, r.text, r.manifest) for r in found.collect()} == {
        ("one/package-lock.json", "r1", "{}", "manifest"), ("one/yarn.lock", "r1", "text", "manifest"), ("two/web/package-lock.json", "r2", "alone", None),
    }
    assert found.count() == 3


def test_a_rescan_leaves_the_settings_of_the_session(spark, tmp_path):
    _, metadata, advisories = _inputs(spark)
    names = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name, None) for name in names]
    with pytest.raises(Exception):
        Rescan(spark, str(tmp_path / "state"), metadata, advisories, IDS).prepare().run_once(str(tmp_path / "absent"))
    assert [spark.conf.get(name, None) for name in names] == before
