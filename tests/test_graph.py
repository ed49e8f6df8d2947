"""Closures, routes, refinement and numbering on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from faultline import schema as X
from faultline.operators import closure as C
from faultline.operators import precision as P
from faultline.operators import routes as R
from faultline.operators.ordering import number_rows, rank_within
from faultline.operators.skew import split_hot
from faultline.sources import binding

IDS = X.IdSpace()


def edge_set(spark, scratch, pairs, hot_rows=2_000_000):
    df = spark.createDataFrame(pairs, "src bigint, dst bigint")
    return split_hot(df.distinct(), "dst", "src", scratch, hot_rows)


def walk(pairs, root, depth, first=(), blocked=()):
    dependents = {}
    for src, dst in pairs:
        dependents.setdefault(dst, set()).add(src)
    seen, level = {root: 0}, {root}
    for hop in range(1, depth + 1):
        level = {
            s for n in level for s in dependents.get(n, ())
            if s not in seen and s not in blocked and not (n == root and s in first)
        }
        seen.update({s: hop for s in level})
    seen.pop(root)
    return seen


def chains(pairs, root, depth):
    dependents = {}
    for src, dst in set(pairs):
        dependents.setdefault(dst, set()).add(src)
    out, level = [], [[root]]
    for _ in range(depth):
        level = [c + [s] for c in level for s in dependents.get(c[-1], ()) if s not in c]
        out += level
    return sorted(out, key=lambda c: (len(c), c))


@pytest.fixture(scope="module")
def cyclic():
    rng = random.Random(5)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(90)]
    return pairs + [(i, 0) for i in range(1, 30)]  # node 0 is a hub


@pytest.mark.parametrize("hot_rows", [2_000_000, 4])
def test_unbounded_reach_equals_breadth_first_search(spark, scratch, cyclic, hot_rows):
    chain = cyclic + [(100 + i + 1, 100 + i) for i in range(30)]  # far beyond any bound
    edges = edge_set(spark, scratch, chain, hot_rows)
    roots = spark.createDataFrame([(r,) for r in (0, 3, 7, 100, 999)], "root bigint")
    got = {}
    for row in C.reach_all(edges, roots, scratch).collect():
        got.setdefault(row.root, {})[row.node] = row.depth
    assert got == {r: w for r in (0, 3, 7, 100, 999) if (w := walk(chain, r, 100))}
    assert not spark.catalog.listTables()


def test_a_hop_shuffles_the_frontier_alone(spark, scratch):
    known = C.Grown(scratch, "root bigint, node bigint, depth int", ["root", "node"], "known")
    for hop in (1, 2):
        known.append(spark.range(500).select(F.col("id").alias("root"), (F.col("id") * hop).alias("node"), F.lit(hop).alias("depth")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = scratch.keep(spark.range(500).select(F.col("id").alias("root"), (F.col("id") * 3).alias("node")), "frontier").distinct()
        fresh = found.join(known.read().select("root", "node"), ["root", "node"], "left_anti")
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
        assert fresh.count() == 499
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        known.release()


@pytest.mark.parametrize("hot_rows", [2_000_000, 4])
def test_reach_equals_breadth_first_search(spark, scratch, cyclic, hot_rows):
    edges = edge_set(spark, scratch, cyclic, hot_rows)
    assert (edges.hot is not None) == (hot_rows == 4)
    roots = spark.createDataFrame([(r,) for r in range(40)], "root bigint")
    got = {}
    for row in C.reach(edges, roots, 3, scratch).collect():
        got.setdefault(row.root, {})[row.node] = row.depth
    assert got == {r: w for r in range(40) if (w := walk(cyclic, r, 3))}


def test_reach_with_blocked_edges_and_nodes(spark, scratch, cyclic):
    edges = edge_set(spark, scratch, cyclic)
    roots = spark.createDataFrame([(0,), (1,)], "root bigint")
    first = spark.createDataFrame([(0, 3), (0, 4), (1, 2)], "root bigint, node bigint")
    blocked = spark.createDataFrame([(0, 7), (1, 9)], "root bigint, node bigint")
    got = {0: {}, 1: {}}
    for row in C.reach(edges, roots, 8, scratch, first_hop_blocked=first, blocked=blocked).collect():
        got[row.root][row.node] = row.depth
    assert got == {0: walk(cyclic, 0, 8, {3, 4}, {7}), 1: walk(cyclic, 1, 8, {2}, {9})}


def test_reach_without_any_dependent(spark, scratch):
    edges = edge_set(spark, scratch, [(1, 2)])
    assert C.reach(edges, spark.createDataFrame([(9,)], "root bigint"), 6, scratch).count() == 0


@pytest.mark.parametrize("cap,hot_rows", [(7, 2_000_000), (400, 4), (None, 2_000_000)])
def test_routes_equal_enumeration(spark, scratch, cyclic, cap, hot_rows):
    edges = edge_set(spark, scratch, cyclic, hot_rows)
    roots = spark.createDataFrame([(r,) for r in range(0, 40, 3)], "root bigint")
    got = {}
    for row in R.routes(edges, roots, 3, scratch, cap).orderBy("root", "rank").collect():
        got.setdefault(row.root, []).append(list(row.chain))
    want = {r: chains(cyclic, r, 3)[:cap] for r in range(0, 40, 3)}
    assert got == {r: w for r, w in want.items() if w}


def test_truncated_roots_and_infection_edges(spark, scratch):
    """A hub with more dependents than the cap, a chain behind it, and a cycle."""
    pairs = [(i, 1) for i in range(100, 550)] + [(2000, 549), (2001, 2000), (1, 2001), (100, 2001)] + [(31, 30), (30, 31)]
    edges = edge_set(spark, scratch, pairs)
    roots = spark.createDataFrame([(1,), (30,)], "root bigint")
    found = R.routes(edges, roots, 6, scratch, 400)
    got = {}
    for row in found.orderBy("root", "rank").collect():
        got.setdefault((row.root, row.truncated), []).append(list(row.chain))
    assert got == {(1, True): chains(pairs, 1, 6)[:400], (30, False): [[30, 31]]}
    closure = C.reach(edges, roots, 6, scratch)
    depths = {(r.root, r.node): r.depth for r in closure.collect()}
    assert depths[1, 2000] == 2 and depths[1, 2001] == 3
    near = {(r, n) for (r, n), d in depths.items() if d < 6} | {(1, 1), (30, 30)}
    want = {(r, dst, src) for r, n in near for src, dst in pairs if dst == n and src != r}
    assert {tuple(r) for r in R.infection_edges(edges, roots, closure, 6).collect()} == want
    assert (1, 2001, 100) in want  # back to a nearer node


def test_routes_within_allowed_nodes(spark, scratch, cyclic):
    edges = edge_set(spark, scratch, cyclic)
    roots = spark.createDataFrame([(0,), (5,)], "root bigint")
    allowed = spark.createDataFrame([(r, n) for r in (0, 5) for n in range(40) if (n + r) % 3], "root bigint, node bigint")
    first = spark.createDataFrame([(0, 4), (5, 6)], "root bigint, node bigint")
    got = {}
    for row in R.routes(edges, roots, 3, scratch, 9, first_hop_blocked=first, allowed=allowed).orderBy("root", "rank").collect():
        got.setdefault(row.root, []).append(list(row.chain))
    blocked = {0: 4, 5: 6}
    want = {r: [c for c in chains(cyclic, r, 3) if c[1] != blocked[r] and all((n + r) % 3 for n in c[1:])][:9] for r in (0, 5)}
    assert got == {r: w for r, w in want.items() if w}


def at(label, n):
    return IDS.base(label) + n


# A library with two majors: plugin and theme ask for the old one, cli for the new one; kit asks
# for both ranges through two edges; widget gives no range and odd a text that is none. App one
# is reached through cli, app two through plugin alone, app three through a lock on a bad release.
CORE, PLUGIN, THEME, CLI, KIT, WIDGET, ODD, SKIN = (at(X.PACKAGE, n) for n in (7, 20, 21, 22, 23, 24, 25, 26))
OLD, NEW, LATER = (at(X.VERSION, n) for n in (11, 12, 13))
APP1, APP2, APP3, APP4, APP5 = (at(X.SERVICE, n) for n in (1, 2, 3, 4, 5))
OLD_LOCK, NEW_LOCK = at(X.LOCKFILE, 31), at(X.LOCKFILE, 32)
ASKS = [(PLUGIN, "^1.9.0"), (THEME, "1.x"), (CLI, ">=2.1.0 <3.0.0"), (KIT, "^1.0.0"), (KIT, "^2.0.0"), (WIDGET, None), (ODD, "latest || ???"), (OLD_LOCK, "^1.9.0 || ^2.0.0"), (NEW_LOCK, "2.3.1")]
BEHIND = [(SKIN, THEME), (THEME, CLI), (APP1, CLI), (APP2, PLUGIN), (APP3, NEW_LOCK), (APP4, OLD_LOCK)]


def refinement(spark, scratch, bad="2.3.1", asks=ASKS, flagged=True, pins=((OLD_LOCK, OLD), (NEW_LOCK, NEW))):
    """(kept nodes, gated dependents, radius after, radius before) of the library's bad release."""
    depends = spark.createDataFrame([(s, CORE, c) for s, c in asks] + [(s, d, "*") for s, d in BEHIND], "src bigint, dst bigint, constraint_ string")
    versions = spark.createDataFrame(
        [(OLD, CORE, "1.9.4", False), (NEW, CORE, "2.3.1", flagged), (LATER, CORE, "2.4.0", False)],
        "id bigint, package_id bigint, semver string, compromised_window boolean",
    )
    resolved = spark.createDataFrame([*pins, *((CORE, v) for v in (OLD, NEW, LATER))], "src bigint, dst bigint")
    services = spark.createDataFrame([(APP1, "tier-2"), (APP2, "tier-1"), (APP3, "tier-1"), (APP4, "tier-3"), (APP5, "tier-3")], "id bigint, criticality string")
    fleet = spark.createDataFrame([(5, 2)], "total_services bigint, total_lockfiles bigint")
    incidents = spark.createDataFrame([(CORE, bad)], "root bigint, bad_version string")
    edges = split_hot(depends.select("src", "dst").distinct(), "dst", "src", scratch)
    closure = C.reach(edges, incidents.select("root"), 6, scratch)
    gate = P.hop1_gate(depends, incidents)
    clean = P.clean_lockfiles(P.lockfile_pins(resolved, versions, incidents, IDS))
    refined = P.refine(edges, closure, incidents, gate, clean, 6, scratch).where("kept")
    after, before = (P.blast_radius(c, incidents, services, fleet, IDS).first() for c in (refined, closure))
    return {r.node for r in refined.collect()}, {r.node for r in gate.where("gated").collect()}, after, before


def test_only_ranges_that_admit_the_bad_release_count(spark, scratch):
    kept, gated, after, before = refinement(spark, scratch)
    assert gated == {PLUGIN, THEME}
    assert kept == {CLI, KIT, WIDGET, ODD, THEME, SKIN, APP1, NEW_LOCK, APP3}  # theme comes back behind cli
    assert (before.exposed_services, before.exposed_lockfiles, before.percentage) == (4, 2, 80.0)
    assert (after.exposed_services, after.exposed_lockfiles, after.percentage, after.tier1_exposed) == (2, 1, 40.0, 1)


@pytest.mark.parametrize("bad", [None, "two point three"])
def test_without_an_orderable_release_everything_stays(spark, scratch, bad):
    kept, gated, after, before = refinement(spark, scratch, bad)
    assert not gated and after.exposed_services == before.exposed_services == 4 and {PLUGIN, APP2, OLD_LOCK} <= kept


@pytest.mark.parametrize("also", [">=1.0.0", None])
def test_a_second_edge_that_admits_it_opens_the_gate(spark, scratch, also):
    kept, gated, _, _ = refinement(spark, scratch, asks=[*ASKS, (PLUGIN, also)])
    assert gated == {THEME} and {PLUGIN, APP2} <= kept


def test_a_lock_with_a_bad_pin_stays_and_the_bad_release_needs_no_flag(spark, scratch):
    kept, _, _, _ = refinement(spark, scratch, pins=((OLD_LOCK, OLD), (OLD_LOCK, NEW), (NEW_LOCK, LATER)))
    assert {OLD_LOCK, APP4} <= kept and not {NEW_LOCK, APP3} & kept
    kept, _, _, _ = refinement(spark, scratch, flagged=False)
    assert NEW_LOCK in kept and OLD_LOCK not in kept


def test_numbering_and_ranks_with_one_hot_group(spark, scratch):
    rng = random.Random(1)
    rows = [(0 if i % 3 else i % 11, rng.randrange(1000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v int, i int").repartition(7)
    got = number_rows(df, [F.asc("v"), F.asc("i")], scratch).collect()
    want = {i: n for n, (v, i) in enumerate(sorted((v, i) for _, v, i in rows))}
    assert {r.i: r.position for r in got} == want
    ranked = rank_within(df, ["g"], [F.desc("v"), F.asc("i")], scratch).collect()
    groups = {}
    for g, v, i in rows:
        groups.setdefault(g, []).append((-v, i))
    want = {i: n + 1 for members in groups.values() for n, (_, i) in enumerate(sorted(members))}
    assert {r.i: r["rank"] for r in ranked} == want


def test_labels_and_edge_ids(spark):
    import hashlib

    edge = [10**12 - 1, 10**12, 3 * 10**12 - 1, 6 * 10**12 - 1, 6 * 10**12]
    df = spark.createDataFrame([(i,) for i in edge], "id bigint")
    labels = [r.l for r in df.orderBy("id").select(IDS.label_of(F.col("id")).alias("l")).collect()]
    assert labels == [None, "Package", "Version", "Lockfile", None]
    want = int.from_bytes(hashlib.sha1(b"DEPENDS_ON|1|2").digest()[:8], "big") >> 2
    one = spark.createDataFrame([(1, 2)], "s bigint, d bigint")
    assert one.select(X.edge_id("DEPENDS_ON", F.col("s"), F.col("d"))).first()[0] == want


def test_changed_source_tables_are_noticed(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(3).write.parquet(f"{folder}/part.parquet")
    first = binding._state_of(spark, folder)
    assert first == binding._state_of(spark, folder) and [name for name, *_ in first] == ["part"]
    spark.range(30).write.mode("overwrite").parquet(f"{folder}/part.parquet")
    assert binding._state_of(spark, folder) != first


def test_pins_that_carry_their_release_need_no_versions(spark):
    lock, package = IDS.base(X.LOCKFILE) + 1, IDS.base(X.PACKAGE) + 1
    pins = spark.createDataFrame(
        [(lock, 7, package, "1.0.0", False), (lock, 8, package, "2.0.0", True), (package, 7, package, "1.0.0", False), (lock, 9, package, "3.0.0", None)],
        "src bigint, dst bigint, package_id bigint, semver string, compromised_window boolean",
    )
    incidents = spark.createDataFrame([(package, "1.0.0")], "root bigint, bad_version string")
    got = {tuple(r) for r in P.lockfile_pins(pins, None, incidents, IDS).collect()}
    assert got == {(package, lock, 7, "1.0.0", True), (package, lock, 8, "2.0.0", True), (package, lock, 9, "3.0.0", False)}


def test_grouped_rows_are_numbered_after_one_shuffle(spark, scratch):
    rows = [(None if i % 11 == 0 else i % 7, f"{i % 5}.0", i) for i in range(500)]
    made = spark.createDataFrame(rows, "p int, s string, at int")
    numbered = number_rows(made, [F.col("p"), F.col("s")], scratch, grouped=lambda d: d.groupBy("p", "s").agg(F.min("at").alias("at")))
    least = {}
    for p, s, at in rows:
        least[p, s] = min(at, least.get((p, s), at))
    order = sorted(least, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert {(r.p, r.s, r.at, r.position) for r in numbered.collect()} == {(*k, least[k], n) for n, k in enumerate(order)}
    dealt = made.repartitionByRange("p", "s").groupBy("p", "s").agg(F.min("at"))
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
