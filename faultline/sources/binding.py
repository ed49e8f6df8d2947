"""Graph tables derived from the warehouse tables (parts, orders, line items …).

Parts are packages, customers are services, urgent orders are lockfiles,
suppliers are maintainers, error events are advisories. Each table is written
once to the shared folder, on first use, with the columns later jobs filter on;
a job never pays for a table that it does not read.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schema as X
from faultline.functions import semver as V
from faultline.operators.closure import reach
from faultline.operators.ordering import number_rows
from faultline.operators.skew import SplitEdges, split_hot
from faultline.operators.typosquat import typosquat_edges
from faultline.operators.versions import keys_of
from faultline.session import Scratch, weigh_files

WINDOW_OPENS, WINDOW_CLOSES = "1998-06-01 00:00:00", "1998-07-01 00:00:00"


@dataclass
class Graph:
    """The graph tables of one data set, written on first use, with lazily kept derivations."""

    spark: SparkSession
    sf_dir: str
    scratch: Scratch
    ids: X.IdSpace
    _kept: dict[str, object] = field(default_factory=dict)
    _locks: dict[str, threading.RLock] = field(default_factory=dict)

    def once(self, name: str, build: Callable[[], object]):
        """Derive a table (or split edge set) once per graph, also when several threads ask for it."""
        # no derivation needs itself, so threads that wait for each other's tables never wait in a circle
        with self._locks.setdefault(name, threading.RLock()):
            if name not in self._kept:
                self._kept[name] = build()
            return self._kept[name]

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return self.once(name, lambda: self.scratch.keep(build(), name))

    def source(self, table: str) -> str:
        """Path of a warehouse table."""
        return f"{self.sf_dir}/{table}.parquet"

    def table(self, name: str) -> DataFrame:
        """A warehouse table."""
        return self.spark.read.parquet(self.source(name))

    @property
    def package(self) -> DataFrame:
        return self.kept("package", lambda: _package(self))

    @property
    def version(self) -> DataFrame:
        return self.kept("version", lambda: _version(self))

    @property
    def maintainer(self) -> DataFrame:
        return self.kept("maintainer", lambda: _maintainer(self))

    @property
    def service(self) -> DataFrame:
        return self.kept("service", lambda: _service(self))

    @property
    def lockfile(self) -> DataFrame:
        return self.kept("lockfile", lambda: _lockfile(self))

    @property
    def depends_on(self) -> DataFrame:
        return self.kept("depends_on", lambda: _depends_on(self))

    @property
    def located(self) -> DataFrame:
        return self.kept("located", lambda: _located(self))

    @property
    def resolved_in(self) -> DataFrame:
        return self.kept("resolved_in", lambda: _resolved_in(self))

    @property
    def root_version(self) -> DataFrame:
        """The releases of packages with a windowed line, numbered among themselves in the order of ``version``."""
        return self.kept("root_version", lambda: _root_version(self))

    @property
    def root_located(self) -> DataFrame:
        """As ``located``, of the releases in ``root_version`` and by their numbers."""
        return self.kept("root_located", lambda: _located_among(self, self.root_version).select(
            "src", "dst", "package_id", "semver", "compromised_window"))

    @property
    def package_ids(self) -> DataFrame:
        """The ``id`` of every row of ``package``, without its releases."""
        return self.kept("package_ids", lambda: _named_parts(self).select("id"))

    @property
    def maintained_by(self) -> DataFrame:
        return self.kept("maintained_by", lambda: _maintained_by(self))

    @property
    def typosquat_of(self) -> DataFrame:
        return self.kept("typosquat_of", lambda: typosquat_edges(self.package.select("id", "name", "downloads_weekly")))

    @property
    def advisory(self) -> DataFrame:
        return self.kept("advisory", lambda: _advisory(self))

    @property
    def dependents(self) -> SplitEdges:
        """Dependency edges keyed by the package depended on."""
        return self.once(
            "dependents",
            # written, so that no hop removes the double edges anew
            lambda: split_hot(self.scratch.keep(self.depends_on.select("src", "dst").distinct(), "edges"), "dst", "src", self.scratch),
        )

    @property
    def roots(self) -> DataFrame:
        """Packages with at least one release inside the compromise window."""
        return self.kept("roots", lambda: self.root_version.where("compromised_window").select(
            F.col("package_id").alias("root")).distinct())

    def closure(self, depth: int = X.DEFAULT_DEPTH) -> DataFrame:
        """Closure of all roots; kept once at the largest bound, filtered below it."""
        if not 1 <= depth <= X.MAX_DEPTH:
            raise ValueError(f"depth {depth} is not between 1 and {X.MAX_DEPTH}")
        full = self.once("closure", lambda: reach(self.dependents, self.roots, X.MAX_DEPTH, self.scratch))
        return full.where(F.col("depth") <= depth)

    def nodes(self) -> DataFrame:
        parts = [
            df.select("id", "name") for df in
            (self.package, self.version, self.maintainer, self.service, self.lockfile)
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def public_edges(self) -> DataFrame:
        """All edges of the four public types with their property as text."""
        def typed(df: DataFrame, kind: str, prop: Column) -> DataFrame:
            return df.select(F.lit(kind).alias("type"), "src", "dst", prop.cast("string").alias("property"))

        return (
            typed(self.depends_on, X.DEPENDS_ON, F.col("constraint_"))
            .unionByName(typed(self.maintained_by, X.MAINTAINED_BY, F.date_format("since", "yyyy-MM-dd")))
            .unionByName(typed(self.resolved_in, X.RESOLVED_IN, F.col("resolved_version")))
            .unionByName(typed(self.typosquat_of, X.TYPOSQUAT_OF, F.col("edit_distance")))
        )


def _dash(*columns: Column) -> Column:
    return F.concat_ws("-", *columns)


def _release_text() -> Column:
    """Release number carried by a line item."""
    return F.concat_ws(
        ".",
        (1 + F.col("l_quantity").cast("bigint") % 5).cast("string"),
        F.col("l_linenumber").cast("string"),
        F.round(F.col("l_discount") * 100).cast("bigint").cast("string"),
    )


def _base(g: Graph, label: str) -> Column:
    return F.lit(g.ids.base(label))


def _named_parts(g: Graph) -> DataFrame:
    """(id, name, ecosystem, downloads_weekly) of every package."""
    return g.table("part").select(
        (_base(g, X.PACKAGE) + F.col("p_partkey")).alias("id"),
        _dash(F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_partkey").cast("string")).alias("name"),
        F.lit(X.DEFAULT_ECOSYSTEM).alias("ecosystem"),
        ((F.col("p_partkey") * 7919) % 10007 * 102).cast("bigint").alias("downloads_weekly"),
    )


def _in_window(instant: str) -> Column:
    return (F.col(instant) >= F.lit(WINDOW_OPENS).cast("timestamp_ntz")) & (F.col(instant) < F.lit(WINDOW_CLOSES).cast("timestamp_ntz"))


def _numbered_releases(g: Graph, lines: DataFrame) -> DataFrame:
    """(l_partkey, semver, published_at, position) of every release among line items."""
    # dealt by package and number, so that grouping needs no second shuffle and the rows can be numbered as they lie
    return number_rows(
        lines.select("l_partkey", _release_text().alias("semver"), "l_shipdate"), [F.col("l_partkey"), F.col("semver")], g.scratch,
        grouped=lambda dealt: dealt.groupBy("l_partkey", "semver").agg(F.min("l_shipdate").alias("published_at")),
    )


def _release_keys(g: Graph, releases: DataFrame) -> DataFrame:
    # many packages have releases of one number; each number is parsed once
    numbers = g.scratch.keep(releases.select("semver").distinct(), "release-numbers")
    return g.scratch.keep(
        keys_of(numbers, "semver", V.strict_key).withColumnRenamed("key", "strict").join(
            keys_of(numbers, "semver", V.lenient_key).withColumnRenamed("key", "lenient"), "semver"
        ),
        "release-keys",
    )


def _version(g: Graph) -> DataFrame:
    releases = _numbered_releases(g, g.table("lineitem"))
    parsed = _release_keys(g, releases)
    return (
        # names come to the rows while those are short
        releases.withColumn("package_id", _base(g, X.PACKAGE) + F.col("l_partkey"))
        .join(_named_parts(g).select(F.col("id").alias("package_id"), F.col("name").alias("package_name")), "package_id", "left")
        .join(parsed, "semver", "left")
        .select(
            (_base(g, X.VERSION) + F.col("position")).alias("id"),
            "package_id",
            "semver",
            "published_at",
            _in_window("published_at").alias("compromised_window"),
            "strict",
            "lenient",
            "package_name",
        )
        .withColumn("readable", F.col("lenient").isNotNull())
        .withColumn("lenient", F.coalesce("lenient", V.lenient_key(F.lit("0.0.0"))))
        .withColumn("name", F.concat_ws("@", "package_name", "semver"))
    )


def _root_version(g: Graph) -> DataFrame:
    # a release is windowed by the date of one of its lines, so no root lacks a line inside the window
    lines = g.table("lineitem").select("l_partkey", "l_quantity", "l_linenumber", "l_discount", "l_shipdate")
    named = lines.where(_in_window("l_shipdate")).select(F.col("l_partkey").alias("_named")).distinct()
    releases = _numbered_releases(g, lines.join(named.hint("shuffle_hash"), F.col("l_partkey").eqNullSafe(F.col("_named")), "left_semi"))
    # a package listed more than once has its releases as often, as in version
    often = g.scratch.keep(
        g.package_ids.groupBy(F.col("id").alias("package_id")).agg(F.count(F.lit(1)).cast("int").alias("_times")).where("_times > 1"), "listed-often"
    )
    return (
        releases.withColumn("package_id", _base(g, X.PACKAGE) + F.col("l_partkey"))
        .join(_release_keys(g, releases).select("semver", "lenient"), "semver", "left")
        .join(often, "package_id", "left")
        .withColumn("_time", F.explode(F.sequence(F.lit(1), F.coalesce("_times", F.lit(1)))))
        .select(
            (_base(g, X.VERSION) + F.col("position")).alias("id"),
            "package_id",
            "semver",
            "published_at",
            _in_window("published_at").alias("compromised_window"),
            F.coalesce("lenient", V.lenient_key(F.lit("0.0.0"))).alias("lenient"),
            F.col("lenient").isNotNull().alias("readable"),
        )
    )


def _advisory(g: Graph) -> DataFrame:
    return g.table("events").where("event_type = 'error'").select(
        F.concat(
            F.when(F.col("event_id") % 10 == 0, "MAL-").otherwise("GHSA-"), F.col("event_id").cast("string")
        ).alias("id"),
        (_base(g, X.PACKAGE) + F.col("user_id")).alias("package_id"),
        (F.col("event_id") % 10 == 0).alias("malicious"),
        F.col("ts").alias("published"),
        F.concat((1 + F.floor("value") % 5).cast("string"), F.lit(".0.0")).alias("introduced"),
        F.when(
            F.col("event_id") % 3 != 0, F.concat((2 + F.floor("value") % 5).cast("string"), F.lit(".0.0"))
        ).alias("fixed"),
        F.when(
            F.col("event_id") % 10 == 0,
            F.concat((1 + F.floor("value") % 5).cast("string"), F.lit(".1."), (F.col("event_id") % 11).cast("string")),
        ).alias("exact_version"),
    )


def _package(g: Graph) -> DataFrame:
    newest = g.version.groupBy(F.col("package_id").alias("id")).agg(
        F.max_by("semver", "strict").alias("latest_version"), F.max("published_at").alias("last_published_at")
    )
    flagged = g.advisory.where("malicious").select(F.col("package_id").alias("id")).distinct().withColumn(
        "is_compromised", F.lit(True)
    )
    return (
        _named_parts(g).join(newest, "id", "left")
        .join(flagged, "id", "left")
        .withColumn("is_compromised", F.coalesce("is_compromised", F.lit(False)))
    )


def _service(g: Graph) -> DataFrame:
    return g.table("customer").select(
        (_base(g, X.SERVICE) + F.col("c_custkey")).alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "tier-1")
        .when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), "tier-2")
        .otherwise("tier-3")
        .alias("criticality"),
    )


def _lockfile(g: Graph) -> DataFrame:
    return g.table("orders").where("o_orderpriority = '1-URGENT'").select(
        (_base(g, X.LOCKFILE) + F.col("o_orderkey")).alias("id"),
        (_base(g, X.SERVICE) + F.col("o_custkey")).alias("service_id"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit("/package-lock.json")).alias("name"),
        F.col("o_orderdate").alias("generated_at"),
    )


def _maintainer(g: Graph) -> DataFrame:
    return g.table("supplier").select((_base(g, X.MAINTAINER) + F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"))


def _maintained_by(g: Graph) -> DataFrame:
    return (
        g.table("lineitem").where("l_linenumber = 2")
        .groupBy((_base(g, X.PACKAGE) + F.col("l_partkey")).alias("src"), (_base(g, X.MAINTAINER) + F.col("l_suppkey")).alias("dst"))
        .agg(F.min("l_shipdate").alias("since"))
    )


def _locked_items(g: Graph) -> DataFrame:
    """(id, service_id, package_id, l_linenumber, semver): the line items of every lockfile."""
    locked = g.lockfile.select("id", "service_id", (F.col("id") - _base(g, X.LOCKFILE)).alias("l_orderkey"))
    lines = g.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount")
    # numbers become text after the join, for locked lines alone
    return locked.join(lines, "l_orderkey").select(
        "id", "service_id", (_base(g, X.PACKAGE) + F.col("l_partkey")).alias("package_id"), "l_linenumber", _release_text().alias("semver")
    )


def _depends_on(g: Graph) -> DataFrame:
    items, pkg, src = g.table("lineitem"), _base(g, X.PACKAGE), F.col("src")
    first_part = items.groupBy("l_orderkey").agg(F.min("l_partkey").alias("first_part"))
    between = (
        items.where("l_linenumber = 7 AND l_returnflag = 'R'")
        .join(first_part, "l_orderkey")
        .where("l_partkey <> first_part")
        .select((pkg + F.col("l_partkey")).alias("src"), (pkg + F.col("first_part")).alias("dst"))
        .distinct()
    )
    first_line = g.kept("first_lines", lambda: _locked_items(g).where("l_linenumber = 1"))
    return (
        between.withColumn(
            "constraint_",
            F.concat(
                F.when(src % 4 == 0, "^").when(src % 4 == 1, "~").when(src % 4 == 2, ">=").otherwise(""),
                F.concat_ws(".", (1 + src % 5).cast("string"), (1 + src % 7).cast("string"), F.lit("0")),
            ),
        )
        .unionByName(
            first_line.select(F.col("service_id").alias("src"), F.col("package_id").alias("dst"))
            .distinct()
            .withColumn("constraint_", F.concat(F.lit("^"), (1 + src % 5).cast("string"), F.lit(".0.0")))
        )
        .unionByName(
            g.lockfile.select(F.col("service_id").alias("src"), F.col("id").alias("dst"), F.lit("lockfile").alias("constraint_"))
        )
        .unionByName(
            first_line.groupBy(F.col("id").alias("src"), F.col("package_id").alias("dst")).agg(
                F.concat(F.lit("="), F.min("semver")).alias("constraint_")
            )
        )
    )


def _located_among(g: Graph, releases: DataFrame) -> DataFrame:
    """Each of the releases that a lockfile pins, once, with the lockfile as ``src`` and the release as ``dst``."""
    keys = ["package_id", "semver"]
    # dealt by release for the grouping and the join alike
    items = _locked_items(g).select(F.col("id").alias("src"), *keys).repartition(*keys).distinct()
    return items.join(releases.withColumnRenamed("id", "dst"), keys)


def _located(g: Graph) -> DataFrame:
    """(src, dst, package_id, package_name, semver, compromised_window): each release that a lockfile pins, once."""
    return _located_among(g, g.version).select("src", "dst", "package_id", "package_name", "semver", "compromised_window")


def _resolved_in(g: Graph) -> DataFrame:
    pins = g.located.select("src", "dst", F.col("semver").alias("resolved_version")).distinct()
    return pins.unionByName(
        g.version.select(F.col("package_id").alias("src"), F.col("id").alias("dst"), F.col("semver").alias("resolved_version"))
    )


def bind(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of one directory of warehouse tables."""
    weigh_files(spark)
    return Graph(spark, sf_dir, Scratch(spark, "graph"), X.IdSpace())


SOURCES = ("part", "customer", "orders", "lineitem", "supplier", "events", "pages")
_OPEN: dict[tuple[str, str], tuple[tuple, Graph]] = {}


def _state_of(spark: SparkSession, sf_dir: str) -> tuple:
    """Length and time of every source table, by Spark's own file system."""
    out = []
    for name in SOURCES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path):
            out.append((name, files.getContentSummary(path).getLength(), files.getFileStatus(path).getModificationTime()))
    return tuple(out)


def graph_for(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a data set, opened on first use in a session and anew when a source table has changed."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    state = _state_of(spark, key[1])
    if key not in _OPEN or _OPEN[key][0] != state:
        _OPEN[key] = (state, bind(spark, key[1]))
    return _OPEN[key][1]
