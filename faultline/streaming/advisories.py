"""Advisory sweep as a stream.

What was seen before is known to the stream itself: it drops repeated advisory rows by a state
store, so a batch brings only new ones. Every batch writes its advisories, the versions it raised
and one delta row as runs under its own number; a replayed batch overwrites its own runs and
nothing else. After ``compact_every`` batches all runs are merged into one, sorted by package, and a
pointer names it. The pointer is one file, written last. So a batch reads one merged run and a
bounded number of small ones however many batches went before, and no file is ever changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.operators.advisories import affected_versions, apply_advisories
from faultline.session import Scratch
from faultline.sources import osv

DROP = "package_id bigint, id string, malicious boolean, affected_versions array<string>, ranges array<struct<introduced:string,fixed:string>>"
RAISED = "id bigint, package_id bigint"
DELTA = "packages bigint, advisories bigint, malicious bigint, newly_flagged bigint, newly_windowed bigint"
STATE = {"advisories": DROP, "raised": RAISED, "delta": DELTA}
INTERVAL = "900 seconds"
COMPACT_EVERY = 16
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Sweep:
    """Base tables and the folder holding one sweep's state.

    ``packages`` has (id, name, ecosystem, is_compromised, risk_score), ``versions``
    (id, package_id, semver, compromised_window).
    """

    spark: SparkSession
    folder: str
    packages: DataFrame
    versions: DataFrame

    compact_every: int = COMPACT_EVERY

    def prepare(self) -> "Sweep":
        for name, schema in STATE.items():
            self.spark.createDataFrame([], f"{schema}, batch bigint").write.mode("ignore").parquet(f"{self.folder}/{name}/merged=-1")
        self._mark("merged/upto=-1", "ignore")
        self._mark("done/batch=-1", "ignore")
        return self

    def merged_upto(self) -> int:
        """The last batch that the merged run holds, by the pointer."""
        return self._highest("merged", "upto")

    def last_batch(self) -> int:
        return self._highest("done", "batch")

    def _mark(self, name: str, mode: str = "overwrite") -> None:
        self.spark.createDataFrame([(1,)], "x bigint").coalesce(1).write.mode(mode).parquet(f"{self.folder}/{name}")

    def _highest(self, name: str, key: str) -> int:
        """The highest of the numbers in folder names; a folder appears when its file is complete."""
        found = self.spark.read.schema(f"x bigint, {key} bigint").parquet(f"{self.folder}/{name}").agg(F.max(key)).first()[0]
        return -1 if found is None else found

    def _state(self, name: str, before: int | None = None) -> DataFrame:
        """All rows of a table, or those of earlier batches: the merged run and the runs after it."""
        upto = self.merged_upto()
        last = self.last_batch() if before is None else before - 1
        schema = f"{STATE[name]}, batch bigint"
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/merged={upto}")
        runs = [f"{self.folder}/{name}/run={n}" for n in range(upto + 1, last + 1)]
        return rows.unionByName(self.spark.read.schema(schema).parquet(*runs)) if runs else rows

    def _run(self, name: str, rows: DataFrame, batch: int) -> DataFrame:
        path = f"{self.folder}/{name}/run={batch}"
        rows.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(STATE[name]).parquet(path)

    def matched(self, records: DataFrame) -> DataFrame:
        """Advisory rows for tracked packages, each once; records may be a stream."""
        tracked = self.packages.select(F.col("id").alias("package_id"), F.col("name").alias("package"), "ecosystem")
        found = osv.advisories_of(records).join(tracked, ["ecosystem", "package"]).select("package_id", "id", "malicious", "affected_versions", "ranges")
        # an advisory that comes again with other contents is new
        return found.withColumn("_contents", F.xxhash64("malicious", "affected_versions", "ranges")).dropDuplicates(["package_id", "id", "_contents"]).drop("_contents")

    def on_batch(self, rows: DataFrame, batch: int) -> None:
        """Handle the new rows of one micro-batch; safe to repeat."""
        if batch <= self.merged_upto():
            return  # complete, and merged since
        scratch = Scratch(self.spark, f"sweep-{batch}")
        fresh = self._run("advisories", rows, batch)
        named = scratch.keep(fresh.select("package_id").distinct(), "named")
        # state of the packages that this batch names; their releases are picked once, where they are matched
        earlier = self._state("advisories", batch).join(named, "package_id", "left_semi")
        raised = self._state("raised", batch).join(named, "package_id", "left_semi")
        quiet = self.versions.where("NOT coalesce(compromised_window, false) AND package_id IS NOT NULL")
        window = affected_versions(quiet, fresh, scratch).select("id", "package_id").join(raised.select("id"), "id", "left_anti")
        opened = self._run("raised", window, batch)

        flagged_before = earlier.where("malicious").select("package_id").unionByName(
            self.packages.where("is_compromised").select(F.col("id").alias("package_id"))
        )
        flagged = fresh.where("malicious").select("package_id").distinct().join(flagged_before, "package_id", "left_anti")
        delta = fresh.agg(
            F.count_distinct("package_id").alias("packages"),
            F.count_distinct("package_id", "id").alias("advisories"),
            F.count_distinct(F.when(F.col("malicious"), F.struct("package_id", "id"))).alias("malicious"),
        ).select(
            "packages", "advisories", "malicious",
            flagged.agg(F.count(F.lit(1))).scalar().alias("newly_flagged"),
            opened.agg(F.count(F.lit(1))).scalar().alias("newly_windowed"),
        )
        self._run("delta", delta, batch)
        self._mark(f"done/batch={batch}")
        if batch - self.merged_upto() >= self.compact_every:
            self.compact(batch)

    def compact(self, upto: int) -> None:
        """Merge all runs up to a batch into one, then turn the pointer; runs stay for whoever reads them still."""
        for name in STATE:
            order = "package_id" if name != "delta" else "batch"
            merged = self._state(name, upto + 1).repartitionByRange(order).sortWithinPartitions(order)
            merged.write.mode("overwrite").parquet(f"{self.folder}/{name}/merged={upto}")
        self._mark(f"merged/upto={upto}")

    def deltas(self) -> DataFrame:
        return self._state("delta").where("batch >= 0")

    def raised(self) -> DataFrame:
        return self._state("raised").select("id", "package_id").distinct()

    def current(self) -> DataFrame:
        """Package state after all batches: flags, risk and advisory counts.

        The risk depends only on the set of known advisory ids, so one aggregation
        over all of them equals applying them batch by batch.
        """
        known = self._state("advisories").drop("batch")
        none = self.spark.createDataFrame([], "package_id bigint, advisory_id string")
        return apply_advisories(self.packages, none, self.versions, known, Scratch(self.spark, "sweep-state")).packages

    def _started(self, source: str, files_per_batch: int):
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        records = (
            self.spark.readStream.schema(osv.RECORD).option("maxFilesPerTrigger", files_per_batch).json(source)
        )
        return (
            self.matched(records).writeStream.foreachBatch(self.on_batch)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .queryName("advisory_sweep")
        )

    def run_once(self, source: str, files_per_batch: int = 1000) -> None:
        """Take everything that has arrived, then stop."""
        self._started(source, files_per_batch).trigger(availableNow=True).start().awaitTermination()

    def run_every(self, source: str, interval: str = INTERVAL, files_per_batch: int = 1000) -> StreamingQuery:
        """Keep sweeping at an interval; the caller stops the query."""
        return self._started(source, files_per_batch).trigger(processingTime=interval).start()

    def preview(self, records: DataFrame) -> DataFrame:
        """What a sweep would match, without writing."""
        found = self.matched(records).groupBy(F.col("package_id").alias("id")).agg(
            F.count(F.lit(1)).alias("advisories"), F.count_if("malicious").alias("malicious")
        )
        return (
            self.packages.select("id", F.concat_ws(":", "ecosystem", "name").alias("key"))
            .join(found, "id", "left")
            .fillna(0, ["advisories", "malicious"])
        )
