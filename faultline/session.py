"""Session settings and the shared scratch area used to cut lineage.

Iterative operators write each step as a parquet table in the folder the
cluster names in ``spark.checkpoint.dir``; a lost executor then costs one task
and never the whole iteration, and the next step plans with real file sizes.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Hashable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOCAL_DIRS: dict[str, str] = {}
JOBS_AT_ONCE = 4
#: A row in memory is many times its share of a Parquet file of numbers and repeated words; Spark
#: plans with this, so that no table is sent through the driver because its file is small.
ROWS_PER_FILE_SIZE = "8"
#: A report has a hundred joins and more, and each may send a table of this size through the driver.
MOST_BROADCAST = 1 << 20


def weigh_files(spark: SparkSession) -> None:
    """Let Spark's choice of broadcasts see tables at about their size in memory, and keep them small."""
    spark.conf.set("spark.sql.sources.fileCompressionFactor", ROWS_PER_FILE_SIZE)
    planned, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    # the second follows the first unless it is set
    for name, given in ((planned, spark.conf.get(planned)), (adaptive, spark.conf.get(adaptive, None))):
        if given is not None and _bytes(spark, given) > MOST_BROADCAST:
            spark.conf.set(name, str(MOST_BROADCAST))


def _bytes(spark: SparkSession, text: str) -> int:
    """A size as Spark's settings write it; -1 stands for never."""
    return -1 if text.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
        # one machine, where driver and executor are one process; a session of its own may lack the setting
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="faultline-")
        return _LOCAL_DIRS[app]
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows that plans know to be empty, so that a join with it moves nothing."""
    columns = StructType.fromDDL(schema).fields
    return spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(c.dataType).alias(c.name) for c in columns])


class Scratch:
    """A uniquely named folder of written tables below the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = (
            f"{shared_dir(spark)}/faultline/{spark.sparkContext.applicationId}"
            f"/{label}-{uuid.uuid4().hex[:12]}"
        )
        self._steps = itertools.count(1)
        self._written: dict[int, tuple[DataFrame, str]] = {}

    def path(self, name: str) -> str:
        return f"{self.base}/{next(self._steps):03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._written[id(kept)] = (kept, path)
        return kept

    def keep_counted(self, df: DataFrame, name: str, condition: Column | None = None) -> tuple[DataFrame, int]:
        """As :meth:`keep`, with the number of rows, or of those that meet ``condition``, observed while writing."""
        seen = Observation()
        counted = F.count(F.lit(1)) if condition is None else F.count_if(condition)
        kept = self.keep(df.observe(seen, counted.alias("n")), name)
        return kept, int(seen.get["n"])

    def read_all(self, parts: list[DataFrame]) -> DataFrame:
        """One scan over several tables of equal schema that :meth:`keep` returned."""
        paths = [self._written[id(part)][1] for part in parts]
        return self.spark.read.schema(parts[0].schema).parquet(*paths)


def together(calls: dict[Hashable, Callable[[], object]]) -> dict:
    """Run independent steps as concurrent Spark jobs, so small ones do not queue up."""
    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        running = {name: pool.submit(call) for name, call in calls.items()}
        return {name: future.result() for name, future in running.items()}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "faultline"):
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="faultline-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
