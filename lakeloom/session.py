"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "lakeloom") -> SparkSession:
    """A session for one machine: UTC, adaptive planning, few shuffle partitions."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(frame: DataFrame) -> DataFrame:
    """A frame dealt to all cores if it is so small that its scan has fewer partitions than there are.

    For work that is heavy for its bytes. What is dealt is bounded: less than one full partition of a
    scan for each core; larger tables stay where they are, and those of as many files as there are cores.
    """
    spark = frame.sparkSession
    cores = spark.sparkContext.defaultParallelism
    full = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    return frame.repartition(cores) if read < full * cores and len(frame.inputFiles()) < cores else frame


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests on one machine) a temporary folder is made and remembered.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lakeloom-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/lakeloom/{name}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}

    def save(self, name: str, frame: DataFrame) -> DataFrame:
        """Write a table once and return a reader of it; the former one of that name goes."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        frame.write.parquet(path)
        former = self._paths.get(name)
        self._paths[name] = path
        if former:
            self._delete(former)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        if path := self._paths.pop(name, None):
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
