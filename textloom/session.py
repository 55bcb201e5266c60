"""Session helpers: local sessions for tests and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session as tests and the bench use it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineages: spark.checkpoint.dir, or the one set on the context.

    Only a local master gets a temporary folder of its own; on a cluster a folder that all executors share has to be named.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_on_context = spark.sparkContext.getCheckpointDir()
    if set_on_context:
        return set_on_context
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return spark.sparkContext.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Stash:
    """Tables written to the shared folder to cut the lineage of iterative plans.

    Parquet keeps them compact and gives the optimizer their true size, so that joins with what has become small are broadcast
    by Spark's own size check. ``keep`` returns the table read back; ``drop`` deletes one that no later plan needs.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._clean)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._stash_path = path
        return out

    def keep_counted(self, df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
        """The table read back, and how many of its rows meet the condition, which is counted as they are written."""
        seen = Observation()
        kept = self.keep(df.observe(seen, F.count_if(condition).alias("n")))
        return kept, seen.get["n"] or 0

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = getattr(df, "_stash_path", None)
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        delete(self.spark, path)

    def _clean(self) -> None:
        """At the end of the driver's Python; results are lazy and read these tables until then."""
        try:
            self._delete(self.root)
        except Exception:  # the session is gone already
            pass


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes below which Spark doesn't split what it scans.
SPLIT = 4 << 20


def tasks(spark: SparkSession) -> int:
    """How many tasks stages are worth that take much longer for their rows than the size of these tells."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """The same rows over as many tasks as there are cores, where the table is too small for Spark to split it that far.

    Larger tables, whose scan has enough tasks of its own, are left as they are and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SPLIT * cores else df
