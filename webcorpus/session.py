"""Session settings and the shared folder that lineage cuts and hand-over tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE coalesces small shuffle partitions, splits skewed join partitions and swaps in broadcast
# joins from run-time sizes. The library relies on all three, so they are set explicitly.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A row handed to Python is the tag list of a whole page.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}

# For streams with much state, such as the visited set: state on local disk, changes in the checkpoint folder.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators assume to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can read and write, as named by the cluster.

    ``spark.checkpoint.dir`` wins. A temporary folder is only ever used in local mode, where driver
    and executors are one process; on a cluster an unset folder is an error, since files written to
    one machine are lost with it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if context.getCheckpointDir() is not None:
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="webcorpus-"))
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A not yet existing path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate tables in whatever store it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables of one job in a folder of its own under the shared folder.

    As a context it removes them at the end, so no lazy result may depend on them by then; tables that a returned
    DataFrame reads are written with ``written`` or into a folder the caller names.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, new_folder(spark, name), 0

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once as parquet and read it back; a lost executor costs one re-read instead of its source."""
        self.tables += 1
        path = f"{self.path}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        delete_folder(self.spark, self.path)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where a frame that is dear to compute (a scan of all html) feeds several consumers: they
    read the small result with pruning, and a lost executor costs one re-read instead of the scan. It also
    cuts lineage in loops, computing the rows once.
    ``rebalance`` evens out file sizes and splits a hot ``partition_by`` value over many files.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if partition_by is None:
        df.write.parquet(path)
    else:
        df.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
