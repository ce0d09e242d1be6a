"""Session settings and the shared folder for tables that outlive one job."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators are written for. All can be changed on a live session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Keep splitting skewed join partitions even when that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Folders are listed by this many tasks, not by one each: a task takes longer to start than to list a folder.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "128",
    # Streaming state outside the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Input bytes per shuffle partition; adaptive execution merges partitions that turn out small.
PARTITION_BYTES = 256 << 20


def tune(spark: SparkSession, input_bytes: int = None) -> SparkSession:
    """Apply ``SETTINGS`` to a session and return it.

    With the size of the input the number of shuffle partitions grows to match; it never shrinks.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if input_bytes:
        wanted = -(-input_bytes // PARTITION_BYTES)
        if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A session whose executors are threads of the driver gets a temporary folder without the setting; any other one
    without it is an error, as executors do not share a machine-local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        root = configured
    else:
        root = spark.conf.get("runlens.shared.dir", None)
        if root is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            root = tempfile.mkdtemp(prefix="runlens-")
            spark.conf.set("runlens.shared.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder (not created)."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table below the shared folder: computed once, its lineage cut, readable after executors are lost."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``: computed once, lineage cut, readable after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written, wherever Spark's paths reach."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
