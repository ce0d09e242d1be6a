"""Sample tables of many appends, with a global index of their rows.

An append writes its files, takes the next number by creating a file that must not exist, and adds a small index of its own:
how many rows each of its files holds, and how many lie before. No append reads another one's rows or waits for it, and one that
is not finished has no index and is not seen. A row is found by its file and its place there, so no id is stored.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.operators.scan import REPLICATED_ROWS

INDEX = "token string, number bigint, part string, n bigint, before bigint"
# Rows that the numbers of one append leave room for, as a power of two.
APPEND_BITS = 40


def _root(path: str, name: str, split: str) -> str:
    return f"{path}/dataset={name}/split={split}"


def index_of(spark: SparkSession, path: str, name: str, split: str) -> DataFrame:
    """One row per file of the finished appends: token, number of the append, part (file name), n, rows before in the append."""
    try:
        return spark.read.schema(INDEX).option("recursiveFileLookup", "true").parquet(f"{_root(path, name, split)}/index")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX)


def _number(spark: SparkSession, root: str) -> int:
    """The smallest number that no append has taken."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{root}/numbers")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    number = max((int(f.getPath().getName()) for f in files.listStatus(folder)), default=-1) + 1
    while not files.createNewFile(hadoop.Path(f"{root}/numbers/{number}")):
        number += 1
    return number


def append_samples(df: DataFrame, path: str, name: str, split: str, token: str = None) -> bool:
    """Add ``df`` to a sample table. With a ``token`` of its own an append may be repeated: it counts once."""
    spark, root = df.sparkSession, _root(path, name, split)
    token = token or uuid.uuid4().hex
    if not index_of(spark, path, name, split).filter(F.col("token") == token).isEmpty():
        return False
    data = f"{root}/data/{token}"
    df.write.mode("overwrite").parquet(data)
    number = _number(spark, root)
    # Rows are counted from what the files say about themselves; one row per file goes on.
    counts = spark.read.parquet(data).groupBy(F.col("_metadata.file_name").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    (counts.select(F.lit(token).alias("token"), F.lit(number).cast("bigint").alias("number"), "part", "n", F.coalesce(before, F.lit(0)).alias("before"))
     .coalesce(1).write.mode("overwrite").parquet(f"{root}/index/{number}"))
    return True


def read_indexed(spark: SparkSession, path: str, name: str, split: str) -> DataFrame:
    """The rows of all finished appends with ``sample_id``, which never changes, and ``pos``, their place from 0 in the whole
    table as it is now (appends by number, files by name, rows as they lie)."""
    index = index_of(spark, path, name, split)
    whole = F.sum("n").over(Window.orderBy("number", "part").rowsBetween(Window.unboundedPreceding, -1))
    places = index.select("token", "part", (F.col("number") * (1 << APPEND_BITS) + F.col("before")).alias("_id"),
                          F.coalesce(whole, F.lit(0)).alias("_pos")).withColumnsRenamed({"token": "_token", "part": "_part"})
    few = index.limit(REPLICATED_ROWS + 1).count() <= REPLICATED_ROWS
    data = spark.read.option("recursiveFileLookup", "true").parquet(f"{_root(path, name, split)}/data")
    columns = data.columns
    rows = data.select("*", F.regexp_extract("_metadata.file_path", r"/data/([^/]+)/[^/]+$", 1).alias("_token"),
                       F.col("_metadata.file_name").alias("_part"), F.col("_metadata.row_index").alias("_at"))
    return rows.join(F.broadcast(places) if few else places, ["_token", "_part"]).select(
        *columns, (F.col("_id") + F.col("_at")).alias("sample_id"), (F.col("_pos") + F.col("_at")).alias("pos"))
