"""Helpers shared by the operators of this folder."""

from contextlib import contextmanager

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.session import new_dir

# Rows and bytes of whole texts that Python handles at a time.
TEXT_ROWS = 512
TEXT_BYTES = 4 << 20
# Rows of a few fixed-size columns that may be sent to every executor: some 50 MB there.
BROADCAST_ROWS = 500_000


def settle(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once below the shared folder and read again: its lineage ends there, and lost executors cost
    nothing that was written."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def short_batches(spark: SparkSession, rows: int = TEXT_ROWS):
    """Jobs that run meanwhile hand Arrow batches of at most ``rows`` rows to Python: whole texts by the 10,000 take much of an
    executor's memory outside the heap, and that of its workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(before, rows) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text as a string, null as the empty one."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` (short ones, of a written table) marked for replication if they are counted to be ``most`` or fewer; else
    as they are, for a join by exchange."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def ranked(rows: DataFrame, key: list[str], order: list[str], label: str) -> DataFrame:
    """``rows`` with ``rank``, their place from 0 among those of an equal ``key`` in the order of ``order``, and ``n``,
    their number.

    The rows are sorted by range, so a key of any size lies in many tasks; places within a task come from the order it
    wrote, and a table with one row per task and key says how many rows of a key lie before.
    """
    sorted_rows = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    placed = settle(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = settle(placed.groupBy(*key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), "parts")
    all_of = Window.partitionBy(*key)
    earlier = all_of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("_part").alias("_in"), "_first",
                         F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(all_of).alias("n"))
    same = placed["_part"] == F.col("_in")
    for k in key:
        same = same & placed[k].eqNullSafe(F.col(f"_{k}"))
    return placed.join(small(settle(parts, "parts")), same).select(
        *rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("rank"), "n")


def slices(batch, column, rows: int = TEXT_ROWS, most: int = TEXT_BYTES):
    """An Arrow batch in zero-copy parts of at most ``rows`` rows and about ``most`` bytes of ``column``, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(start, stop - start)
        start = stop
