"""Export of a run's series as JSON documents."""

import bz2
import gzip
import os
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.scalars import format_instant, safe_file_name
from runlens.operators.scan import MAX_ROWS, ordinal
from runlens.session import written

CLOSING = (1 << 63) - 1


def export_lines(rows: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Lines of one JSON array per (run, archive, file), in order of ``pos``.

    ``rows`` as from ``run_export_rows`` or ``pod_export_rows``. Each sample is one line, so a series needs no task of its own.
    """
    if "archive" not in rows.columns:
        rows = rows.withColumn("archive", F.concat(F.lit("metrics_"), safe_file_name(F.col("run_name"))))
    files = rows.withColumn("file", F.concat(F.col("prefix"), F.lit("_"), F.col("name"), F.lit(".json")))
    keys = ["run_id", "archive", "file"]
    placed = ordinal(files, keys, ["date", "metric_id"], "pos", max_rows)
    sample = F.to_json(F.struct(format_instant(F.col("date")).alias("date"),
                                F.col("value").cast("string").alias("value"), "cumulative"))
    lines = placed.select(*keys, "pos", F.concat(F.when(F.col("pos") == 0, "[").otherwise(","), sample).alias("line"))
    closing = files.select(*keys).distinct().select(*keys, F.lit(CLOSING).alias("pos"), F.lit("]").alias("line"))
    return lines.unionByName(closing)


def export_run(rows: DataFrame, out_dir: str, compression: str = "gzip", max_rows: int = MAX_ROWS) -> None:
    """Write ``run_id=<id>/archive=<name>/file=<prefix>_<metric>.json/part-*``.

    The parts of a folder in name order form the document. What takes time is the number of files, so the ranges are as many as
    a shuffle's partitions however few bytes they hold: adaptive execution would merge small ones and write all files in turn.
    On a local path the tasks write their parts themselves, as Spark's writer forks a command there for every file and folder
    it makes (``write_parts``).
    """
    place, spark = ["run_id", "archive", "file"], rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lines = (written(export_lines(rows, max_rows), "lines")
             .repartitionByRange(tasks, *place, "pos").sortWithinPartitions(*place, "pos").select(*place, "line"))
    path = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file" or compression not in OPENERS:
        lines.write.option("compression", compression).partitionBy(*place).text(out_dir)
        return
    if files.exists(path):
        raise FileExistsError(out_dir)
    write_parts(lines, place, files.makeQualified(path).toUri().getPath(), compression)


# How the parts of a local export are opened, and their ending.
OPENERS = {"none": (open, ".txt"), "gzip": (lambda path, *args, **kw: gzip.open(path, *args, compresslevel=6, **kw), ".txt.gz"),
           "bzip2": (bz2.open, ".txt.bz2")}
_ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")


def folder_name(value) -> str:
    """A partition value as Spark writes it into a folder's name."""
    return _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"


def write_parts(lines: DataFrame, place: list, root: str, compression: str) -> None:
    """``lines`` (``place``, line) in their order and partitions as ``<column>=<value>/../part-*`` below the local ``root``.

    A part is renamed once it is whole, under a name that follows from its task, so what a failed or second attempt has
    written is replaced or not seen; ``_SUCCESS`` comes last, as with Spark's writer. A task holds one open file.
    """
    opened, ending = OPENERS[compression]

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name, part, here = f"part-{task.partitionId():05d}{ending}", None, None

        def close():
            part.close()
            os.replace(part_path, f"{here}/{name}")

        parts = 0
        for batch in batches:
            values = [c.to_pylist() for c in batch.columns]
            for keys, group in groupby(zip(*values), key=lambda row: row[:-1]):
                folder = "/".join([root, *(f"{c}={folder_name(v)}" for c, v in zip(place, keys))])
                if folder != here:
                    if part is not None:
                        close()
                    here, part_path, parts = folder, f"{folder}/.{name}.{task.taskAttemptId()}", parts + 1
                    os.makedirs(folder, exist_ok=True)
                    part = opened(part_path, "wt", encoding="utf-8", newline="\n")
                part.writelines(f"{row[-1]}\n" for row in group)
        if part is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([parts], pa.int64())], ["parts"])

    texts = lines.select(*[F.col(c).cast("string").alias(c) for c in place], "line")
    os.makedirs(root)
    texts.mapInArrow(write, "parts long").agg(F.sum("parts")).collect()
    with open(f"{root}/_SUCCESS", "w"):
        pass


def exported_lines(spark: SparkSession, out_dir: str) -> DataFrame:
    """The lines of an export: value, and run_id, archive and file as strings from the path of its part.

    Spark's discovery of partition columns takes time with the square of the number of folders, all of it on the driver.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(out_dir).select("value", F.col("_metadata.file_path").alias("_path"))

    def decoded(name):
        # A plus sign stands for itself.
        return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))

    def named(group):
        name = F.regexp_extract("_path", "/run_id=([^/]*)/archive=([^/]*)/file=([^/]*)/[^/]*$", group)
        # The path is given as a URI, in which the percent signs of escaped names are escaped once more.
        return F.when(name != "__HIVE_DEFAULT_PARTITION__", decoded(decoded(name)))
    return lines.select("value", *[named(i).alias(c) for i, c in enumerate(("run_id", "archive", "file"), 1)])


# Lines of a packed file, and of a row group within it.
FILE_LINES = 2_000_000
GROUP_BYTES = 8 << 20


def export_packed(rows: DataFrame, out_dir: str, file_lines: int = FILE_LINES, max_rows: int = MAX_ROWS) -> None:
    """Write all documents of ``rows`` (as for ``export_run``) to few files, ``lines``, and a table of contents, ``index``.

    The lines are sorted by document and place over all files, about ``file_lines`` in each, so the number of files follows
    the size of the export and not the number of series; a long document spans several files, a file holds many short ones.
    ``index`` has a row per document and file: run_id, archive, file, part (the file's name), first and last line there, and
    their number. Both are found by their sorted columns, whose bounds stand in the files themselves.
    """
    place = ["run_id", "archive", "file"]
    lines = written(export_lines(rows, max_rows), "lines")
    files = max(1, -(-lines.count() // file_lines))
    (lines.repartitionByRange(files, *place, "pos").sortWithinPartitions(*place, "pos")
     .write.option("parquet.block.size", GROUP_BYTES).parquet(f"{out_dir}/lines"))
    packed = lines.sparkSession.read.parquet(f"{out_dir}/lines").withColumn("part", F.col("_metadata.file_name"))
    index = packed.groupBy(*place, "part").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"))
    index.repartitionByRange(*place).sortWithinPartitions(*place, "first").write.parquet(f"{out_dir}/index")


def packed_documents(spark: SparkSession, out_dir: str) -> DataFrame:
    """The documents of a packed export: run_id, archive, file, parts, lines (without the closing bracket)."""
    index = spark.read.parquet(f"{out_dir}/index")
    return index.groupBy("run_id", "archive", "file").agg(F.count(F.lit(1)).alias("parts"), (F.sum("n") - 1).alias("lines"))


def packed_lines(spark: SparkSession, out_dir: str, run_id, archive: str, file: str) -> DataFrame:
    """The lines of one document in order, read from the files that its index names alone."""
    own = (F.col("run_id") == run_id) & (F.col("archive") == archive) & (F.col("file") == file)
    # One row per file that holds a part of the document.
    parts = [r.part for r in spark.read.parquet(f"{out_dir}/index").filter(own).select("part").collect()]
    if not parts:
        return spark.read.parquet(f"{out_dir}/lines").limit(0).select("line")
    return spark.read.parquet(*[f"{out_dir}/lines/{p}" for p in parts]).filter(own).orderBy("pos").select("line")
