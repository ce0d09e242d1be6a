"""Worker logs and captured job output as tables of lines."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.operators.scan import MAX_ROWS, ordered
from runlens.session import written

# The line format and the messages the trainer writes.
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (\S+) (\d+) (\w+): (.*)$"
TRAIN = r"^Train Batch\s+(\d+): loss=(\S+)$"
EPOCH = r"^Current epoch : (\d+) : lr=(.*) : time=\s*(\S+)$"
VALIDATION = r"^Validation loss=(\S+)$"
BEST = r"^best_(\S+) for rank (\d+):\(best epoch (\d+), current epoch (\d+)\): (\S+)$"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def read_worker_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their place: folder of the log, file, split of the file, line in the split."""
    return (spark.read.option("recursiveFileLookup", "true").text(path)
            .select(F.col("value").alias("line"),
                    F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]*$", 1).alias("source"),
                    F.col("_metadata.file_name").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("seq")))


def parse_worker_logs(lines: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Typed rows of the known messages; lines without their own epoch get that of the line before.

    Lines of another form (stack traces, wrapped messages, impossible dates) are kept: kind ``other``, the whole line as
    message, without time, rank, level or epoch. Every line keeps its place (source, file, block, seq), which puts a stack
    trace back behind its message.
    """
    def part(pattern, i):
        return F.regexp_extract("line", LINE, i) if pattern == LINE else \
            F.regexp_extract("message", pattern, i)

    given = lines.withColumn("_ts", F.when(F.col("line").rlike(LINE), part(LINE, 1).try_cast("timestamp"))) \
        .withColumn("_rank", F.when(F.col("_ts").isNotNull(), part(LINE, 3).try_cast("bigint")))
    formed = F.col("_ts").isNotNull() & F.col("_rank").isNotNull()
    rows = given.filter(formed).select(
        "source", "file", "block", "seq", F.col("_ts").alias("ts"), F.col("_rank").alias("rank"),
        part(LINE, 4).alias("level"), part(LINE, 5).alias("message"))
    odd = given.filter(~formed).select("source", "file", "block", "seq", F.col("line").alias("message"),
                                       F.lit("other").alias("kind"))
    message = F.col("message")
    kind = (F.when(message.rlike(TRAIN), "train").when(message.rlike(EPOCH), "epoch")
            .when(message.rlike(VALIDATION), "validation").when(message.rlike(BEST), "best").otherwise("other"))
    rows = rows.withColumn("kind", kind)
    rows = rows.withColumns({
        "_own": F.when(F.col("kind") == "epoch", part(EPOCH, 1).try_cast("bigint"))
                 .when(F.col("kind") == "best", part(BEST, 4).try_cast("bigint")),
        "batch": F.when(F.col("kind") == "train", part(TRAIN, 1).try_cast("bigint")),
        "metric": F.when(F.col("kind") == "best", part(BEST, 1)),
        "best_epoch": F.when(F.col("kind") == "best", part(BEST, 3).try_cast("bigint")),
        "value": F.when(F.col("kind") == "train", part(TRAIN, 2))
                  .when(F.col("kind") == "epoch", part(EPOCH, 3))
                  .when(F.col("kind") == "validation", part(VALIDATION, 1))
                  .when(F.col("kind") == "best", part(BEST, 5)).try_cast("double")})
    place = ["ts", "file", "block", "seq"]
    run = ordered(rows, ["source", "rank"], place, max_rows).carry(_before=("last", F.col("_own")))
    epoch = F.coalesce(F.last("_own", ignorenulls=True).over(run.running()), F.col("_before"))
    known = run.add(epoch=epoch).result("source", "file", "block", "seq", "ts", "rank", "level", "kind", "epoch", "batch", "metric",
                                        "best_epoch", "value", "message")
    return known.unionByName(odd, allowMissingColumns=True)


def explode_job_output(jobs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Lines of captured output numbered per (run, stream); ``jobs(run_id, chunk_no, stdout, stderr)``.

    Only the line counts of the chunks are brought together by run. Texts are exchanged by chunk, if at all, so a run's output
    needs no task of its own. ``jobs`` is read twice.
    """
    streams, keys = ("stdout", "stderr"), ["run_id", "chunk_no"]
    rows = jobs.withColumns({s: F.coalesce(F.split(s, LINE_BREAK, -1), F.array().cast("array<string>")) for s in streams})
    # A break at the very end of a chunk opens no further line.
    rows = rows.withColumns({s: F.when(F.try_element_at(s, F.lit(-1)) == "", F.slice(s, 1, F.size(s) - 1)).otherwise(F.col(s))
                             for s in streams})
    sizes = {s: F.size(s).cast("bigint") for s in streams}
    counts = rows.groupBy(*keys).agg(*[F.sum(sizes[s]).alias(f"_{s}") for s in streams], F.count(F.lit(1)).alias("_rows"))
    counts = written(counts, "chunks")
    placed = ordered(counts, ["run_id"], ["chunk_no"], max_rows).carry(**{f"_{s}_before": ("sum", F.col(f"_{s}")) for s in streams})
    placed = placed.result("run_id", "chunk_no", "_rows", *[
        (F.coalesce(F.sum(f"_{s}").over(placed.before()), F.lit(0)) + F.coalesce(f"_{s}_before", F.lit(0))).alias(f"_{s}_start")
        for s in streams]).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rows = rows.select(*keys, *streams).join(placed, same)
    if not counts.filter("_rows > 1").isEmpty():
        # Rows that share a chunk number follow one another.
        shared = rows.filter("_rows > 1")
        earlier = Window.partitionBy(*keys).orderBy(*streams).rowsBetween(Window.unboundedPreceding, -1)
        shared = shared.withColumns({f"_{s}_start": F.col(f"_{s}_start") + F.coalesce(F.sum(sizes[s]).over(earlier), F.lit(0))
                                     for s in streams})
        rows = rows.filter("_rows = 1").unionByName(shared)
    return (rows.select("run_id", F.inline(F.array(*[F.struct(F.lit(s).alias("stream"), F.col(f"_{s}_start").alias("start"),
                                                              F.col(s).alias("lines")) for s in streams])))
            .select("run_id", "stream", "start", F.posexplode("lines").alias("_pos", "line"))
            .select("run_id", "stream", (F.col("start") + F.col("_pos")).alias("line_no"), "line"))
