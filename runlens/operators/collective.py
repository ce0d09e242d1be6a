"""What workers compute together: averages, element-wise reductions, gathers, common progress."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators.scan import MAX_ROWS, ordinal
from runlens.operators.series import pages

REDUCTIONS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
# Arrays up to this width are reduced as so many plain aggregates; wider ones element by element.
DIRECT_WIDTH = 64


def weighted_mean(df: DataFrame, keys, value: str, count: str, name: str = "mean") -> DataFrame:
    """Sum of value * count over sum of counts."""
    return df.groupBy(*keys).agg(
        (F.sum(F.col(value) * F.col(count)) / F.sum(F.col(count))).alias(name))


def rank_mean(df: DataFrame, keys, value: str, rank: str = "rank", name: str = "mean") -> DataFrame:
    """Plain mean over workers of each worker's mean."""
    per_rank = df.groupBy(*keys, rank).agg(F.avg(value).alias("_mean"))
    return per_rank.groupBy(*keys).agg(F.avg("_mean").alias(name))


def elementwise(df: DataFrame, keys, array: str, op: str = "sum", width: int = None) -> DataFrame:
    """Arrays of each group reduced element by element; arrays of unequal width in a group are an error.

    Null arrays are skipped, as are null elements.
    """
    keys = list(keys)
    fold = REDUCTIONS[op]
    if width is not None and width <= DIRECT_WIDTH:
        cell = [F.get(array, F.lit(i)) for i in range(width)]
        parts = df.groupBy(*keys).agg(*[fold(c).alias(f"_e{i}") for i, c in enumerate(cell)],
                                      F.min(F.size(array)).alias("_least"), F.max(F.size(array)).alias("_most"))
        made = F.array(*[f"_e{i}" for i in range(width)])
        even = (F.col("_least") == width) & (F.col("_most") == width)
    else:
        parts = (df.select(*keys, F.posexplode(array).alias("_pos", "_x"))
                 .groupBy(*keys, "_pos").agg(fold("_x").alias("_x"), F.count(F.lit(1)).alias("_n")))
        # One entry per array position, not per worker.
        parts = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_x"))).alias("_all"),
                                         F.min("_n").alias("_least"), F.max("_n").alias("_most"))
        made = F.transform("_all", lambda e: e["_x"])
        even = F.col("_least") == F.col("_most")
        if width is not None:
            even = even & (F.size("_all") == width)
    wrong = F.raise_error(F.lit(f"arrays of unequal width in {array}")).cast(parts.select(made.alias("m")).schema["m"].dataType)
    return parts.select(*keys, F.when(even, made).otherwise(wrong).alias(array))


def gather(df: DataFrame, keys, rank: str, column: str, **limits) -> DataFrame:
    """Every worker's value in rank order, as pages of bounded arrays."""
    return pages(df, keys, [rank], F.col(column), **limits)


def local_rank(df: DataFrame, host: str = "host", rank: str = "rank", max_rows: int = MAX_ROWS) -> DataFrame:
    """Number of lower ranks on the same host."""
    return ordinal(df, [host], [rank], "local_rank", max_rows)


def restorable_epoch(checkpoints: DataFrame, run: str = "run_id", directory: str = None) -> DataFrame:
    """Last epoch that every worker of a run has saved; ``checkpoints(run, epoch, rank)``.

    With ``directory``, runs whose checkpoints lie in more than one directory cannot be restored and
    are left out; ``restorable_status`` lists them and checks that every worker has saved.
    """
    place = [directory] if directory else []
    per_rank = checkpoints.filter(F.col("epoch").isNotNull()) \
        .groupBy(run, *place, "rank").agg(F.max("epoch").alias("_last"))
    last = F.min("_last").alias("epoch")
    if not directory:
        return per_rank.groupBy(run).agg(last)
    single = F.min(directory) == F.max(directory)
    return per_rank.groupBy(run).agg(last, single.alias("_single")).filter("_single").drop("_single")


def restorable_status(checkpoints: DataFrame, worlds: DataFrame, run: str = "run_id", directory: str = "directory",
                      world_size: str = "world_size") -> DataFrame:
    """(run, epoch, status) of every run in ``worlds(run, world_size)`` or ``checkpoints(run, directory, epoch, rank)``.

    ``ok`` with the last epoch that all workers have saved; else without epoch: ``ambiguous`` if the checkpoints lie in
    several directories, ``missing`` if workers 0 to world_size - 1 have not all saved one (a worker without any
    checkpoint is counted by its absence), ``unknown`` if the size of the run is not known.
    """
    own = checkpoints.filter(F.col("epoch").isNotNull()).groupBy(run, directory, "rank").agg(F.max("epoch").alias("_last"))
    saved = own.groupBy(run).agg((F.min(directory) == F.max(directory)).alias("_single"))
    world = own.join(worlds.select(run, F.col(world_size).alias("_world")), run, "left")
    inside = F.col("rank").between(F.lit(0), F.col("_world") - 1)
    ranks = world.groupBy(run).agg(F.min(F.when(inside, F.col("_last"))).alias("_epoch"),
                                   F.count_distinct(F.when(inside, F.col("rank"))).alias("_ranks"))
    rows = (worlds.select(run, F.col(world_size).alias("_world")).join(saved, run, "full").join(ranks, run, "left"))
    status = (F.when(~F.coalesce("_single", F.lit(True)), "ambiguous").when(F.col("_world").isNull(), "unknown")
              .when(F.coalesce("_ranks", F.lit(0)) < F.col("_world"), "missing").otherwise("ok"))
    return rows.withColumn("status", status).select(run, F.when(F.col("status") == "ok", F.col("_epoch")).alias("epoch"), "status")
