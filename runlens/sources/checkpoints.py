"""Checkpoint listings and the model-state store."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.scalars import BEST_CHECKPOINT, checkpoint_epoch, checkpoint_rank, run_of_dir

POLICIES = ("never", "all", "best")


def parse_checkpoint_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """Run, dataset, model, optimizer, epoch and rank of ``.../<run>_<dataset>_<model>_<opt>/<epoch>_<rank>...``."""
    out = paths.withColumns({
        "directory": F.substring_index(F.substring_index(path, "/", -2), "/", 1),
        "_file": F.substring_index(path, "/", -1)})
    parts = {name: F.split_part("directory", F.lit("_"), F.lit(i))
             for i, name in enumerate(("dataset", "model", "optimizer"), start=2)}
    return out.withColumns({"run_id": run_of_dir(F.col("directory")), **parts, "epoch": checkpoint_epoch(F.col("_file")), "rank": checkpoint_rank(F.col("_file")),
                            "is_best": F.col("_file") == BEST_CHECKPOINT}).drop("_file")


def list_checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """Checkpoint files below ``root``; file contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "modificationTime", "length"))
    return parse_checkpoint_paths(files)


def save_state(weights: DataFrame, meta: DataFrame, path: str, run_id: str, attempt: int, epoch: int,
               policy: str = "all", is_best: bool = False) -> None:
    """Store ``weights(idx, value, buffer)`` and the one-row ``meta`` of an epoch.

    ``all`` keeps every epoch and the best, ``best`` only the best, ``never`` nothing. ``attempt``
    grows with every start that does not resume; older attempts are not read any more. The meta row
    is written last: an epoch without it does not count.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    places = []
    if policy == "all":
        places.append(f"epochs/run_id={run_id}/attempt={attempt}/epoch={epoch}")
    if policy != "never" and is_best:
        places.append(f"best/run_id={run_id}/attempt={attempt}")
    for place in places:
        weights.write.mode("overwrite").parquet(f"{path}/weights/{place}")
        meta.write.mode("overwrite").parquet(f"{path}/meta/{place}")


def saved_epochs(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Meta rows of the latest attempt of a run."""
    meta = spark.read.option("basePath", f"{path}/meta/epochs").parquet(f"{path}/meta/epochs/run_id={run_id}")
    latest = meta.agg(F.max("attempt")).scalar()
    return meta.filter(F.col("attempt") == latest)


def load_state(spark: SparkSession, path: str, run_id: str, epoch: int = None) -> tuple:
    """(weights table, meta row) of an epoch, by default the last one saved."""
    saved = saved_epochs(spark, path, run_id)
    if epoch is not None:
        saved = saved.filter(F.col("epoch") == epoch)
    meta = saved.orderBy(F.col("epoch").desc()).first()
    if meta is None:
        raise FileNotFoundError(f"no state of run {run_id} below {path}")
    place = f"epochs/run_id={run_id}/attempt={meta['attempt']}/epoch={meta['epoch']}"
    return spark.read.parquet(f"{path}/weights/{place}"), meta


def load_best(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Weights of the best epoch of the latest attempt."""
    best = spark.read.option("basePath", f"{path}/weights/best").parquet(f"{path}/weights/best/run_id={run_id}")
    return best.filter(F.col("attempt") == best.agg(F.max("attempt")).scalar())
