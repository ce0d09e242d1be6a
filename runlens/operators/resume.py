"""Saving a training state per epoch and continuing from it."""

import numpy as np
from pyspark.sql import SparkSession

from runlens.operators.linear import State
from runlens.sources.checkpoints import load_state, save_state

META = "steps bigint, train_time double, best double, best_epoch bigint, has_buffer boolean"


def store(spark: SparkSession, state: State, path: str, run_id: str, attempt: int, policy: str = "all",
          is_best: bool = False) -> None:
    """Write weights, optimizer buffer and clock of ``state`` under the given policy."""
    buffer = state.buffer if state.buffer is not None else [None] * len(state.weights)
    weights = spark.createDataFrame(
        [(i, float(w), None if b is None else float(b)) for i, (w, b) in enumerate(zip(state.weights, buffer))],
        "idx bigint, value double, buffer double")
    best = None if state.best is None else float(state.best)
    meta = spark.createDataFrame(
        [(state.steps, state.train_time, best, state.best_epoch, state.buffer is not None)], META)
    save_state(weights, meta, path, run_id, attempt, state.epoch, policy, is_best)


def resume(spark: SparkSession, path: str, run_id: str, epoch: int = None) -> State:
    """State of the last saved (or given) epoch; training continues at the next one."""
    weights, meta = load_state(spark, path, run_id, epoch)
    rows = list(weights.orderBy("idx").toLocalIterator())
    buffer = np.array([r["buffer"] for r in rows], dtype=float) if meta["has_buffer"] else None
    return State(np.array([r["value"] for r in rows]), buffer, meta["epoch"], meta["steps"], meta["train_time"],
                 meta["best"], meta["best_epoch"])
