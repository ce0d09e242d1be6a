"""Linear models on sample tables: scores, losses, gradients, synchronous training.

Data stays distributed; the driver holds the weight vector, the schedule and one row per step. Each
all-reduce of the training loop is one aggregate job. Models too wide for a driver-side vector keep
their weights as a table (``gradient_table``, ``sgd_table``).
"""

import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.scores import UNROLL, cross_entropy, dot, in_top, loss_pair, sigmoid
from runlens.operators.collective import elementwise
from runlens.operators.samples import batches, limit_batches, partition_samples, reshuffled
from runlens.session import new_dir, settled


def predict_ridge(df: DataFrame, weights) -> DataFrame:
    """Adds ``score`` = w . x."""
    return df.withColumn("score", dot(F.col("features"), weights))


def predict_logistic(df: DataFrame, weights) -> DataFrame:
    """Adds ``score``, the probability of class 1."""
    return df.withColumn("score", sigmoid(dot(F.col("features"), weights)))


def penalty(weights, l1: float = 0.0, l2: float = 0.0) -> float:
    w = np.asarray(weights, dtype=float)
    return float(l2 / 2 * np.sum(w * w) + l1 * np.sum(np.abs(w)))


def loss(df: DataFrame, weights, kind: str, l1: float = 0.0, l2: float = 0.0) -> DataFrame:
    """One row: number of samples and the mean loss with its penalties."""
    row_loss, _ = loss_pair(kind)
    value = row_loss(dot(F.col("features"), weights), F.col("label").cast("double"))
    return df.agg(F.count(F.lit(1)).alias("n"), (F.avg(value) + penalty(weights, l1, l2)).alias("loss"))


def norms(weights: DataFrame, keys=(), value: str = "value") -> DataFrame:
    """Sum of absolute values and of squares over all parameters."""
    return weights.groupBy(*keys).agg(F.sum(F.abs(value)).alias("norm1"),
                                      F.sum(F.col(value) * F.col(value)).alias("norm2_squared"))


# The losses again for a task's matrix of wide rows: (loss, derivative by the score).
MATRIX_LOSSES = {
    "BCE": (lambda z, y: np.logaddexp(0.0, z) - z * y, lambda z, y: 0.5 * (1 + np.tanh(0.5 * z)) - y),
    "MSE": (lambda z, y: (z - y) ** 2, lambda z, y: 2 * (z - y)),
}


def _matrix_sums(df: DataFrame, weights, kind: str, keys) -> DataFrame:
    """Per key and task: array of row count, loss sum and gradient sums, from one product per Arrow batch."""
    w = np.asarray(weights, dtype=float)
    matrix_loss, matrix_slope = MATRIX_LOSSES[kind]

    def partials(arrow_batches):
        sums, types = {}, []
        for batch in arrow_batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column("features")
            if not pc.all(pc.equal(pc.list_value_length(lists), len(w))).as_py():
                raise ValueError(f"{len(w)} features expected")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(w))
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            z = x @ w
            types = [batch.column(k).type for k in keys]
            # Keys become whole numbers column by column; a combination of them is a group.
            coded = [batch.column(k).dictionary_encode(null_encoding="encode") for k in keys]
            cells, code = np.unique(np.column_stack([c.indices.to_numpy() for c in coded] or [np.zeros(batch.num_rows, int)]),
                                    axis=0, return_inverse=True)
            member = (code.ravel()[None, :] == np.arange(len(cells))[:, None]).astype(float)
            block = np.column_stack([member.sum(axis=1), member @ matrix_loss(z, y),
                                     (member * matrix_slope(z, y)) @ x])
            for i, cell in enumerate(cells):
                key = tuple(c.dictionary[int(v)].as_py() for c, v in zip(coded, cell))
                sums[key] = sums[key] + block[i] if key in sums else block[i]
        if sums:
            columns = [pa.array(column, kind) for column, kind in zip(zip(*sums), types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([v.tolist() for v in sums.values()])], [*keys, "_sums"])

    rows = df.select(*keys, F.col("features").cast("array<double>").alias("features"),
                     F.col("label").cast("double").alias("_y"))
    return rows.mapInArrow(partials, rows.select(*keys).schema.add("_sums", T.ArrayType(T.DoubleType())))


def rank_gradients(df: DataFrame, weights, kind: str, keys=("rank",), mean: bool = True) -> DataFrame:
    """Per worker (or other ``keys``): samples ``n``, loss, and gradient of the mean (or summed) loss.

    Narrow models: one plain aggregate per feature. Wider ones: each task multiplies its rows as
    matrices and emits one partial vector per key, which are then added element by element. Rows without label or
    features count nowhere, at any width; another number of features than weights is an error.
    """
    keys = list(keys)
    df = df.filter(F.col("label").isNotNull() & F.col("features").isNotNull())
    row_loss, slope = loss_pair(kind)
    width = len(weights)
    if width <= UNROLL:
        fold = F.avg if mean else F.sum
        y = F.col("label").cast("double")
        scored = df.select(*keys, "features", y.alias("_y"), dot(F.col("features"), weights).alias("_z")) \
            .withColumns({"_slope": slope(F.col("_z"), F.col("_y")), "_loss": row_loss(F.col("_z"), F.col("_y"))})
        out = scored.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), fold("_loss").alias("loss"),
            *[fold(F.col("_slope") * F.col("features")[i]).alias(f"_g{i}") for i in range(width)])
        return out.select(*keys, "n", "loss", F.array(*[f"_g{i}" for i in range(width)]).alias("grad"))
    sums = elementwise(_matrix_sums(df, weights, kind, keys), keys, "_sums")
    n = F.col("_sums")[0]
    by = n if mean else F.lit(1.0)
    return sums.select(*keys, n.cast("bigint").alias("n"), (F.col("_sums")[1] / by).alias("loss"),
                       F.transform(F.slice("_sums", 3, width), lambda g: g / by).alias("grad"))


def gradient(df: DataFrame, weights, kind: str, l1: float = 0.0, l2: float = 0.0,
             rank: str = "rank") -> DataFrame:
    """One row per feature: plain mean over workers of each worker's mean gradient, plus penalties.

    Workers count equally whatever their number of rows, as in an all-reduce of per-worker means.
    """
    per_rank = rank_gradients(df, weights, kind, [rank])
    mean = per_rank.select(F.posexplode("grad").alias("idx", "_g")).groupBy("idx").agg(F.avg("_g").alias("_g"))
    w = F.lit([float(v) for v in weights])[F.col("idx")]
    return mean.select(F.col("idx").cast("bigint").alias("idx"),
                       (F.col("_g") + l2 * w + l1 * F.signum(w)).alias("grad"))


def gradient_table(triplets: DataFrame, labels: DataFrame, weights: DataFrame, kind: str,
                   l1: float = 0.0, l2: float = 0.0, sample: str = "sample_id") -> DataFrame:
    """As ``gradient`` for sparse rows and a weight table: (idx, grad) for every weight.

    ``triplets(sample, idx, val)``, ``labels(sample, label, rank)``, ``weights(idx, value)``.
    A feature present in most samples is a hot join key; the weight side is the one that is
    replicated when Spark splits it, and sums combine before the exchange.
    """
    _, slope = loss_pair(kind)
    scores = (triplets.join(weights.select("idx", "value"), "idx")
              .groupBy(sample).agg(F.sum(F.col("val") * F.col("value")).alias("_z")))
    sizes = labels.groupBy("rank").agg(F.count(F.lit(1)).alias("_n"))
    world = sizes.agg(F.count(F.lit(1))).scalar()
    slopes = (labels.join(scores, sample, "left").join(sizes, "rank")
              .select(sample, (slope(F.coalesce(F.col("_z"), F.lit(0.0)), F.col("label").cast("double"))
                               / F.col("_n") / world).alias("_s")))
    sums = (triplets.join(slopes, sample).groupBy("idx")
            .agg(F.sum(F.col("val") * F.col("_s")).alias("_g")))
    return (weights.join(sums, "idx", "left")
            .select("idx", (F.coalesce(F.col("_g"), F.lit(0.0)) + l2 * F.col("value")
                            + l1 * F.signum("value")).alias("grad")))


def sgd_table(weights: DataFrame, gradients: DataFrame, lr: float, momentum: float = 0.0,
              weight_decay: float = 0.0, nesterov: bool = False) -> DataFrame:
    """One optimizer step on ``weights(idx, value[, buffer])`` with ``gradients(idx, grad)``."""
    if "buffer" not in weights.columns:
        weights = weights.withColumn("buffer", F.lit(None).cast("double"))
    joined = weights.join(gradients, "idx", "left")
    g = F.coalesce(F.col("grad"), F.lit(0.0)) + weight_decay * F.col("value")
    buffer = F.coalesce(momentum * F.col("buffer") + g, g)
    step = (g + momentum * buffer) if nesterov else buffer
    return joined.select("idx", (F.col("value") - lr * step).alias("value"), buffer.alias("buffer"))


def sgd_step(weights, buffer, grad, lr: float, momentum: float = 0.0, weight_decay: float = 0.0,
             nesterov: bool = False) -> tuple:
    """The same step on vectors: (weights, buffer)."""
    w, g = np.asarray(weights, dtype=float), np.asarray(grad, dtype=float)
    g = g + weight_decay * w
    buffer = g if buffer is None else momentum * np.asarray(buffer) + g
    return w - lr * (g + momentum * buffer if nesterov else buffer), buffer


def cross_entropy_loss(df: DataFrame, scores: str = "scores", label: str = "label", keys=()) -> DataFrame:
    """Number of rows and mean cross entropy of class scores."""
    value = cross_entropy(F.col(scores), F.col(label))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("loss"))


def topk_accuracy(df: DataFrame, ks=(1, 5), scores: str = "scores", label: str = "label", keys=()) -> DataFrame:
    """Percentage of rows whose label is among the k best classes, as ``prec_<k>``."""
    return df.groupBy(*keys).agg(
        *[(F.avg(in_top(F.col(scores), F.col(label), k)) * 100).alias(f"prec_{k}") for k in ks])


def validate(df: DataFrame, weights, kind: str, l1: float = 0.0, l2: float = 0.0, metrics=None) -> DataFrame:
    """Count-weighted loss and metrics over all validation rows, without update.

    ``metrics`` maps a name to a function of (score, label) giving a row value to be averaged.
    """
    row_loss, _ = loss_pair(kind)
    z, y = dot(F.col("features"), weights), F.col("label").cast("double")
    extra = [F.avg(fn(z, y)).alias(name) for name, fn in (metrics or {}).items()]
    return df.agg(F.count(F.lit(1)).alias("n"),
                  (F.avg(row_loss(z, y)) + penalty(weights, l1, l2)).alias("val_loss"), *extra)


@dataclass
class Training:
    """Settings of a synchronous run."""

    kind: str = "MSE"
    world_size: int = 4
    batch_size: int = 32
    epochs: int = 1
    rate: object = 0.1            # a number, or a function of the step
    rate_level: str = "batch"     # which counter the rate follows: batch or epoch
    momentum: float = 0.0
    weight_decay: float = 0.0
    nesterov: bool = False
    l1: float = 0.0
    l2: float = 0.0
    max_batches: int = None
    eval_every: int = 1
    shuffle: bool = True
    repartition: bool = False     # a new partition of the samples each epoch
    reshuffle: bool = False       # a new order inside each worker's partition each epoch
    seed: int = 42
    mode: str = "exact"           # exact: one job per step; moments: one job per layout (MSE)
    metrics: dict = field(default_factory=dict)


@dataclass
class State:
    """Where a run stands."""

    weights: np.ndarray
    buffer: np.ndarray = None
    epoch: int = -1
    steps: int = 0
    train_time: float = 0.0
    best: float = None
    best_epoch: int = None


# Numbers of per-batch moments that the driver reads at a time.
MOMENT_NUMBERS = 500_000
HISTORY = ("epoch bigint, step bigint, name string, value double, cumu_time double")


def lay_out(df: DataFrame, sample: str, cfg: Training, epoch: int) -> DataFrame:
    """Samples with worker and batch, written once in batch order so that a step reads its own rows only."""
    placed = partition_samples(df, sample, cfg.world_size, cfg.seed, epoch if cfg.repartition else 0, cfg.shuffle)
    if cfg.reshuffle:
        placed = reshuffled(placed, sample, cfg.seed, epoch)
    placed = limit_batches(batches(placed, cfg.batch_size), cfg.max_batches)
    # Positions are dense, so equal ranges of them are equal shares of the rows: no sampling needed.
    spark = df.sparkSession
    used = -(-df.count() // cfg.world_size)
    if cfg.max_batches is not None:
        used = min(used, cfg.max_batches * cfg.batch_size)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("pos_in_rank") * parts / max(used, 1)).cast("int")
    path = new_dir(spark, "batches")
    (placed.select("rank", "batch_idx", "features", F.col("label").cast("double").alias("label"), part.alias("_part"))
     .repartitionById(parts, "_part").sortWithinPartitions("batch_idx")
     .drop("_part").write.parquet(path))
    return spark.read.parquet(path)


def _exact_steps(data: DataFrame, cfg: Training):
    def step(batch, weights):
        rows = rank_gradients(data.filter(F.col("batch_idx") == batch), weights, cfg.kind)
        if len(weights) <= UNROLL:
            # One short row per worker.
            own = rows.select("loss", "grad").collect()
            return float(np.mean([r["loss"] for r in own])), np.mean([r["grad"] for r in own], axis=0)
        # One number per feature, the loss at position -1.
        means = (rows.select(F.posexplode("grad").alias("i", "g"))
                 .unionByName(rows.select(F.lit(-1).alias("i"), F.col("loss").alias("g")))
                 .groupBy("i").agg(F.avg("g").alias("g")).orderBy("i"))
        values = [r["g"] for r in means.toLocalIterator()]
        return values[0], np.array(values[1:])
    return step


def _moment_steps(data: DataFrame, width: int, world_size: int):
    """Squared error depends on the data only through X'X, X'y, y'y and n of each (batch, worker).

    The moments are one written table in batch order. The driver reads the batches of a few steps at a time, about
    MOMENT_NUMBERS numbers, or those of a single batch where they are more.
    """
    x = F.col("features")
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    table = data.groupBy("batch_idx", "rank").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label") * F.col("label")).alias("yy"),
        *[F.sum(x[i] * F.col("label")).alias(f"xy{i}") for i in range(width)],
        *[F.sum(x[i] * x[j]).alias(f"xx{i}_{j}") for i, j in pairs])
    spark, path = data.sparkSession, new_dir(data.sparkSession, "moments")
    table.repartitionByRange("batch_idx").sortWithinPartitions("batch_idx", "rank").write.parquet(path)
    table = spark.read.parquet(path)

    at_once = max(1, MOMENT_NUMBERS // (world_size * width * width))
    held = {}

    def read(first):
        held.clear()
        held[first] = {}
        for row in table.filter(F.col("batch_idx").between(first, first + at_once - 1)).orderBy("batch_idx", "rank").collect():
            xx = np.zeros((width, width))
            for i, j in pairs:
                xx[i, j] = xx[j, i] = row[f"xx{i}_{j}"]
            held[first].setdefault(row["batch_idx"], []).append(
                (row["n"], row["yy"], np.array([row[f"xy{i}"] for i in range(width)]), xx))

    def step(batch, w):
        first = batch - batch % at_once
        if first not in held:
            read(first)
        moments = held[first][batch]
        losses = [(yy - 2 * w @ xy + w @ xx @ w) / n for n, yy, xy, xx in moments]
        grads = [2 * (xx @ w - xy) / n for n, yy, xy, xx in moments]
        return float(np.mean(losses)), np.mean(grads, axis=0)
    return step


def train(train_df: DataFrame, val_df: DataFrame, weights, cfg: Training, sample: str = "sample_id",
          state: State = None, save=None, history_path: str = None) -> tuple:
    """Synchronous mini-batch training: (final state, history table).

    Each step averages the workers' mean gradients; the last short batch of a worker counts as much
    as a full one. ``save(state, is_best)`` is called after every evaluated epoch. A state from an
    earlier run continues at its next epoch with its clock. With ``history_path`` the history of each
    epoch is written there when the epoch ends, otherwise it is kept until the end.
    """
    spark = train_df.sparkSession
    state = state or State(np.asarray(weights, dtype=float))
    width = len(state.weights)
    history, data, steps, step = [], None, 0, None
    for epoch in range(state.epoch + 1, cfg.epochs):
        if data is None or cfg.repartition or cfg.reshuffle:
            data = lay_out(train_df, sample, cfg, epoch)
            steps = (data.agg(F.max("batch_idx")).first()[0] or 0) + 1
            if cfg.mode == "moments":
                if cfg.kind != "MSE":
                    raise ValueError("moments need squared error")
                step = _moment_steps(data, width, cfg.world_size)
            else:
                step = _exact_steps(data, cfg)
        for batch in range(steps):
            began = time.time()
            counter = state.steps if cfg.rate_level == "batch" else epoch
            lr = cfg.rate(counter) if callable(cfg.rate) else cfg.rate
            value, grad = step(batch, state.weights)
            value += penalty(state.weights, cfg.l1, cfg.l2)
            grad = grad + cfg.l2 * state.weights + cfg.l1 * np.sign(state.weights)
            state.weights, state.buffer = sgd_step(state.weights, state.buffer, grad, lr, cfg.momentum,
                                                   cfg.weight_decay, cfg.nesterov)
            state.steps += 1
            state.train_time += time.time() - began
            history.append((epoch, state.steps, "train_loss", value, state.train_time))
            history.append((epoch, state.steps, "lr", float(lr), state.train_time))
        state.epoch = epoch
        if val_df is not None and (epoch + 1) % cfg.eval_every == 0:
            row = validate(val_df, state.weights, cfg.kind, cfg.l1, cfg.l2, cfg.metrics).first()
            for name in ["val_loss", *cfg.metrics]:
                history.append((epoch, state.steps, name, row[name], state.train_time))
            is_best = False
            if cfg.metrics:
                # Neither NaN nor the null of an empty validation set is ever the best value.
                primary = row[next(iter(cfg.metrics))]
                is_best = primary is not None and primary == primary and (state.best is None or primary > state.best)
                if is_best:
                    state.best, state.best_epoch = primary, epoch
            if save is not None:
                save(state, is_best)
        if history_path is not None:
            spark.createDataFrame(history, HISTORY).write.mode("overwrite").parquet(f"{history_path}/part={epoch}")
            history = []
    if history_path is not None:
        return state, spark.read.schema(HISTORY).parquet(history_path)
    return state, spark.createDataFrame(history, HISTORY)


def train_table(triplets: DataFrame, labels: DataFrame, weights: DataFrame, cfg: Training,
                sample: str = "sample_id") -> DataFrame:
    """As ``train`` for sparse rows and weights of any number: returns the table (idx, value, buffer).

    ``triplets(sample, idx, val)``, ``labels(sample, label)``, ``weights(idx, value)``. Weights are
    written after every step, which ends its lineage.
    """
    placed = partition_samples(labels, sample, cfg.world_size, cfg.seed, 0, cfg.shuffle)
    placed = limit_batches(batches(placed, cfg.batch_size), cfg.max_batches).select(sample, "label", "rank", "batch_idx")
    spark, path = labels.sparkSession, new_dir(labels.sparkSession, "batches")
    placed.repartitionByRange("batch_idx", sample).sortWithinPartitions("batch_idx").write.parquet(f"{path}/labels")
    placed = spark.read.parquet(f"{path}/labels")
    (triplets.join(placed.select(sample, "batch_idx"), sample)
     .repartitionByRange("batch_idx", sample, "idx").sortWithinPartitions("batch_idx").write.parquet(f"{path}/triplets"))
    triplets = spark.read.parquet(f"{path}/triplets")
    steps, done = (placed.agg(F.max("batch_idx")).first()[0] or 0) + 1, 0
    for epoch in range(cfg.epochs):
        for batch in range(steps):
            counter = done if cfg.rate_level == "batch" else epoch
            lr = cfg.rate(counter) if callable(cfg.rate) else cfg.rate
            mine = F.col("batch_idx") == batch
            grads = gradient_table(triplets.filter(mine), placed.filter(mine), weights, cfg.kind, cfg.l1, cfg.l2, sample)
            weights = settled(sgd_table(weights, grads, lr, cfg.momentum, cfg.weight_decay, cfg.nesterov))
            done += 1
    return weights


def train_local_sgd(df: DataFrame, weights, rounds: int, lr: float) -> np.ndarray:
    """Each worker steps along its summed squared error, then weights are averaged; one job per round.

    From a common start the average of the stepped weights is one step along the average gradient,
    so a round needs the workers' gradient sums only.
    """
    w = np.asarray(weights, dtype=float)
    for _ in range(rounds):
        grads = rank_gradients(df, w, "MSE", mean=False) \
            .select(F.posexplode("grad").alias("i", "g")).groupBy("i").agg(F.avg("g").alias("g"))
        w = w - lr * np.array([r["g"] for r in grads.orderBy("i").toLocalIterator()])
    return w


def weights_table(spark, weights) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(weights)], "idx bigint, value double")
