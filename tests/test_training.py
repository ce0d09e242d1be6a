"""Gradients, updates and the training loop against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import linear, samples
from runlens.operators.collective import elementwise, restorable_epoch
from runlens.operators.resume import resume, store
from runlens.sources.checkpoints import load_best


def make(spark, n, d, ranks=3, kind="MSE", seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = x @ rng.normal(size=d) if kind == "MSE" else (rng.random(n) > 0.5).astype(float)
    rank = np.sort(rng.integers(0, ranks, n))
    df = spark.createDataFrame([(i, int(r), [float(v) for v in row], float(t))
                                for i, (r, row, t) in enumerate(zip(rank, x, y))],
                               "sample_id bigint, rank bigint, features array<double>, label double").repartition(3)
    return x, y, rank, df


def numpy_loss(x, y, w, kind, l1=0.0, l2=0.0):
    z = x @ w
    if kind == "MSE":
        value = np.mean((z - y) ** 2)
    else:
        value = np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y)
    return value + l2 / 2 * np.sum(w * w) + l1 * np.sum(np.abs(w))


@pytest.mark.parametrize("kind", ["MSE", "BCE"])
@pytest.mark.parametrize("d", [5, 80])
def test_gradient_is_mean_of_worker_means(spark, kind, d):
    x, y, rank, df = make(spark, 200, d, kind=kind)
    w = np.linspace(-1, 1, d) + 0.013
    got = [r["grad"] for r in linear.gradient(df, list(w), kind, 0.01, 0.1).orderBy("idx").collect()]

    def mean_loss(v):
        return np.mean([numpy_loss(x[rank == r], y[rank == r], v, kind) for r in range(3)]) + \
            0.05 * np.sum(v * v) + 0.01 * np.sum(np.abs(v))
    eps = 1e-6
    want = [(mean_loss(w + eps * e) - mean_loss(w - eps * e)) / (2 * eps) for e in np.eye(d)]
    assert got == pytest.approx(want, abs=1e-6)
    assert linear.loss(df, list(w), kind, 0.01, 0.1).first()["loss"] == pytest.approx(numpy_loss(x, y, w, kind, 0.01, 0.1))


def test_sparse_gradient_equals_dense(spark):
    x, y, rank, df = make(spark, 60, 6)
    df = df.withColumn("features", F.transform("features", lambda v: F.when(v > 0.5, v).otherwise(0.0)))
    w = [0.1, -0.2, 0.3, 0.0, 0.5, -0.6]
    dense = [r["grad"] for r in linear.gradient(df, w, "MSE", 0.01, 0.1).orderBy("idx").collect()]
    sparse = linear.gradient_table(samples.to_triplets(df), df.select("sample_id", "label", "rank"),
                                   linear.weights_table(spark, w), "MSE", 0.01, 0.1)
    assert [r["grad"] for r in sparse.orderBy("idx").collect()] == pytest.approx(dense)


@pytest.mark.parametrize("nesterov", [False, True])
def test_table_step_equals_vector_step(spark, nesterov):
    w, buffer = np.array([1.0, -2.0, 0.5]), None
    table = linear.weights_table(spark, w)
    for g in ([0.1, 0.2, -0.3], [0.4, 0.0, 0.1]):
        w, buffer = linear.sgd_step(w, buffer, g, 0.1, 0.9, 0.01, nesterov)
        grads = spark.createDataFrame(list(enumerate(g)), "idx bigint, grad double")
        table = linear.sgd_table(table, grads, 0.1, 0.9, 0.01, nesterov)
    rows = table.orderBy("idx").collect()
    assert [r["value"] for r in rows] == pytest.approx(list(w))
    assert [r["buffer"] for r in rows] == pytest.approx(list(buffer))


def test_one_worker_is_plain_sgd(spark):
    x, y, _, df = make(spark, 50, 4)
    cfg = linear.Training("MSE", 1, 20, 2, lambda s: 0.05 / (1 + s), momentum=0.9, l2=0.01, l1=0.001)
    state, history = linear.train(df, None, np.zeros(4), cfg)
    order = [r["sample_id"] for r in samples.partition_samples(df, "sample_id", 1).orderBy("pos").collect()]
    w, buffer, step = np.zeros(4), None, 0
    losses = []
    for _ in range(2):
        for at in range(0, 50, 20):
            part = order[at:at + 20]
            losses.append(numpy_loss(x[part], y[part], w, "MSE", 0.001, 0.01))
            g = 2 * x[part].T @ (x[part] @ w - y[part]) / len(part) + 0.01 * w + 0.001 * np.sign(w)
            w, buffer = linear.sgd_step(w, buffer, g, 0.05 / (1 + step), 0.9)
            step += 1
    assert list(state.weights) == pytest.approx(list(w))
    got = [r["value"] for r in history.filter("name = 'train_loss'").orderBy("step").collect()]
    assert got == pytest.approx(losses)


@pytest.mark.parametrize("options", [{}, {"repartition": True}, {"reshuffle": True}, {"shuffle": False}, {"max_batches": 2}])
def test_moments_equal_exact(spark, options):
    _, _, _, df = make(spark, 70, 3)
    runs = [linear.train(df, df, np.zeros(3), linear.Training(
        "MSE", 3, 6, 2, 0.05, momentum=0.9, nesterov=True, l2=0.01, mode=mode, **options)) for mode in ("exact", "moments")]
    assert list(runs[0][0].weights) == pytest.approx(list(runs[1][0].weights))
    a, b = ([r["value"] for r in h.orderBy("step", "name").collect()] for _, h in runs)
    assert a == pytest.approx(b)


def test_moments_need_squared_error(spark):
    _, _, _, df = make(spark, 10, 2)
    with pytest.raises(ValueError):
        linear.train(df, None, np.zeros(2), linear.Training("BCE", 1, 5, mode="moments"))


def test_table_training_equals_vector_training(spark):
    _, _, _, df = make(spark, 50, 4)
    df = df.withColumn("features", F.transform("features", lambda v: F.when(v > 0, v).otherwise(0.0)))
    cfg = linear.Training("MSE", 2, 10, 2, lambda s: 0.1 / (1 + s), momentum=0.9, nesterov=True, weight_decay=0.01, l1=0.001)
    state, _ = linear.train(df, None, np.zeros(4), cfg)
    table = linear.train_table(samples.to_triplets(df), df.select("sample_id", "label"), linear.weights_table(spark, np.zeros(4)), cfg)
    rows = table.orderBy("idx").collect()
    assert [r["value"] for r in rows] == pytest.approx(list(state.weights))
    assert [r["buffer"] for r in rows] == pytest.approx(list(state.buffer))


def test_history_written_per_epoch(spark, tmp_path):
    _, _, _, df = make(spark, 40, 2)
    cfg = linear.Training("MSE", 2, 10, 2, 0.1)
    _, kept = linear.train(df, df, np.zeros(2), cfg)
    _, written = linear.train(df, df, np.zeros(2), cfg, history_path=str(tmp_path / "h"))
    columns = ["epoch", "step", "name", F.round("value", 9).alias("value")]
    assert sorted(map(tuple, kept.select(*columns).collect())) == sorted(map(tuple, written.select(*columns).collect()))


def test_wide_training_step(spark):
    x, y, _, df = make(spark, 40, 70)
    state, _ = linear.train(df, None, np.zeros(70), linear.Training("MSE", 1, 100, 1, 0.01))
    assert list(state.weights) == pytest.approx(list(0.01 * 2 * x.T @ y / 40))


def test_resume_equals_uninterrupted(spark, tmp_path):
    _, _, _, df = make(spark, 60, 3, kind="BCE")
    hits = {"hits": lambda z, y: F.when((z > 0) == (y > 0.5), 100.0).otherwise(0.0)}

    def cfg(epochs):
        return linear.Training("BCE", 2, 10, epochs, 0.3, momentum=0.9, repartition=True, metrics=hits)
    whole, _ = linear.train(df, df, np.zeros(3), cfg(4))

    def save(state, is_best):
        store(spark, state, str(tmp_path), "5", 1, "all", is_best)
    first, _ = linear.train(df, df, np.zeros(3), cfg(2), save=save)
    state = resume(spark, str(tmp_path), "5")
    assert (state.epoch, state.steps) == (1, first.steps) and state.train_time == pytest.approx(first.train_time)
    state, history = linear.train(df, df, None, cfg(4), state=state)
    assert list(state.weights) == pytest.approx(list(whole.weights))
    assert (state.best, state.best_epoch) == (whole.best, whole.best_epoch)
    assert history.agg(F.min("epoch")).first()[0] == 2
    assert history.filter("name = 'val_loss'").agg(F.min("cumu_time")).first()[0] > first.train_time


def test_state_policies_and_attempts(spark, tmp_path):
    def state(epoch, w):
        return linear.State(np.array([w]), None, epoch, epoch + 1)
    path = str(tmp_path)
    store(spark, state(0, 1.0), path, "a", 1, "best", True)
    store(spark, state(1, 2.0), path, "a", 1, "best", False)
    assert load_best(spark, path, "a").first()["value"] == 1.0
    store(spark, state(0, 3.0), path, "b", 1, "all", True)
    store(spark, state(1, 4.0), path, "b", 1, "all", False)
    assert resume(spark, path, "b").weights[0] == 4.0
    assert resume(spark, path, "b", 0).weights[0] == 3.0
    assert load_best(spark, path, "b").first()["value"] == 3.0
    store(spark, state(0, 5.0), path, "b", 2, "all", True)
    assert (resume(spark, path, "b").weights[0], resume(spark, path, "b").epoch) == (5.0, 0)
    with pytest.raises(FileNotFoundError):
        resume(spark, path, "b", 1)
    with pytest.raises(ValueError):
        store(spark, state(0, 1.0), path, "c", 1, "sometimes")


def test_local_sgd(spark):
    x, y, rank, df = make(spark, 40, 3)
    w = np.zeros(3)
    for _ in range(3):
        w = np.mean([w - 0.001 * 2 * x[rank == r].T @ (x[rank == r] @ w - y[rank == r]) for r in range(3)], axis=0)
    assert list(linear.train_local_sgd(df, np.zeros(3), 3, 0.001)) == pytest.approx(list(w))


@pytest.mark.parametrize("width", [None, 6])
def test_all_reduce_of_one_hot_vectors(spark, width):
    df = spark.range(6).select(F.lit(0).alias("g"), F.transform(
        F.sequence(F.lit(0), F.lit(5)), lambda i: (i == F.col("id")).cast("double")).alias("v"))
    assert elementwise(df, ["g"], "v", "sum", width).first()["v"] == [1.0] * 6


def test_restorable_epoch_is_numeric(spark):
    rows = [("a", e, r) for r in (0, 1) for e in range(11)] + [("a", 11, 0)]
    df = spark.createDataFrame(rows, "run_id string, epoch bigint, rank bigint")
    assert restorable_epoch(df).first()["epoch"] == 10
