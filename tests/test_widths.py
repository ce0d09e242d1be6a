"""One behaviour on both sides of every width at which a plan changes, and nothing dropped in silence."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from runlens.functions.scores import dot
from runlens.operators import collective, linear, samples
from runlens.sources import tables


def vectors(spark, *rows):
    return spark.createDataFrame(list(rows), "rank int, features array<double>, label double")


@pytest.mark.parametrize("width", [3, 64, 65, 70])
def test_another_number_of_features_is_an_error(spark, width):
    for wrong in (width - 1, width + 1):
        df = vectors(spark, (0, [1.0] * wrong, 1.0))
        for job in (df.select(dot(F.col("features"), [1.0] * width)), samples.standardize(df, [0.0] * width, [1.0] * width),
                    linear.rank_gradients(df, [1.0] * width, "MSE")):
            with pytest.raises(PySparkException):
                job.collect()


@pytest.mark.parametrize("width", [1, 64, 65, 70])
def test_scores_and_gradients_at_any_width(spark, width):
    df = vectors(spark, (0, [2.0] * width, 1.0), (0, [2.0] * width, None), (0, None, 1.0), (1, [1.0] * width, 0.0), (None, [1.0] * width, 0.0))
    scores = [r[0] for r in df.select(dot(F.col("features"), [1.0] * width)).collect()]
    assert scores == [2.0 * width, 2.0 * width, None, width, width]
    got = {r["rank"]: r for r in linear.rank_gradients(df, [1.0] * width, "MSE").collect()}
    assert {k: r["n"] for k, r in got.items()} == {0: 1, 1: 1, None: 1}
    assert got[0]["loss"] == pytest.approx((2 * width - 1) ** 2) and got[0]["grad"] == pytest.approx([4.0 * (2 * width - 1)] * width)
    scaled = samples.standardize(df.limit(1), [1.0] * width, [2.0] * width).first()["features"]
    assert scaled == [0.5] * width


@pytest.mark.parametrize("width", [None, 2])
def test_elementwise_takes_even_arrays_only(spark, width):
    even = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, None]), (1, None)], "k int, v array<double>")
    assert collective.elementwise(even, ["k"], "v", "sum", width).first()["v"] == [4.0, 2.0]
    for short in ([1.0], [1.0, 2.0, 3.0]):
        uneven = spark.createDataFrame([(1, [1.0, 2.0]), (1, short)], "k int, v array<double>")
        with pytest.raises(PySparkException):
            collective.elementwise(uneven, ["k"], "v", "sum", width).collect()


@pytest.mark.parametrize("shares", [[1 / 3] * 3, [0.1] * 10, [0.7, 0.2, 0.1], [1.0], [math.pi / 4, 1 - math.pi / 4]])
def test_shares_lose_no_sample(spark, shares):
    for n in (1, 7, 300, 3000):
        placed = samples.partition_samples(spark.range(n), "id", shares)
        assert placed.count() == n
        assert placed.agg(F.max("rank")).first()[0] <= len(shares) - 1


def test_shares_must_sum_to_one(spark):
    for shares in ([0.5, 0.3], [0.9, 0.2], [1.2, -0.2]):
        with pytest.raises(ValueError):
            samples.partition_samples(spark.range(10), "id", shares)


def test_libsvm_takes_all_entries_or_fails(spark, tmp_path):
    good, bad, other = (tmp_path / name for name in ("good", "bad", "other"))
    good.write_text("# head\n\n1 1:1 2:2.5 3:9 # tail\n-1\n")
    bad.write_text("1 1:1 2:2 5:9\n")
    other.write_text("1 1:1\nspam 1:1\n")
    rows = tables.read_libsvm(spark, str(good), 3, dense=False).collect()
    assert [(r.label, [tuple(e) for e in r.entries]) for r in rows] == [(1.0, [(0, 1.0), (1, 2.5), (2, 9.0)]), (-1.0, [])]
    for path in (bad, other):
        with pytest.raises(PySparkException):
            tables.read_libsvm(spark, str(path), 2, dense=False).collect()


def test_restorable_status(spark):
    saved = spark.createDataFrame([("p", "d", 3, 0), ("p", "d", 2, 1), ("q", "d", 3, 0), ("r", "d", 1, 0), ("r", "e", 2, 0), ("t", "d", 1, 0)],
                                  "run_id string, directory string, epoch long, rank long")
    worlds = spark.createDataFrame([("p", 2), ("q", 2), ("r", 1), ("s", 1)], "run_id string, world_size int")
    got = {r.run_id: (r.epoch, r.status) for r in collective.restorable_status(saved, worlds).collect()}
    assert got == {"p": (2, "ok"), "q": (None, "missing"), "r": (None, "ambiguous"), "s": (None, "missing"), "t": (None, "unknown")}


def test_nan_is_never_best(spark):
    values = iter([math.nan, 2.0, 3.0, 1.0])
    df = vectors(spark, (0, [1.0], 1.0), (0, [2.0], 1.0))
    seen = []

    def metric(z, y):
        return F.lit(next(values))

    cfg = linear.Training(world_size=1, batch_size=2, epochs=4, rate=0.0, metrics={"m": metric})
    state, _ = linear.train(df.withColumn("sample_id", F.monotonically_increasing_id()), df, [0.0], cfg,
                            save=lambda s, best: seen.append(best))
    assert seen == [False, True, True, False] and (state.best, state.best_epoch) == (3.0, 2)
