"""Partitions, batches and feature layouts."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.operators import samples


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 300), world=st.integers(1, 17), shuffle=st.booleans())
def test_partitions_are_disjoint_and_cover(spark, n, world, shuffle):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = samples.partition_samples(df, "k", world, shuffle=shuffle, max_rows=50).collect()
    assert sorted(r["k"] for r in got) == list(range(n))
    assert sorted(r["pos"] for r in got) == list(range(n))
    for r in got:
        assert r["rank"] == next(i for i in range(world) if r["pos"] < (i + 1) * n // world)
        assert r["pos_in_rank"] == r["pos"] - r["rank"] * n // world
    if not shuffle:
        assert all(r["k"] == r["pos"] for r in got)


@pytest.mark.parametrize("n, shares", [(10, [0.7, 0.2, 0.1]), (500, 7), (500, 6)])
def test_float_bounds(spark, n, shares):
    df = spark.range(n)
    ends = [int(c * n) for c in np.cumsum([1.0 / shares] * shares if isinstance(shares, int) else shares)]
    got = samples.partition_samples(df, "id", shares, compat=True).groupBy("rank").count().collect()
    assert {r["rank"]: r["count"] for r in got} == {i: b - a for i, (a, b) in enumerate(zip([0] + ends, ends)) if b > a}


def test_exact_shares(spark):
    got = samples.partition_samples(spark.range(10), "id", [0.7, 0.2, 0.1]).groupBy("rank").count().collect()
    assert {r["rank"]: r["count"] for r in got} == {0: 7, 1: 2, 2: 1}


def test_epochs_permute_anew_and_repeat(spark):
    def order(epoch):
        return [r["id"] for r in samples.partition_samples(spark.range(50), "id", 2, epoch=epoch).orderBy("pos").collect()]
    assert order(0) == order(0) != order(1)


def test_reshuffle_keeps_the_partition(spark):
    placed = samples.partition_samples(spark.range(90), "id", 4)
    moved = samples.reshuffled(placed, "id", 42, 1)
    a = {(r["id"], r["rank"]) for r in placed.collect()}
    b = {(r["id"], r["rank"]) for r in moved.collect()}
    assert a == b
    sizes = moved.groupBy("rank").agg(F.sort_array(F.collect_list("pos_in_rank")).alias("p")).collect()
    assert all(r["p"] == list(range(len(r["p"]))) for r in sizes)


def test_last_batch_is_short(spark):
    placed = samples.batches(samples.partition_samples(spark.range(50), "id", 1), 20)
    assert {r["batch_idx"]: r["count"] for r in placed.groupBy("batch_idx").count().collect()} == {0: 20, 1: 20, 2: 10}
    assert samples.limit_batches(placed, 1).count() == 20 and samples.limit_batches(placed).count() == 50


def test_labels(spark):
    signed = spark.createDataFrame([(-1.0,), (1.0,)], "label double")
    plain = spark.createDataFrame([(0.0,), (2.0,)], "label double")
    assert sorted(r[0] for r in samples.correct_binary_labels(signed).collect()) == [0.0, 1.0]
    assert sorted(r[0] for r in samples.correct_binary_labels(signed, False).collect()) == [-1.0, 1.0]
    assert sorted(r[0] for r in samples.correct_binary_labels(plain).collect()) == [0.0, 2.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([0.0, 1.5, -2.0]), min_size=5, max_size=5), min_size=1, max_size=6))
def test_layouts_round_trip(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "sample_id bigint, features array<double>")
    back = samples.to_dense(samples.to_sparse(df), 5)
    assert [r["features"] for r in back.orderBy("sample_id").collect()] == rows
    triplets = samples.to_triplets(df)
    assert triplets.count() == sum(v != 0 for r in rows for v in r)
    again = samples.to_dense(samples.gather_entries(triplets), 5).collect()
    assert all(r["features"] == rows[r["sample_id"]] for r in again)


def test_standardize_wide_equals_narrow(spark):
    n = 70
    df = spark.range(3).select(F.array(*[F.col("id") + float(i) for i in range(n)]).alias("features"))
    mean, std = [float(i) for i in range(n)], [2.0] * n
    wide = [r[0] for r in samples.standardize(df, mean, std).collect()]
    assert wide == [[k / 2] * n for k in range(3)]


def test_precision(spark):
    df = spark.createDataFrame([([0.1], 1.0)], "features array<double>, label double")
    out = samples.cast_features(df, "fp32", True)
    assert out.schema.simpleString() == "struct<features:array<float>,label:float>"
    assert samples.cast_features(df, "fp64").schema["label"].dataType.simpleString() == "double"
    with pytest.raises(ValueError):
        samples.cast_features(df, "fp16")


def test_stride(spark):
    assert sorted(r["id"] for r in samples.stride(spark.range(10), "id", 1, 4).collect()) == [1, 5, 9]


def test_registry(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 2.0]), ("b", [1.0])], "name string, features array<double>")
    reg = spark.createDataFrame([("a", 2, 2, False), ("c", 1, 1, False)], "name string, n_samples bigint, n_features bigint, sparse boolean")
    assert {r["name"]: r["verdict"] for r in samples.check_registry(df, reg).collect()} == {"a": "ok", "b": "not found"}
    assert samples.dataset_registry(spark).count() == 6


def test_synthetic(spark):
    ids = spark.range(400)
    a = samples.synthetic_classification(ids, "id", 20, 15, 42)
    stats = a.select(F.explode("features").alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(stats[0]) < 0.05 and abs(stats[1] - 1) < 0.05
    assert 120 < a.agg(F.sum("label")).first()[0] < 280
    b = samples.synthetic_classification(ids.repartition(7), "id", 20, 15, 42)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
