"""Appends to a sample table get ids and places without reading each other."""

import threading

import pytest

from runlens.sources import indexed


def samples(spark, low, high, parts=3):
    return spark.range(low, high, 1, parts).selectExpr("id", "id * 2.0 as label")


def test_ids_stay_and_places_are_dense(spark, tmp_path):
    path = str(tmp_path)
    indexed.append_samples(samples(spark, 0, 100), path, "d", "train", "first")
    before = {r.id: r.sample_id for r in indexed.read_indexed(spark, path, "d", "train").collect()}
    assert not indexed.append_samples(samples(spark, 0, 100), path, "d", "train", "first")
    indexed.append_samples(samples(spark, 100, 130, 7), path, "d", "train")
    indexed.append_samples(samples(spark, 0, 9), path, "d", "test")
    got = indexed.read_indexed(spark, path, "d", "train").collect()
    assert sorted(r.pos for r in got) == list(range(130)) and len({r.sample_id for r in got}) == 130
    assert all(r.pos == r.id for r in got) and all(before[r.id] == r.sample_id for r in got if r.id < 100)


def test_two_appends_at_once(spark, tmp_path):
    path, errors = str(tmp_path), []

    def add(low):
        try:
            indexed.append_samples(samples(spark, low, low + 50), path, "d", "train")
        except Exception as e:  # noqa: BLE001
            errors.append(e)
    threads = [threading.Thread(target=add, args=(1000 * n,)) for n in range(4)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    got = indexed.read_indexed(spark, path, "d", "train").collect()
    assert not errors and sorted(r.pos for r in got) == list(range(200)) and len({r.sample_id for r in got}) == 200
    assert len({r.number for r in indexed.index_of(spark, path, "d", "train").collect()}) == 4


def test_unfinished_append_is_not_seen_and_may_be_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    indexed.append_samples(samples(spark, 0, 10), path, "d", "train")
    real = indexed._number
    monkeypatch.setattr(indexed, "_number", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        indexed.append_samples(samples(spark, 10, 20), path, "d", "train", "second")
    assert indexed.read_indexed(spark, path, "d", "train").count() == 10
    monkeypatch.setattr(indexed, "_number", real)
    indexed.append_samples(samples(spark, 10, 20), path, "d", "train", "second")
    assert sorted(r.pos for r in indexed.read_indexed(spark, path, "d", "train").collect()) == list(range(20))
