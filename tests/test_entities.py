"""Small cases of joins, ingest, inventory and series operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from runlens import schemas
from runlens.operators import entities, progress, series


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


@pytest.fixture(scope="module")
def pods(spark):
    return spark.createDataFrame([(1, "a", {"app": "x", "component": "worker"}, "Running", "ip1", "n1", 10),
                                  (2, "b", {"app": "x"}, "Pending", "ip2", "n1", 10),
                                  (3, "a", {}, "Failed", "ip3", "n2", None)], schemas.PODS)


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame([(10, "r", at(2), at(4), "finished", "j", None, "1000m", 2, 0),
                                  (11, "s", at(3), None, "started", "k", None, "1000m", 2, 0)], schemas.RUNS)


@pytest.fixture(scope="module")
def metrics(spark):
    return spark.createDataFrame(
        [(1, "cpu", at(1), "1", "", False, 1, None), (2, "cpu", at(2), "2", "", False, 1, None),
         (3, "cpu", at(4), "3", "", False, 2, None), (4, "cpu", at(5), "4", "", False, 1, None),
         (5, "loss", at(3), "0.5", "", False, None, 10), (6, "loss", at(9), "0.4", "", False, None, 11)], schemas.METRICS)


def ids(df, name="metric_id"):
    return sorted(r[name] for r in df.collect())


def test_run_window_is_closed_and_open_runs_have_no_end(pods, runs, metrics):
    assert ids(entities.run_pod_metrics(runs, pods, metrics)) == [2, 3]
    assert ids(entities.run_own_metrics(runs, metrics)) == [5, 6]
    history = pods.sparkSession.createDataFrame([(10, 1), (11, 1)], "run_id bigint, pod_id bigint")
    got = entities.run_pod_metrics(runs, pods, metrics, history)
    assert sorted((r["run_id"], r["metric_id"]) for r in got.collect()) == [(10, 2), (11, 4)]
    prefixes = entities.run_export_rows(runs, pods, metrics).select("prefix").distinct()
    assert {r[0] for r in prefixes.collect()} == {"result", "a", "b"}


def test_entities_without_samples_stay(pods, metrics):
    got = entities.attach_metrics(pods.select("pod_id", F.col("name").alias("pod")), metrics, "pod_id", ["metric_id"])
    assert sorted((r["pod_id"], r["metric_id"] or 0) for r in got.collect()) == [(1, 1), (1, 2), (1, 4), (2, 3), (3, 0)]


def test_first_by_name(pods, metrics):
    assert {(r["name"], r["pod_id"]) for r in series.first_by_name(pods).collect()} == {("a", 1), ("b", 2)}
    wanted = pods.filter("phase = 'Failed'")
    assert ids(series.select_metrics(metrics, wanted, "pod", pods)) == [1, 2, 4]
    with pytest.raises(ValueError):
        series.select_metrics(metrics, wanted, "node")


def test_ingest(spark, pods, runs):
    d = "2018-08-14T09:21:44.331823Z"
    events = spark.createDataFrame(
        [("a", "99", "cpu", d, "1", "False", "", 0, ""), ("zz", "10", "cpu", d, "1", "False", "", 0, ""),
         (None, "10", "cpu", d, "1", "True", None, 0, ""), (None, "99", "cpu", d, "1", "False", "", 0, ""),
         (None, "x", "cpu", d, "1", "False", "", 0, ""), (None, None, "cpu", d, "1", "False", "", 0, ""),
         ("a", None, "cpu", "soon", "1", "False", "", 0, "")], schemas.EVENTS)
    judged = entities.ingest_status(events, pods, runs)
    got = [(r["status"], r["message"], r["found_pod"], r["found_run"]) for r in judged.collect()]
    assert sorted(got, key=str) == sorted([
        (201, None, 1, None), (404, "Pod not found", None, None), (201, None, None, 10), (404, "Run not found", None, None),
        (404, "Run not found", None, None), (400, entities.NO_ENTITY, None, None), (400, entities.MALFORMED, 1, None)], key=str)
    stored = entities.accepted_metrics(judged).orderBy("pod_id").collect()
    assert [(r["pod_id"], r["run_id"], r["cumulative"], r["metadata"]) for r in stored] == [(None, 10, True, ""), (1, None, False, "")]
    assert entities.rejected_events(judged).count() == 5


def test_inventory(spark):
    stored = spark.createDataFrame([("a", "Running", "1", "n"), ("b", "Running", "2", "n")], "name string, phase string, ip string, node_name string")
    seen = spark.createDataFrame([("b", "Failed", "9", "n"), ("c", "Pending", None, "m")], stored.schema)
    after, changes = entities.reconcile_inventory(stored, seen)
    assert {tuple(r) for r in after.collect()} == {("b", "Running", "2", "n"), ("c", "Pending", "", "m")}
    assert {(r["name"], r["action"]) for r in changes.collect()} == {("a", "delete"), ("c", "insert")}
    phases = entities.refresh_phase(stored, seen)
    assert {(r["name"], r["phase"], r["changed"]) for r in phases.collect()} == {("a", "Running", False), ("b", "Failed", True)}
    assert [r["name"] for r in entities.removed(stored, seen).collect()] == ["a"]


def test_deletes(pods, runs, metrics):
    p, r, m = entities.delete_entities(pods, runs, metrics, pods.filter("pod_id = 1"), runs.filter("run_id = 10"))
    assert ids(p, "pod_id") == [2, 3] and all(x["run_id"] is None for x in p.collect())
    assert ids(r, "run_id") == [11] and ids(m) == [3, 6]


def test_latest_run_takes_the_pod(spark, pods):
    taken = spark.createDataFrame([(10, 1, at(1)), (11, 1, at(2)), (10, 2, at(1))], "run_id bigint, pod_id bigint, started timestamp")
    got = {r["pod_id"]: r["run_id"] for r in entities.assign_pods(pods, taken).collect()}
    assert got == {1: 11, 2: 10, 3: None}


def test_conflicts_with_open_run(runs):
    assert ids(entities.conflicting_runs(runs), "run_id") == [11]
    assert entities.active_runs(runs).first()["active"] == 1
    odd = runs.withColumn("state", F.when(F.col("run_id") == 10, "lost").otherwise(F.col("state")))
    assert ids(entities.unknown_states(odd), "run_id") == [10] and entities.unknown_states(runs).isEmpty()


def test_counter_reset_and_short_steps(spark):
    t = "timestamp'2024-01-01 00:00:00'"
    df = spark.sql(f"""select * from values (1L, 1L, 'n', {t}, '10', true), (2L, 1L, 'n', {t} + interval 2 seconds, '30', true),
      (3L, 1L, 'n', {t} + interval 4 seconds, '5', true), (4L, 1L, 'n', {t} + interval '4.0001' second, '6', true),
      (5L, 2L, 'c', {t}, '7', false), (6L, 2L, 'c', {t} + interval 1 second, '3', true)
      as t(metric_id, pod_id, name, date, value, cumulative)""")
    got = {r["metric_id"]: r["rate"] for r in series.counter_rate(df).collect()}
    assert got == {1: 0.0, 2: 10.0, 3: 0.0, 4: 1000.0, 5: 7.0, 6: 3.0}
    box = series.extents(series.counter_rate(df)).filter("name = 'c'").first()
    assert (box["y_min"], box["y_max"]) == (0.0, 7.0)


def test_shared_mark_judges_twins_together(spark):
    rows = [(1, "network_in", 1, 5), (2, "network_out", 1, 5), (3, "network_in", 2, 5), (4, "network_out", 2, 5),
            (5, "network_in", 3, 6), (6, "network_out", 3, 6), (7, "cpu", 1, 1), (8, "cpu", 2, 3), (9, "cpu", 3, 2)]
    df = spark.createDataFrame([(m, 1, n, a, at(d)) for m, n, a, d in rows], "metric_id bigint, pod_id bigint, name string, arrival bigint, date timestamp")
    assert ids(series.accept_newer(df, "arrival")) == [1, 2, 5, 6, 7, 8]


def test_padding_and_since(spark, metrics):
    own = metrics.filter("pod_id is not null")
    padded = series.pad_singletons(own)
    assert sorted(r["date"] for r in padded.filter("pod_id = 2").collect()) == [at(4) - dt.timedelta(seconds=1), at(4)]
    assert padded.filter("pod_id = 1").count() == 3
    paged = series.series_since(own, ["pod_id", "name"], F.lit(at(5)))
    assert {r["pod_id"]: len(r["samples"]) for r in paged.collect()} == {1: 1, 2: 0}


def test_best_ignores_nan_and_ties(spark):
    df = spark.createDataFrame([("r", 0, float("nan")), ("r", 1, 2.0), ("r", 2, 2.0), ("r", 3, 1.0), ("r", 4, 3.0)], "run_id string, epoch int, value double")
    got = [(r["epoch"], r["best"], r["best_step"], r["is_best"]) for r in progress.best_so_far(df, ["run_id"], "epoch", "value").orderBy("epoch").collect()]
    assert got == [(1, 2.0, 1, True), (2, 2.0, 1, False), (3, 2.0, 1, False), (4, 3.0, 4, True)]


def test_active_time_ignores_repeats(spark):
    kinds = ["resume", "pause", "pause", "resume", "resume", "pause"]
    rows = [("r", i, at(1) + dt.timedelta(seconds=s), k) for i, (s, k) in enumerate(zip([0, 10, 15, 20, 23, 30], kinds))]
    df = spark.createDataFrame(rows, "run_id string, event_id bigint, ts timestamp, kind string")
    got = [r["active"] for r in progress.active_time(df, ["run_id"], offset=F.lit(100.0)).orderBy("event_id").collect()]
    assert got == [100.0, 110.0, 110.0, 110.0, 110.0, 120.0]


def test_time_and_accuracy(spark):
    rec = spark.createDataFrame([("a", 0, 10.0, 50.0), ("a", 1, 20.0, 70.0), ("a", 2, 30.0, 65.0), ("b", 0, 5.0, 10.0)], "run_id string, epoch int, cumu_time double, value double")
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    tta = {r[0]: r[1] for r in progress.time_to_accuracy(rec, runs, 70.0).collect()}
    aat = {r[0]: r[1] for r in progress.accuracy_after_time(rec, runs, 30.0).collect()}
    assert tta == {"a": 20.0, "b": None, "c": None} and aat == {"a": 65.0, "b": 10.0, "c": None}
    over = progress.compare_over_time(rec, 5.0).orderBy("run_id", "tick").collect()
    assert [(r["tick"], r["value"]) for r in over if r["run_id"] == "a"] == [(2, 50.0), (3, 50.0), (4, 70.0), (5, 70.0), (6, 65.0)]


def test_scaling_and_cost(spark):
    runs = spark.createDataFrame([("t", 2, 1000.0, 10.0), ("t", 4, 1000.0, 8.0)], "task string, num_workers int, samples double, seconds double")
    got = {r["num_workers"]: (r["throughput"], r["ideal"], r["efficiency"]) for r in progress.scaling(runs).collect()}
    assert got == {2: (100.0, 100.0, 1.0), 4: (125.0, 200.0, 0.625)}
    price = {r["seconds"]: r["cost"] for r in progress.cost(spark.createDataFrame([(2, 86400.0), (2, 90000.0)], "num_workers int, seconds double")).collect()}
    assert price == {86400.0: pytest.approx(2 * 24 * 0.04), 90000.0: pytest.approx(2 * 25 * 0.19)}
