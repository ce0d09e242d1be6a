"""Streams fed in several parts give what the batch operators give on everything."""

import json

import pytest
from pyspark.sql import functions as F

from runlens.operators import series
from runlens.plans import tables as t
from runlens.session import new_dir
from runlens.sources.tables import read_metric_events
from runlens.streaming import jobs


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def feed(spark, parts, start):
    landing, checkpoint = new_dir(spark, "landing"), new_dir(spark, "checkpoint")
    for part in parts:
        part.write.mode("append").parquet(landing)
        start(spark.readStream.schema(part.schema).parquet(landing), checkpoint).awaitTermination()


def by_day(df, *cuts):
    cuts = ["2024-01-01", *cuts, "2025-01-01"]
    return [df.filter(F.col("date").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))) for a, b in zip(cuts, cuts[1:])]


def test_accept_newer_in_four_parts(spark, sf):
    data = t.arrivals(spark, sf).select("metric_id", "pod_id", "name", "date", "arrival")
    out, state = new_dir(spark, "out"), new_dir(spark, "state")
    feed(spark, by_day(data, "2024-01-05", "2024-01-06", "2024-01-20"), lambda s, c: jobs.start_accept_newer(s, "arrival", out, state, c))
    assert rows(spark.read.parquet(out).drop("batch_id")) == rows(series.accept_newer(data, "arrival"))


def test_late_part_is_dropped(spark, sf):
    data = t.arrivals(spark, sf).select("metric_id", "pod_id", "name", "date", "arrival").filter("name = 'cpu'")
    early, late = by_day(data, "2024-01-15")
    out, state = new_dir(spark, "out"), new_dir(spark, "state")
    feed(spark, [late, early], lambda s, c: jobs.start_accept_newer(s, "arrival", out, state, c))
    kept = spark.read.parquet(out)
    known = late.select("pod_id").distinct()
    assert kept.filter("batch_id = 1").join(known, "pod_id", "left_semi").isEmpty()


def test_rates_in_three_parts(spark, sf):
    data = t.pod_metrics(spark, sf).select("metric_id", "pod_id", "name", "date", "value", "cumulative")
    out, state = new_dir(spark, "out"), new_dir(spark, "state")
    feed(spark, by_day(data, "2024-01-03", "2024-01-21"), lambda s, c: jobs.start_counter_rate(s, out, state, c))
    assert rows(spark.read.parquet(out).drop("batch_id")) == rows(series.counter_rate(data))


def test_repeated_trigger_replaces_its_output(spark, sf):
    """A trigger that fails after writing runs again and leaves one copy."""
    data = t.arrivals(spark, sf).select("metric_id", "pod_id", "name", "date", "arrival")
    out, state = new_dir(spark, "out"), new_dir(spark, "state")
    landing, checkpoint = new_dir(spark, "landing"), new_dir(spark, "checkpoint")
    data.write.parquet(landing)
    real = jobs._folder
    jobs._folder = lambda path, b: "/proc/none" if path == state else real(path, b)
    try:
        with pytest.raises(Exception):
            jobs.start_accept_newer(spark.readStream.schema(data.schema).parquet(landing), "arrival", out, state, checkpoint).awaitTermination()
    finally:
        jobs._folder = real
    assert spark.read.parquet(out).count() > 0
    jobs.start_accept_newer(spark.readStream.schema(data.schema).parquet(landing), "arrival", out, state, checkpoint).awaitTermination()
    assert rows(spark.read.parquet(out).drop("batch_id")) == rows(series.accept_newer(data, "arrival"))


def test_json_ingest(spark, sf, tmp_path):
    events = [{"pod_name": "Supplier#000000001", "name": "cpu", "date": "2024-01-01T00:00:00Z", "value": "1", "cumulative": "False", "metadata": ""},
              {"run_id": "1", "name": "loss", "date": "2024-01-01T00:00:00.5Z", "value": "2", "cumulative": "False", "metadata": ""},
              {"name": "loss", "date": "2024-01-01T00:00:00Z", "value": "2"}]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, events)))
    out, checkpoint = new_dir(spark, "out"), new_dir(spark, "checkpoint")
    stream = read_metric_events(spark, str(tmp_path), streaming=True)
    jobs.start_ingest(stream, lambda: t.pods(spark, sf), lambda: t.runs(spark, sf), out, checkpoint).awaitTermination()
    got = jobs.ingested(spark, out)
    assert sorted(r["status"] for r in got.collect()) == [201, 201, 400]
    assert got.filter("accepted").count() == 2


def test_nothing_new(spark, sf):
    data = t.pod_metrics(spark, sf)
    landing, out, checkpoint = (new_dir(spark, n) for n in ("landing", "out", "checkpoint"))
    data.write.parquet(landing)
    stream = spark.readStream.schema(data.schema).parquet(landing)
    assert jobs.read_since(stream, out, checkpoint).count() == data.count()
    assert jobs.read_since(stream, out, checkpoint).isEmpty()


def test_latest_listing_of_a_trigger_counts(spark, tmp_path):
    from runlens.streaming.jobs import start_inventory

    rows = [("a", "Running", 1), ("b", "Running", 1), ("a", "Failed", 2)]
    df = spark.createDataFrame([(n, p, "ip", "node", s) for n, p, s in rows],
                               "name string, phase string, ip string, node_name string, seen_at long")
    df.write.parquet(f"{tmp_path}/in")
    initial = df.drop("seen_at").limit(0)
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    start_inventory(stream, initial, f"{tmp_path}/table", f"{tmp_path}/changes", f"{tmp_path}/check").awaitTermination()
    stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/table").collect()
    assert [(r["name"], r["phase"]) for r in stored] == [("a", "Failed")]


def test_rates_of_equal_dates_across_triggers(spark, tmp_path):
    import datetime

    from runlens.streaming.jobs import start_counter_rate

    day = datetime.datetime(2024, 1, 1)
    rows = [(1, 0, 1.0), (2, 0, 2.0), (3, 0, 4.0), (4, 1, 9.0), (0, 0, 7.0)]
    schema = "metric_id long, pod_id long, name string, date timestamp, value double, cumulative boolean"
    for n, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame([(i, 1, "c", day + datetime.timedelta(seconds=s), v, True) for i, s, v in part], schema) \
            .coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1) \
        .parquet(f"{tmp_path}/in/")
    query = start_counter_rate(stream, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/check",
                               trigger={"availableNow": True}, rejects=f"{tmp_path}/late")
    query.awaitTermination()
    read = lambda p: spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{p}").collect()
    assert {r["metric_id"] for r in read("out")} | {r["metric_id"] for r in read("late")} == {0, 1, 2, 3, 4}
    assert not {r["metric_id"] for r in read("out")} & {r["metric_id"] for r in read("late")}
    assert 3 in {r["metric_id"] for r in read("out")} or {1, 2} <= {r["metric_id"] for r in read("late")}
