"""Cutting long keys changes nothing: every ordered operator with tiny segments against whole windows."""

import pytest
from pyspark.sql import functions as F

from runlens.operators import collective, entities, progress, scan, series
from runlens.sources import export, logs


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, a third of them at one instant; one key is null."""
    return spark.range(1200).select(
        F.col("id").alias("metric_id"),
        F.when(F.col("id") < 900, 1).when(F.col("id") < 1000, 2).when(F.col("id") < 1100, None)
        .otherwise(F.col("id") % 7).cast("bigint").alias("pod_id"),
        F.when(F.col("id") % 2 == 0, "cpu").otherwise("network_in").alias("name"),
        F.timestamp_micros(F.lit(1700000000000000) + F.when(F.col("id") < 400, 5_000_000).otherwise(
            F.pmod(F.xxhash64("id"), F.lit(10_000_000)))).alias("date"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).cast("double").alias("value"),
        (F.col("id") % 2 == 1).alias("cumulative"),
        F.lit(None).cast("bigint").alias("run_id")).cache()


LIMITS = [25, 200]


@pytest.mark.parametrize("limit", LIMITS)
def test_segments_are_small_and_whole(skewed, limit):
    out = scan.ordered(skewed, ["pod_id"], ["date", "metric_id"], limit)
    assert out.split
    sizes = out.df.groupBy(*out.by).count().agg(F.max("count"), F.sum("count"), F.count("*")).first()
    assert sizes[0] <= limit and sizes[1] == 1200
    assert out.df.filter(scan.LONG).select(*out.by).distinct().count() <= out.segments


def test_exchange_join_beyond_the_replicated_size(skewed, monkeypatch):
    want = rows(series.counter_rate(skewed))
    monkeypatch.setattr(scan, "REPLICATED_ROWS", 0)
    assert rows(series.counter_rate(skewed, max_rows=20)) == want


@pytest.mark.parametrize("limit", LIMITS)
def test_counter_rate(skewed, limit):
    assert rows(series.counter_rate(skewed, max_rows=limit)) == rows(series.counter_rate(skewed))


@pytest.mark.parametrize("limit", LIMITS)
def test_accept_newer(skewed, limit):
    arrived = skewed.withColumn("arrival", F.pmod(F.xxhash64("metric_id", F.lit(2)), F.lit(300)))
    want = rows(series.accept_newer(arrived, "arrival"))
    assert 0 < len(want) < 1200
    assert rows(series.accept_newer(arrived, "arrival", max_rows=limit)) == want


@pytest.mark.parametrize("limit", LIMITS)
def test_ordinal(skewed, limit):
    args = (["pod_id"], ["date", "metric_id"], "pos")
    assert rows(scan.ordinal(skewed, *args, limit)) == rows(scan.ordinal(skewed, *args))


@pytest.mark.parametrize("limit", LIMITS)
def test_pages_in_order_are_the_series(skewed, limit):
    def flat(df):
        paged = df.select("pod_id", "name", "page", F.posexplode("samples").alias("i", "s"))
        return [tuple(r) for r in paged.orderBy("pod_id", "name", "page", "i").select("pod_id", "name", "s").collect()]
    whole = series.series(skewed, ["pod_id", "name"])
    cut = series.series(skewed, ["pod_id", "name"], page_rows=7, max_rows=limit)
    assert flat(cut) == flat(whole)
    assert cut.agg(F.max(F.size("samples"))).first()[0] <= 7
    assert cut.groupBy("pod_id", "name").agg((F.max("page") + 1 == F.count("*")).alias("ok")).filter("not ok").isEmpty()


@pytest.mark.parametrize("limit", LIMITS)
def test_best_and_average(skewed, limit):
    steps = skewed.filter("pod_id is not null").withColumn("n", F.col("metric_id") % 3 + 1)
    assert rows(progress.best_so_far(steps, ["pod_id"], "metric_id", "value", limit)) == \
        rows(progress.best_so_far(steps, ["pod_id"], "metric_id", "value"))
    # Whole numbers: sums do not depend on the order of addition.
    assert rows(progress.average_meter(steps, ["pod_id"], "metric_id", "value", "n", limit)) == \
        rows(progress.average_meter(steps, ["pod_id"], "metric_id", "value", "n"))


@pytest.mark.parametrize("limit", LIMITS)
def test_active_time(skewed, limit):
    events = skewed.withColumn("kind", F.when(F.xxhash64("metric_id", F.lit(3)) % 2 == 0, "pause").otherwise("resume"))
    args = dict(date="date", tie="metric_id")
    assert rows(progress.active_time(events, ["pod_id"], max_rows=limit, **args)) == \
        rows(progress.active_time(events, ["pod_id"], **args))


@pytest.mark.parametrize("limit", LIMITS)
def test_compare_over_time(skewed, limit):
    records = skewed.select(F.coalesce("pod_id", F.lit(0)).alias("run_id"), F.col("metric_id").alias("epoch"), "value",
                            (F.col("metric_id") * F.col("metric_id") / 100).alias("cumu_time"))
    assert rows(progress.compare_over_time(records, 3.0, max_rows=limit)) == \
        rows(progress.compare_over_time(records, 3.0))


@pytest.mark.parametrize("limit", LIMITS)
def test_conflicting_runs(skewed, limit):
    runs = skewed.select(F.col("metric_id").alias("run_id"), F.col("date").alias("created_at"), F.timestamp_micros(
        scan.micros("date") + F.pmod(F.xxhash64("metric_id", F.lit(4)), F.lit(20_000))).alias("finished_at"))
    want = rows(entities.conflicting_runs(runs))
    assert 0 < len(want) < 1200
    assert rows(entities.conflicting_runs(runs, limit)) == want
    pairs = runs.collect()
    brute = {a["run_id"] for a in pairs for b in pairs
             if (b["created_at"], b["run_id"]) < (a["created_at"], a["run_id"]) and b["finished_at"] > a["created_at"]}
    assert {r[2] for r in want} == brute


@pytest.mark.parametrize("limit", LIMITS)
def test_local_rank_and_gather(skewed, limit):
    ranks = skewed.select(F.coalesce("pod_id", F.lit(-1)).alias("host"), F.col("metric_id").alias("rank"), "value")
    assert rows(collective.local_rank(ranks, max_rows=limit)) == rows(collective.local_rank(ranks))
    pages = collective.gather(ranks, ["host"], "rank", "value", max_rows=limit, page_rows=9)
    whole = collective.gather(ranks, ["host"], "rank", "value")
    assert {r["host"]: r["all"] for r in pages.orderBy("host", "page").groupBy("host").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "samples"))), lambda e: e["samples"])).alias("all")).collect()} == \
        {r["host"]: r["samples"] for r in whole.collect()}


@pytest.mark.parametrize("limit", LIMITS)
def test_job_output(skewed, limit):
    jobs = skewed.select(F.coalesce("pod_id", F.lit(0)).alias("run_id"), F.col("metric_id").alias("chunk_no"),
                         F.array_join(F.transform(F.sequence(F.lit(0), F.col("metric_id") % 4), lambda i: i.cast("string")), "\n").alias("stdout"),
                         F.when(F.col("metric_id") % 5 == 0, "e").alias("stderr"))
    assert rows(logs.explode_job_output(jobs, limit)) == rows(logs.explode_job_output(jobs))


@pytest.mark.parametrize("limit", LIMITS)
def test_export_lines(skewed, limit):
    wide = skewed.withColumns({"run_id": F.lit(1), "run_name": F.lit("a b"), "prefix": F.coalesce(F.col("pod_id").cast("string"), F.lit("x"))})
    assert rows(export.export_lines(wide, limit)) == rows(export.export_lines(wide))
