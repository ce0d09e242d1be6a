"""Outputs of a trigger become visible together; listings and folded tables."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from runlens.operators.presence import inventory_after
from runlens.plans import tables as t
from runlens.plans.telemetry import payloads
from runlens.session import new_dir
from runlens.streaming import commits, jobs

ENTITY = "name string, phase string, ip string, node_name string"


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def held(spark, root, table="a"):
    return sorted(r.v for r in commits.read(spark, root, table, "v long").collect())


def folders(root, table):
    return [p for p in glob.glob(f"{root}/{table}/*") if os.path.isdir(p)]


def test_parts_and_snapshots(spark, tmp_path):
    root = str(tmp_path)
    assert held(spark, root) == [] and commits.last_trigger(spark, root) == -1
    assert commits.commit(spark, root, 0, {"a": numbers(spark, 1), "b": numbers(spark, 9)})
    assert commits.commit(spark, root, 1, {"a": numbers(spark, 2)})
    assert not commits.commit(spark, root, 1, {"a": numbers(spark, 2)})
    assert held(spark, root) == [1, 2] and held(spark, root, "b") == [9]
    commits.commit(spark, root, 2, {"b": numbers(spark, 8)}, {"a": numbers(spark, 3)})
    assert held(spark, root) == [3] and len(folders(root, "a")) == 3
    commits.commit(spark, root, 3, {"a": numbers(spark, 4)})
    commits.commit(spark, root, 4, snapshots={"a": numbers(spark, 7)})
    assert held(spark, root) == [7] and held(spark, root, "b") == [8, 9] and len(folders(root, "a")) == 3
    for n in range(5, 12):
        commits.commit(spark, root, n, snapshots={"a": numbers(spark, n)})
    assert held(spark, root) == [11] and held(spark, root, "b") == [8, 9] and len(folders(root, "a")) == 2


def test_half_written_trigger_is_not_seen(spark, sf, tmp_path, monkeypatch):
    """The second output fails after the first is written; the trigger runs again and counts once."""
    rows = payloads(spark, sf)
    landing, root, checkpoint = (new_dir(spark, n) for n in ("landing", "ingested", "checkpoint"))
    rows.write.parquet(landing)
    stream = spark.readStream.schema(rows.schema).parquet(landing)
    start = lambda: jobs.start_metric_ingest(stream, lambda: t.pods(spark, sf), lambda: t.runs(spark, sf), root, checkpoint)
    real = jobs.rejected_events
    monkeypatch.setattr(jobs, "rejected_events", lambda judged: real(judged).withColumn("x", F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    assert folders(root, "metrics") and commits.last_trigger(spark, root) == -1
    monkeypatch.setattr(jobs, "rejected_events", real)
    start().awaitTermination()
    accepted = commits.read(spark, root, "metrics", "metric_id long").count()
    rejected = commits.read(spark, root, "rejects", "metric_id long, status long")
    assert accepted + rejected.count() == rows.count() and accepted and rejected.filter("status = 201").isEmpty()


def brute(stored, listings):
    """The loop that a poller would run, one listing after the other."""
    held, changes = {r[0]: r for r in stored}, []
    for time, rows in sorted(listings.items()):
        seen = {r[0]: (r[0], r[1], r[2] or "", r[3]) for r in rows}
        changes += [(time, "delete", *r) for n, r in held.items() if n not in seen]
        held = {n: r for n, r in held.items() if n in seen}
        for name, row in seen.items():
            if name not in held:
                changes.append((time, "insert", *row))
                held[name] = row
            elif held[name][1] != row[1]:
                held[name] = (name, row[1], *held[name][2:])
                changes.append((time, "phase", *held[name]))
    return sorted(held.values(), key=str), sorted(changes, key=str)


def sequence(seed, times):
    import random
    draw = random.Random(seed)
    return {n: [(f"p{i}", draw.choice(["Running", "Failed", None]), draw.choice(["x", None]), f"node{n}") for i in range(6)
                if draw.random() < 0.6] if draw.random() < 0.8 else [] for n in times}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_listing_counts(spark, tmp_path, seed):
    stored, listings = [("p0", "Running", "", "old"), ("p9", None, "", "old")], sequence(seed, range(9))
    table = [(n, *r) for n, rows in listings.items() for r in [(None,) * 4, *rows]]
    observed = spark.createDataFrame(table, f"seen_at int, {ENTITY}")
    before = spark.createDataFrame(stored, ENTITY)
    after, changes = inventory_after(before, observed)
    want = brute(stored, listings)
    assert (sorted(map(tuple, after.collect()), key=str), sorted(map(tuple, changes.collect()), key=str)) == want
    if seed > 1:
        return
    # The same in three triggers, the last of which brings a late listing, too.
    root, landing = str(tmp_path / "root"), str(tmp_path / "in")
    for part in (observed.filter("seen_at < 2"), observed.filter("seen_at between 2 and 6"),
                 observed.filter("seen_at > 6").union(observed.filter("seen_at = 1"))):
        part.coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(part.schema).parquet(landing)
        jobs.start_presence(stream, before, root, str(tmp_path / "check")).awaitTermination()
    after = commits.read(spark, root, "inventory", ENTITY)
    changes = commits.read(spark, root, "changes", f"seen_at int, action string, {ENTITY}")
    assert (sorted(map(tuple, after.collect()), key=str), sorted(map(tuple, changes.collect()), key=str)) == want
    assert len(folders(root, "inventory")) == 2


def test_folded_updates_stay_few(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i % 3, i, (i * 7 % 11) / 11, day + datetime.timedelta(hours=i)) for i in range(36)]
    schema = "run_id long, epoch long, value double, ts timestamp"
    for n in range(12):
        spark.createDataFrame(rows[3 * n:3 * n + 3], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    root = f"{tmp_path}/root"
    jobs.start_best_compacted(stream, 0.9, root, f"{tmp_path}/check", every=3).awaitTermination()
    got = {r.run_id: (r.best, r.best_step) for r in jobs.current_best(spark, root).collect()}
    assert got == {k: max((v, -e) for i, e, v, _ in rows if i == k) and (max(v for i, _, v, _ in rows if i == k), min(
        e for i, e, v, _ in rows if i == k and v == max(x for j, _, x, _ in rows if j == k))) for k in range(3)}
    assert len(folders(root, "best")) <= 6 and len(folders(root, "_commits")) <= 6
