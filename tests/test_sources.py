"""Files written and read back."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from runlens import schemas
from runlens.operators import collective
from runlens.sources import checkpoints, export, logs, tables


def test_libsvm(spark, tmp_path):
    path = str(tmp_path / "d.bz2")
    with bz2.open(path, "wt") as f:
        f.write("-1 1:0.5 3:2.0\n+1 2:1e-3\n1 \n")
    dense = tables.read_libsvm(spark, path, 3).collect()
    assert sorted((r["label"], r["features"]) for r in dense) == [(-1.0, [0.5, 0.0, 2.0]), (1.0, [0.0, 0.0, 0.0]), (1.0, [0.0, 0.001, 0.0])]
    sparse = tables.read_libsvm(spark, path, 3, dense=False).filter("label = -1").first()
    assert [tuple(e) for e in sparse["entries"]] == [(0, 0.5), (2, 2.0)]


def test_prepare_libsvm(spark, tmp_path):
    (tmp_path / "in").write_text("-1 1:0.5\n1 2:1\n")
    for sparse in (False, True):
        target = str(tmp_path / f"out{sparse}")
        tables.prepare_libsvm(spark, str(tmp_path / "in"), target, "toy", "train", 2, sparse)
        got = tables.read_samples(spark, target, "toy", "train")
        assert sorted(r["label"] for r in got.collect()) == [0.0, 1.0]
        assert got.select("sample_id").distinct().count() == 2
        if sparse:
            got = tables.dense_samples(got, 2)
        assert sorted(r["features"] for r in got.collect()) == [[0.0, 1.0], [0.5, 0.0]]
        assert tables.read_samples(spark, target, "toy", "val").isEmpty()


def test_entity_tables(spark, tmp_path):
    runs = spark.createDataFrame([], schemas.RUNS)
    runs.write.parquet(str(tmp_path / "runs"))
    assert tables.read_runs(spark, str(tmp_path / "runs")).columns == runs.columns
    pods = spark.createDataFrame([(1, "p", {"a": "b"}, "Running", "", "n", None)], schemas.PODS)
    pods.write.parquet(str(tmp_path / "pods"))
    assert tables.read_pods(spark, str(tmp_path / "pods")).first()["labels"] == {"a": "b"}
    tables.register(all_pods=pods)
    assert spark.sql("select count(*) from all_pods").first()[0] == 1
    metrics = spark.sql("select 1L metric_id, 'cpu' name, timestamp'2024-01-02 03:04:05' date, '1.5' value, '' metadata, "
                        "false cumulative, 1L pod_id, cast(null as bigint) run_id")
    tables.write_metrics(metrics, str(tmp_path / "metrics"))
    assert tables.read_metrics(spark, str(tmp_path / "metrics")).first()["value"] == "1.5"


def test_metric_folders_are_pruned(spark, tmp_path, capsys):
    spark.range(1000).select(
        F.col("id").alias("metric_id"), F.when(F.col("id") % 2 == 0, "cpu").otherwise("memory").alias("name"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("date"), F.lit("1").alias("value"), F.lit("").alias("metadata"),
        F.lit(False).alias("cumulative"), F.lit(1).cast("bigint").alias("pod_id"), F.lit(None).cast("bigint").alias("run_id")
    ).transform(lambda d: tables.write_metrics(d, str(tmp_path)) or d)
    got = tables.read_metrics(spark, str(tmp_path), F.lit("2024-02-01").cast("timestamp")).filter("name = 'cpu'")
    got.explain()
    plan = capsys.readouterr().out
    filters = plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert "day" in filters and "name" in filters
    assert got.count() == 128


def test_events_keep_malformed_lines(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"pod_name": "p", "name": "cpu", "cumulative": "False", "rank": 1}\nnot json\n')
    got = tables.read_metric_events(spark, str(tmp_path)).cache()
    assert [r["_corrupt_record"] for r in got.filter("_corrupt_record is not null").collect()] == ["not json"]
    assert got.filter("pod_name = 'p'").count() == 1


def test_snapshot_units(spark, tmp_path):
    doc = {"pods": [{"podRef": {"name": "p"}, "network": {"time": "2024-01-01T00:00:01Z", "rxBytes": 1048576, "txBytes": 524288},
                     "containers": [{"cpu": {"time": "2024-01-01T00:00:02Z", "usageNanoCores": 1500000000},
                                     "memory": {"time": "2024-01-01T00:00:03Z", "usageBytes": 2097152}},
                                    {"cpu": {"time": "2024-01-01T00:00:02Z", "usageNanoCores": 9}}]}]}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    got = {r["name"]: (r["pod_name"], r["value"], r["cumulative"], r["date"].second) for r in tables.read_snapshots(spark, str(tmp_path)).collect()}
    assert got == {"cpu": ("p", 1.5, False, 2), "memory": ("p", 2.0, False, 3), "network_in": ("p", 1.0, True, 1), "network_out": ("p", 0.5, True, 1)}


LOG = """2018-09-24 10:00:00 trainer 0 INFO: Current epoch : 0 : lr=[0.1] : time= 0.000e+00
2018-09-24 10:00:00 trainer 0 DEBUG: Train Batch     0: loss=0.693
2018-09-24 10:00:05 trainer 0 DEBUG: Train Batch    12: loss=0.500
garbage
2018-09-24 10:00:06 trainer 0 INFO: best_Prec@1 for rank 0:(best epoch 0, current epoch 0): 71.250
2018-09-24 10:00:07 trainer 0 INFO: Current epoch : 1 : lr=[0.01] : time= 1.250e+01
2018-09-24 10:00:07 trainer 0 DEBUG: Validation loss=0.400
2018-09-24 10:00:08 trainer 0 INFO: hello
"""


def test_worker_logs(spark, tmp_path):
    (tmp_path / "w0").mkdir()
    (tmp_path / "w0" / "log").write_text(LOG)
    (tmp_path / "w1").mkdir()
    (tmp_path / "w1" / "log").write_text("2018-09-24 10:00:01 trainer 1 DEBUG: Train Batch     3: loss=nan\n")
    got = logs.parse_worker_logs(logs.read_worker_logs(spark, str(tmp_path)))
    rows = [(r["kind"], r["epoch"], r["batch"], r["value"], r["best_epoch"]) for r in got.filter("rank = 0").orderBy("ts", "kind").collect()]
    assert sorted(rows, key=str) == sorted([
        ("epoch", 0, None, 0.0, None), ("train", 0, 0, 0.693, None), ("train", 0, 12, 0.5, None), ("best", 0, None, 71.25, 0),
        ("epoch", 1, None, 12.5, None), ("validation", 1, None, 0.4, None), ("other", 1, None, None, None)], key=str)
    other = got.filter("rank = 1").first()
    assert other["epoch"] is None and other["batch"] == 3 and other["value"] != other["value"]


def test_log_lines_split_over_blocks_keep_their_order(spark, tmp_path):
    n = 4000
    lines = []
    for i in range(n):
        lines.append(f"2018-09-24 10:00:00 trainer 0 INFO: Current epoch : {i} : lr=[0.1] : time= 0.000e+00\n")
        lines.append("2018-09-24 10:00:00 trainer 0 DEBUG: Train Batch     0: loss=0.693\n")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "log").write_text("".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        read = logs.read_worker_logs(spark, str(tmp_path))
        assert read.select("block").distinct().count() > 5
        got = logs.parse_worker_logs(read).filter("kind = 'train'")
        assert got.select("epoch").distinct().count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_job_output_splits_like_splitlines(spark):
    chunks = ["a\nb\n", "", "c\r\nd", "\n\n", "e\x0bf g\n\n", "h i"]
    jobs = spark.createDataFrame([(1, i, c, None) for i, c in enumerate(chunks)], "run_id bigint, chunk_no int, stdout string, stderr string")
    got = [r["line"] for r in logs.explode_job_output(jobs).orderBy("line_no").collect()]
    assert got == [line for c in chunks for line in c.splitlines()]
    assert [r["line_no"] for r in logs.explode_job_output(jobs).orderBy("line_no").collect()] == list(range(len(got)))


def test_checkpoint_files(spark, tmp_path):
    run = tmp_path / "7_set_net_sgd"
    run.mkdir()
    for name in ["9_0", "10_0", "9_1", "10_1", "11_1"]:
        (run / f"{name}.pth.tar").write_bytes(b"x")
    (run / "model_best.pth.tar").write_bytes(b"x")
    for d in ("8_a_b_c", "8_a_b_d"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "1_0.pth.tar").write_bytes(b"x")
    listed = checkpoints.list_checkpoints(spark, str(tmp_path))
    assert listed.filter("is_best").count() == 1
    assert {(r["run_id"], r["optimizer"]) for r in listed.collect()} == {("7", "sgd"), ("8", "c"), ("8", "d")}
    got = collective.restorable_epoch(listed, directory="directory").collect()
    assert [(r["run_id"], r["epoch"]) for r in got] == [("7", 10)]


def test_export_is_json_per_series(spark, tmp_path):
    rows = spark.range(500).select(
        F.when(F.col("id") < 400, 1).otherwise(2).alias("run_id"),
        F.when(F.col("id") < 400, "my r\xfcn").otherwise("other").alias("run_name"), F.lit("result").alias("prefix"),
        F.when(F.col("id") % 5 == 0, "cpu").otherwise("loss").alias("name"),
        F.timestamp_micros(F.lit(1700000000000000) - F.col("id") * 1000).alias("date"), F.col("id").cast("string").alias("value"),
        F.lit(False).alias("cumulative"), F.col("id").alias("metric_id"))
    out = str(tmp_path / "out")
    export.export_run(rows, out, compression="none", max_rows=60)
    for archive, kept in (("run_id=1/archive=metrics_my_run", range(400)), ("run_id=2/archive=metrics_other", range(400, 500))):
        for name in ("cpu", "loss"):
            folder = tmp_path / "out" / archive / f"file=result_{name}.json"
            text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
            samples = json.loads(text)
            want = [i for i in reversed(kept) if (i % 5 == 0) == (name == "cpu")]
            assert [int(s["value"]) for s in samples] == want
            assert samples[0]["date"].endswith("Z") and samples[0]["cumulative"] is False


def test_job_output_of_one_run_is_spread(spark):
    """All chunks of one run, some with the same number: the texts do not meet in one task, and no place is given twice."""
    jobs = spark.range(400).select(
        F.lit("a").alias("run_id"), F.when(F.col("id") % 50 > 0, F.col("id") - F.col("id") % 3).alias("chunk_no"),
        F.format_string("x\ny %d\n", "id").alias("stdout"), F.when(F.col("id") % 2 == 0, "err").alias("stderr"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = logs.explode_job_output(jobs).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert len({r["task"] for r in out}) > 1
    assert sorted(r["line_no"] for r in out if r["stream"] == "stdout") == list(range(800))
    assert sorted(r["line_no"] for r in out if r["stream"] == "stderr") == list(range(200))
    lines = [r["line"] for r in sorted(out, key=lambda r: (r["stream"], r["line_no"])) if r["stream"] == "stdout"]
    assert lines[::2] == ["x"] * 400 and {lines[1], lines[3]} <= {f"y {i}" for i in range(0, 400, 50)}


def test_shared_dir_needs_a_setting_on_clusters(spark, monkeypatch):
    from runlens import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()
    with pytest.raises(ValueError):
        session.shared_dir(Cluster())


def test_packed_export(spark, tmp_path):
    """Many short series and a long one: files follow the size, and each document is read from its own files."""
    import datetime
    import glob
    import json

    from runlens.sources import export

    day = datetime.datetime(2024, 1, 1)
    rows = [(1, "a b", "x", f"m{i}", day + datetime.timedelta(seconds=j), float(j), False, 100 * i + j) for i in range(40) for j in range(3)]
    rows += [(2, "c", "result", "loss", day + datetime.timedelta(seconds=j), float(j), False, j) for j in range(900)]
    table = spark.createDataFrame(rows, "run_id long, run_name string, prefix string, name string, date timestamp, value double, "
                                        "cumulative boolean, metric_id long")
    export.export_packed(table, str(tmp_path / "out"), file_lines=200)
    assert 4 <= len(glob.glob(f"{tmp_path}/out/lines/*.parquet")) <= 8
    found = {(r.run_id, r.file): (r.parts, r.lines) for r in export.packed_documents(spark, str(tmp_path / "out")).collect()}
    assert len(found) == 41 and found[2, "result_loss.json"][0] > 2 and found[2, "result_loss.json"][1] == 900
    assert all(n == 3 for (run, _), (_, n) in found.items() if run == 1)
    for run, archive, file, n in ((2, "metrics_c", "result_loss.json", 900), (1, "metrics_a_b", "x_m7.json", 3)):
        document = json.loads("".join(r.line for r in export.packed_lines(spark, str(tmp_path / "out"), run, archive, file).collect()))
        assert [float(d["value"]) for d in document] == [float(j) for j in range(n)]
    assert export.packed_lines(spark, str(tmp_path / "out"), 9, "no", "file").collect() == []


def awkward_lines(spark):
    """Lines of documents whose names hold every ASCII character, some empty or null."""
    names = [chr(c) + "x" for c in range(1, 128)] + ["é ü.json", "", None, "a" * 100]
    return spark.createDataFrame([(i % 3 or None, "archive", n, p, f"line {i} {p}") for i, n in enumerate(names) for p in range(4)],
                                 "run_id long, archive string, file string, pos long, line string")


@pytest.mark.parametrize("compression", ["none", "gzip", "bzip2"])
def test_parts_of_an_export_lie_where_sparks_writer_puts_them(spark, tmp_path, compression):
    place = ["run_id", "archive", "file"]
    lines = awkward_lines(spark).repartitionByRange(5, *place, "pos").sortWithinPartitions(*place, "pos").select(*place, "line")
    lines.write.option("compression", compression).partitionBy(*place).text(str(tmp_path / "spark"))
    export.write_parts(lines, place, str(tmp_path / "own"), compression)

    def folders(name):
        return {p.relative_to(tmp_path / name).parent for p in (tmp_path / name).rglob("part-*")}
    assert folders("own") == folders("spark") and (tmp_path / "own" / "_SUCCESS").exists()
    assert not [p for p in (tmp_path / "own").rglob(".*")]
    schema = "value string, run_id bigint, archive string, file string"
    got, want = (sorted(map(str, spark.read.schema(schema).text(str(tmp_path / name)).collect())) for name in ("own", "spark"))
    assert got == want and len(got) == 4 * 131


def test_small_export_is_written_by_many_tasks(spark, tmp_path):
    """What an export costs is its number of files, not its bytes: one task must not write them all."""
    rows = spark.range(600).select(
        (F.col("id") % 60).alias("run_id"), F.lit("r").alias("run_name"), F.lit("result").alias("prefix"), F.lit("cpu").alias("name"),
        F.timestamp_micros(F.col("id")).alias("date"), F.lit("1").alias("value"), F.lit(False).alias("cumulative"),
        F.col("id").alias("metric_id"))
    out = str(tmp_path / "out")
    export.export_run(rows, out)
    parts = {p.name.split("-")[1].split(".")[0] for p in (tmp_path / "out").rglob("part-*")}
    assert len(parts) > 2
    with pytest.raises(Exception, match="out"):
        export.export_run(rows, out)


def test_names_of_an_export_come_from_its_paths(spark, tmp_path):
    """As from partition columns, whose discovery takes time with the square of the number of folders."""
    place = ["run_id", "archive", "file"]
    lines = awkward_lines(spark).withColumn("archive", F.when(F.col("pos") > 0, F.concat(F.lit("2024-01-01+%41/"), "pos")))
    lines.select(*place, "line").write.partitionBy(*place).text(str(tmp_path / "run_id=7"))
    got = export.exported_lines(spark, str(tmp_path / "run_id=7"))
    assert "PartitionFilters: [], " in got._jdf.queryExecution().executedPlan().toString()
    want = [(r.line, None if r.run_id is None else str(r.run_id), r.archive, r.file or None) for r in lines.collect()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_empty_export(spark, tmp_path):
    from runlens.plans.files import exported
    rows = awkward_lines(spark).limit(0).select(
        "run_id", F.lit("r").alias("run_name"), F.lit("p").alias("prefix"), F.lit("cpu").alias("name"),
        F.timestamp_micros("pos").alias("date"), F.col("line").alias("value"), F.lit(False).alias("cumulative"),
        F.col("pos").alias("metric_id"))
    assert exported(spark, rows, str(tmp_path / "out")).collect() == []
