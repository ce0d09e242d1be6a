"""Queries that write files to the shared folder and read them back."""

from pyspark.sql import functions as F

from runlens.functions import scalars
from runlens.operators import entities, linear
from runlens.operators.resume import resume as resume_state
from runlens.operators.resume import store
from runlens.plans import tables as t
from runlens.plans.linear import START, _training_sql, outcome, settings
from runlens.plans.registry import query
from runlens.plans.tables import JOBS, METRICS, ORDER_SAMPLES, PODS, RIDGE, RUNS, with_tables
from runlens.plans.telemetry import JUDGED, PAYLOADS, RUN_METRICS, SINCE, payloads
from runlens.session import new_dir
from runlens.sources import export, logs
from runlens.sources import tables as io


@query(with_tables(RIDGE) + "select y as label, x0, x1, x2 from ridge")
def libsvm_roundtrip(spark, sf):
    path = new_dir(spark, "libsvm")
    io.libsvm_lines(t.ridge_samples(spark, sf)).write.option("compression", "bzip2").text(path)
    out = io.read_libsvm(spark, path, 3)
    return out.select("label", *[F.col("features")[i].alias(f"x{i}") for i in range(3)])


@query("""select label::double as label, count(*) as stored, sum(i) as positions, round(sum(v), 6) as total from (
 select vec_id, label, unnest(embedding)::double as v, unnest(range(len(embedding))) as i from embeddings)
 where v <> 0 group by vec_id, label""")
def libsvm_sparse(spark, sf):
    path = new_dir(spark, "libsvm")
    vectors = t.table(spark, sf, "embeddings").select(
        "label", F.col("embedding").cast("array<double>").alias("features"))
    io.libsvm_lines(vectors).write.text(path)
    out = io.read_libsvm(spark, path, 64, dense=False)
    return out.select(
        "label", F.size("entries").cast("bigint").alias("stored"),
        F.aggregate("entries", F.lit(0).cast("bigint"), lambda a, e: a + e["idx"]).alias("positions"),
        F.round(F.aggregate("entries", F.lit(0.0), lambda a, e: a + e["val"]), 6).alias("total"))


@query(with_tables(ORDER_SAMPLES) + """select sample_id, case when class < '4' then 'train' else 'val' end as split, x1, y as label
 from order_samples""")
def samples_roundtrip(spark, sf):
    path = new_dir(spark, "samples")
    data = t.order_samples(spark, sf)
    io.write_samples(data.filter(F.col("class") < "4").drop("class"), path, "orders", "train")
    io.write_samples(data.filter(F.col("class") >= "4").drop("class"), path, "orders", "val")
    both = io.read_samples(spark, path, "orders", "train").unionByName(io.read_samples(spark, path, "orders", "val"))
    return both.select("sample_id", "split", F.col("features")[1].alias("x1"), "label")


def snapshot_documents(spark, sf):
    """One resource snapshot per event, for the pod of its user."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.table(spark, sf, "events").select(F.array(F.struct(
        F.struct(F.format_string("pod-%d", "user_id").alias("name")).alias("podRef"),
        F.array(F.struct(
            F.struct(stamp.alias("time"), F.floor(F.col("value") * 1e9).alias("usageNanoCores")).alias("cpu"),
            F.struct(stamp.alias("time"), (F.col("event_id") * 1000).alias("usageBytes")).alias("memory"))).alias("containers"),
        F.struct(stamp.alias("time"), (F.col("user_id") * 4096).alias("rxBytes"),
                 (F.col("event_id") * 512).alias("txBytes")).alias("network"))).alias("pods"))


@query("""with s as (select 'pod-' || user_id as pod_name, date_trunc('second', ts) as date, * from events)
select pod_name, 'cpu' as name, date, floor(value * 1e9)::bigint::double / 1e9 as value, false as cumulative from s
union all select pod_name, 'memory', date, (event_id * 1000)::double / 1048576, false from s
union all select pod_name, 'network_in', date, (user_id * 4096)::double / 1048576, true from s
union all select pod_name, 'network_out', date, (event_id * 512)::double / 1048576, true from s""")
def snapshots(spark, sf):
    path = new_dir(spark, "snapshots")
    snapshot_documents(spark, sf).write.option("compression", "gzip").json(path)
    out = io.read_snapshots(spark, path)
    return out.withColumn("date", F.col("date").cast("timestamp_ntz"))


LOG = """kinds as (select cast(ts as date) as day, user_id as rank, event_id, ts as moment, date_trunc('second', ts) as ts,
   case event_type when 'view' then 'train' when 'click' then 'epoch' when 'signup' then 'validation'
     when 'purchase' then 'best' else 'other' end as kind, value from events),
 parsed as (select *, case when kind in ('epoch', 'best') then event_id end as own from kinds)"""


@query(f"with {LOG}" + """ select day, rank, ts, kind, last_value(own ignore nulls) over (partition by day, rank
   order by moment, event_id rows between unbounded preceding and current row) as epoch,
 case when kind = 'train' then event_id end as batch, case when kind = 'best' then 'Prec@1' end as metric,
 case when kind = 'best' then user_best end as best_epoch,
 case when kind = 'epoch' then rank::double when kind <> 'other' then value end as value
 from (select *, event_id // 2 as user_best from parsed)""")
def worker_logs(spark, sf):
    path = new_dir(spark, "logs")
    kind = F.col("event_type")
    message = (F.when(kind == "view", F.format_string("Train Batch %5d: loss=%.3f", "event_id", "value"))
               .when(kind == "click", F.format_string("Current epoch : %d : lr=[0.1] : time=%10.3e", "event_id",
                                                      F.col("user_id").cast("double")))
               .when(kind == "signup", F.format_string("Validation loss=%.3f", "value"))
               .when(kind == "purchase", F.format_string(
                   "best_Prec@1 for rank %d:(best epoch %d, current epoch %d): %.3f", "user_id",
                   F.expr("event_id div 2"), "event_id", "value"))
               .otherwise("Try to load previous model from the path:none"))
    (t.table(spark, sf, "events")
     .withColumn("line", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" trainer "),
                                  F.col("user_id").cast("string"), F.lit(" INFO: "), message))
     .withColumn("day", F.to_date("ts"))
     .repartitionByRange("ts", "event_id").sortWithinPartitions("day", "ts", "event_id")
     .select("day", "line").write.partitionBy("day").text(path))
    out = logs.parse_worker_logs(logs.read_worker_logs(spark, path))
    return out.select(F.regexp_extract("source", r"day=([0-9-]+)$", 1).cast("date").alias("day"), "rank",
                      F.col("ts").cast("timestamp_ntz").alias("ts"), "kind", "epoch", "batch", "metric",
                      "best_epoch", "value")


BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"


@query(rf"""with chunks as (select lang as run_id, doc_id, 'stdout' as stream, text from documents
  union all select lang, doc_id, 'stderr', source from documents),
 cut as (select run_id, doc_id, stream, string_split_regex(regexp_replace(text, '(?:{BREAK})\z', ''), '{BREAK}') as lines
   from chunks where length(text) > 0),
 placed as (select run_id, stream, lines, sum(len(lines)) over (partition by run_id, stream order by doc_id) - len(lines) as start
   from cut)
select run_id, stream, start::bigint + i as line_no, md5(line) as line from (
 select run_id, stream, start, unnest(lines) as line, unnest(range(len(lines))) as i from placed)""")
def job_output(spark, sf):
    chunks = t.table(spark, sf, "documents").select(
        F.col("lang").alias("run_id"), F.col("doc_id").alias("chunk_no"), F.col("text").alias("stdout"),
        F.col("source").alias("stderr"))
    return logs.explode_job_output(chunks).withColumn("line", F.md5("line"))


@query(with_tables(PODS, RUNS, METRICS, RUN_METRICS) + """select r.run_id, 'metrics_' || r.name as archive,
  'result_' || m.name || '.json' as file, m.date, m.value, m.cumulative
 from metrics m join runs r on m.run_id = r.run_id
 where m.date >= r.created_at and (r.finished_at is null or m.date <= r.finished_at)
 union all select run_id, 'metrics_' || run_name, pod_name || '_' || name || '.json', date, value, cumulative from run_metrics""")
def export_run(spark, sf):
    path = new_dir(spark, "export")
    rows = entities.run_export_rows(t.runs(spark, sf), t.pods(spark, sf), t.metrics(spark, sf))
    return exported(spark, rows, path)


def exported(spark, rows, path):
    """Rows of the documents written for ``rows``."""
    export.export_run(rows, path)
    sample = F.from_json(F.regexp_replace("value", r"^[\[,]", ""), "date timestamp, value string, cumulative boolean")
    return (export.exported_lines(spark, path).filter(F.col("value") != "]")
            .select(F.col("run_id").cast("bigint").alias("run_id"), "archive", "file", sample.alias("s"))
            .select("run_id", "archive", "file", F.col("s.date").cast("timestamp_ntz").alias("date"), 
                    F.col("s.value").cast("double").alias("value"), "s.cumulative"))


@query(with_tables(PODS, RUNS, METRICS, RUN_METRICS) + """select r.run_id, 'metrics_' || r.name as archive,
  'result_' || m.name || '.json' as file, m.date, m.value, m.cumulative
 from metrics m join runs r on m.run_id = r.run_id
 where m.date >= r.created_at and (r.finished_at is null or m.date <= r.finished_at)
 union all select run_id, 'metrics_' || run_name, pod_name || '_' || name || '.json', date, value, cumulative from run_metrics""")
def export_packed(spark, sf):
    """All series in a few sorted files with an index."""
    path = new_dir(spark, "packed")
    export.export_packed(entities.run_export_rows(t.runs(spark, sf), t.pods(spark, sf), t.metrics(spark, sf)), path, file_lines=20_000)
    lines = spark.read.parquet(f"{path}/lines").filter("line <> ']'")
    sample = F.from_json(F.regexp_replace("line", r"^[\[,]", ""), "date timestamp, value string, cumulative boolean")
    return lines.select("run_id", "archive", "file", sample.alias("s")).select(
        "run_id", "archive", "file", F.col("s.date").cast("timestamp_ntz").alias("date"), F.col("s.value").cast("double").alias("value"),
        "s.cumulative")


@query(with_tables(PODS, METRICS) + """select p.pod_id as run_id, 'metrics_' || replace(p.name, '#', '') as archive,
  'result_' || m.name || '.json' as file, m.date, m.value, m.cumulative from metrics m join pods p on m.pod_id = p.pod_id""")
def export_pod(spark, sf):
    return exported(spark, entities.pod_export_rows(t.pods(spark, sf), t.metrics(spark, sf)), new_dir(spark, "export"))


@query(with_tables(PODS, RUNS, METRICS, RUN_METRICS) + """select r.run_id, 'metrics_' || r.name as archive,
  'result_' || m.name || '.json' as file, m.date, m.value, m.cumulative
 from metrics m join runs r on m.run_id = r.run_id
 where m.date >= r.created_at and (r.finished_at is null or m.date <= r.finished_at) and m.date >= timestamp '2024-01-15'
 union all select run_id, 'metrics_' || run_name, pod_name || '_' || name || '.json', date, value, cumulative
 from run_metrics where date >= timestamp '2024-01-15'""")
def export_since(spark, sf):
    rows = entities.run_export_rows(t.runs(spark, sf), t.pods(spark, sf), t.metrics(spark, sf),
                                    since=F.lit("2024-01-15").cast("timestamp"))
    return exported(spark, rows, new_dir(spark, "export"))


@query(with_tables(PODS, RUNS, PAYLOADS, JUDGED) + """select name, status::bigint as status, message, count(*) as payloads
 from judged group by 1, 2, 3""")
def metric_events(spark, sf):
    path = new_dir(spark, "events")
    payloads(spark, sf).drop("metric_id").write.option("compression", "gzip").json(path)
    judged = entities.ingest_status(io.read_metric_events(spark, path), t.pods(spark, sf), t.runs(spark, sf))
    return judged.groupBy("name", "status", "message").agg(F.count(F.lit(1)).alias("payloads"))


@query(with_tables(METRICS) + f"""select metric_id, name, date, value, cumulative, pod_id, run_id from metrics
 where date >= timestamp '{SINCE}' and name in ('cpu', 'memory')""")
def metrics_table(spark, sf):
    path = new_dir(spark, "metrics")
    io.write_metrics(t.metrics(spark, sf).withColumns({
        "date": F.col("date").cast("timestamp"), "value": F.col("value").cast("string")}), path)
    stored = io.read_metrics(spark, path, F.lit(SINCE).cast("timestamp"))
    return stored.filter(F.col("name").isin("cpu", "memory")).select(
        "metric_id", "name", F.col("date").cast("timestamp_ntz").alias("date"),
        F.col("value").cast("double").alias("value"), "cumulative", "pod_id", "run_id")


@query("""with words as (select doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7f]', '', 'g') as s from documents),
 joined as (select doc_id, regexp_replace(trim(regexp_replace(s, '[/\\s\\x0b\\x1c-\\x1f]+', ' ', 'g')), ' ', '_', 'g') as s from words)
select doc_id, md5(trim(regexp_replace(s, '[^A-Za-z0-9_.-]', '', 'g'), '._')) as digest from joined""")
def safe_filename(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", F.md5(scalars.safe_file_name(F.col("text"))).alias("digest"))


@query(with_tables(JOBS) + """select run_id, cast(owner / 4.0::double * 1000 as varchar) || 'm' as quantity,
 owner / 4.0::double as cores from jobs""")
def cpu_quantity(spark, sf):
    out = t.jobs(spark, sf).select("run_id", scalars.cpu_quantity(F.col("owner") / 4.0).alias("quantity"))
    return out.withColumn("cores", scalars.cpu_cores(F.col("quantity")))


@query(_training_sql(2, 3))
def resume(spark, sf):
    """One epoch, saved; the second epoch from the saved state."""
    path = new_dir(spark, "state")
    data = t.order_samples(spark, sf)

    def save(state, is_best):
        store(spark, state, path, "7", 1, "all", is_best)
    _, first = linear.train(data, data, START, settings(spark, sf, 1, 3), save=save)
    state, second = linear.train(data, None, None, settings(spark, sf, 2, 3), state=resume_state(spark, path, "7"))
    return outcome(spark, state, first.unionByName(second))


@query(r"""with words as (select doc_id, regexp_replace(text, '[\t\n\x0b\f\r ]+', ' ', 'g') as words from documents)
select doc_id as seq, 'log' as file, case when doc_id % 3 = 2 then 'train' else 'other' end as kind, doc_id % 3 = 2 as has_ts,
 md5(case doc_id % 3 when 0 then '2018-13-45 10:00:00 trainer 0 INFO: impossible ' || words when 1 then 'wrapped ' || words
     else 'Train Batch ' || doc_id || ': loss=0.5' end) as message from words""")
def worker_logs_dirty(spark, sf):
    """Whole texts as lines of other forms and with impossible dates are kept, and so is their place."""
    form, words = F.col("doc_id") % 3, F.regexp_replace("text", r"[\t\n\x0b\f\r ]+", " ")
    lines = t.table(spark, sf, "documents").select(
        F.when(form == 0, F.concat(F.lit("2018-13-45 10:00:00 trainer 0 INFO: impossible "), words))
        .when(form == 1, F.concat(F.lit("wrapped "), words))
        .otherwise(F.concat(F.lit("2018-09-24 10:00:00 trainer 0 INFO: Train Batch "), F.col("doc_id").cast("string"), F.lit(": loss=0.5"))).alias("line"),
        F.lit("job").alias("source"), F.lit("log").alias("file"), F.lit(0).cast("bigint").alias("block"), F.col("doc_id").alias("seq"))
    return logs.parse_worker_logs(lines).select("seq", "file", "kind", F.col("ts").isNotNull().alias("has_ts"), F.md5("message").alias("message"))
