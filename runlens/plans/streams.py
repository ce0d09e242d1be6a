"""Streaming jobs run to the end of what has landed, twice, as rows arrive in two parts."""

from pyspark.sql import functions as F

from runlens.plans import tables as t
from runlens.plans.progress import TARGET
from runlens.plans.registry import query
from runlens.plans.tables import ARRIVALS, METRICS, PODS, RECORDS, RUNS, with_tables
from runlens.plans.telemetry import (ACCEPTED, JUDGED, LISTINGS, PAYLOADS, POD_METRICS, RATE, listing,
                                     payloads)
from runlens.session import new_dir
from runlens.streaming import commits, jobs, states

CUT = "2024-01-15 00:00:00"


def _parts(df, date):
    cut = F.lit(CUT).cast("timestamp_ntz")
    return [df.filter(F.col(date) < cut), df.filter(F.col(date) >= cut)]


def _run(spark, parts, start):
    """Land each part and run the job on it; the checkpoint carries over."""
    landing, checkpoint = new_dir(spark, "landing"), new_dir(spark, "checkpoint")
    for part in parts:
        part.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(part.schema).parquet(landing)
        start(stream, checkpoint).awaitTermination()


@query(with_tables(PODS, RUNS, PAYLOADS, JUDGED) + """select metric_id, status::bigint as status, message, found_pod, found_run,
 status = 201 as accepted from judged""")
def ingest_stream(spark, sf):
    out = new_dir(spark, "ingested")
    rows = payloads(spark, sf)
    parts = _parts(rows.withColumn("_at", F.to_timestamp_ntz("date", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))), "_at")
    _run(spark, [p.drop("_at") for p in parts], lambda stream, checkpoint: jobs.start_ingest(
        stream, lambda: t.pods(spark, sf), lambda: t.runs(spark, sf), out, checkpoint))
    return jobs.ingested(spark, out).select("metric_id", "status", "message", "found_pod", "found_run", "accepted")


@query(with_tables(PODS, RUNS, PAYLOADS, JUDGED) + """select metric_id, name, ts as date, value, found_pod as pod_id,
 found_run as run_id, status::bigint as status, message from judged""")
def ingest_stream_metrics(spark, sf):
    """Metric rows and refused payloads, committed together by each of two triggers."""
    root, rows = new_dir(spark, "ingested"), payloads(spark, sf)
    parts = _parts(rows.withColumn("_at", F.to_timestamp_ntz("date", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))), "_at")
    _run(spark, [p.drop("_at") for p in parts], lambda stream, checkpoint: jobs.start_metric_ingest(
        stream, lambda: t.pods(spark, sf), lambda: t.runs(spark, sf), root, checkpoint))
    accepted = commits.read(spark, root, "metrics", "metric_id bigint, name string, date timestamp, value string, "
                            "metadata string, cumulative boolean, pod_id bigint, run_id bigint")
    rejects = commits.read(spark, root, "rejects", rows.schema.add("status", "long").add("message", "string"))
    none = F.lit(None).cast("bigint")
    rejects = rejects.select("metric_id", "name", F.to_timestamp_ntz("date", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("date"),
                             "value", none.alias("pod_id"), none.alias("run_id"), "status", "message")
    return accepted.select("metric_id", "name", F.col("date").cast("timestamp_ntz").alias("date"), "value", "pod_id", "run_id",
                           F.lit(201).cast("bigint").alias("status"), F.lit(None).cast("string").alias("message")) \
        .unionByName(rejects).withColumn("value", F.col("value").cast("double"))


@query(with_tables(METRICS, ARRIVALS, ACCEPTED) + "select metric_id, pod_id, name, date, value from accepted")
def accept_newer_stream(spark, sf):
    out, state = new_dir(spark, "accepted"), new_dir(spark, "marks")
    _run(spark, _parts(t.arrivals(spark, sf), "date"), lambda stream, checkpoint: jobs.start_accept_newer(
        stream, "arrival", out, state, checkpoint))
    return spark.read.parquet(out).select("metric_id", "pod_id", "name", "date", "value")


@query(with_tables(METRICS, POD_METRICS, RATE.format(source="pod_metrics", keys="pod_id, name")) + """
select metric_id, pod_id, name, date, round(rate, 6) as rate from rated""")
def counter_rate_stream(spark, sf):
    out, state = new_dir(spark, "rates"), new_dir(spark, "last")
    _run(spark, _parts(t.pod_metrics(spark, sf), "date"), lambda stream, checkpoint: jobs.start_counter_rate(
        stream, out, state, checkpoint))
    return spark.read.parquet(out).select("metric_id", "pod_id", "name", "date", F.round("rate", 6).alias("rate"))


@query(with_tables(METRICS, ARRIVALS, ACCEPTED) + "select metric_id, pod_id, name, date, value from accepted")
def accept_newer_states(spark, sf):
    """Marks in the state store."""
    out = new_dir(spark, "accepted")
    columns = ["metric_id", "pod_id", "name", "date", "value", "arrival"]
    _run(spark, _parts(t.arrivals(spark, sf).select(*columns), "date"), lambda stream, checkpoint: states.start_table(
        states.newer_samples(stream, "arrival"), out, checkpoint))
    return spark.read.parquet(out).select("metric_id", "pod_id", "name", "date", "value")


@query(with_tables(METRICS) + ", days as (select metric_id, pod_id, name, date_trunc('day', date) as date, value, cumulative from metrics"
       " where pod_id is not null), " + RATE.format(source="days", keys="pod_id, name") + """
select metric_id, pod_id, name, date, round(rate, 6) as rate from rated""")
def counter_rate_stream_ties(spark, sf):
    """Dates of whole days, so that many samples of a series share one, also across the two triggers."""
    rows = t.pod_metrics(spark, sf).select("metric_id", "pod_id", "name", F.expr("cast(date_trunc('DAY', date) as timestamp_ntz)").alias("date"),
                                           "value", "cumulative")
    cut = F.lit(CUT).cast("timestamp_ntz")
    middle = rows.filter(F.col("date") == cut).agg(F.percentile_approx("metric_id", 0.5)).first()[0] or 0
    first = (F.col("date") < cut) | ((F.col("date") == cut) & (F.col("metric_id") <= middle))
    out = new_dir(spark, "rates")
    _run(spark, [rows.filter(first), rows.filter(~first)], lambda stream, checkpoint: states.start_table(
        states.rates(stream), out, checkpoint))
    found = spark.read.parquet(out).filter("not late")
    return found.select("metric_id", "pod_id", "name", "date", F.round("rate", 6).alias("rate"))


@query(with_tables(METRICS) + f"""select metric_id, name, date, value,
 case when date < timestamp '{CUT}' then 1 else 2 end::bigint as read from metrics""")
def read_since(spark, sf):
    landing, out, checkpoint = (new_dir(spark, n) for n in ("landing", "seen", "checkpoint"))
    reads = []
    for n, part in enumerate(_parts(t.metrics(spark, sf), "date"), start=1):
        part.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(part.schema).parquet(landing)
        reads.append(jobs.read_since(stream, out, checkpoint).withColumn("read", F.lit(n).cast("bigint")))
    return reads[0].unionByName(reads[1]).select("metric_id", "name", "date", "value", "read")


@query(with_tables(LISTINGS) + """select o.name, case when s.name is null then 'insert' when o.phase <> s.phase then 'phase'
 else 'keep' end as change, o.phase, coalesce(case when s.name is null then o.ip else s.ip end, '') as ip,
 coalesce(s.node_name, o.node_name) as node_name from observed o left join stored s on s.name = o.name
union all select name, 'delete', phase, coalesce(ip, ''), node_name from stored where name not in (select name from observed)""")
def inventory_stream(spark, sf):
    table, changes = new_dir(spark, "inventory"), new_dir(spark, "changes")
    seen = [listing(spark, sf, late).withColumn("seen_at", F.lit(n)) for n, late in enumerate((False, True))]
    nothing = seen[0].drop("seen_at").limit(0)
    _run(spark, seen, lambda stream, checkpoint: jobs.start_inventory(
        stream, nothing, table, changes, checkpoint))
    current = spark.read.parquet(f"{table}/batch_id=1")
    moved = spark.read.parquet(f"{changes}/batch_id=1")
    return (current.join(moved.select("name", "action"), "name", "left")
            .select("name", F.coalesce("action", F.lit("keep")).alias("change"), "phase", "ip", "node_name")
            .unionByName(moved.filter(F.col("action") == "delete").select(
                "name", F.col("action").alias("change"), "phase", F.coalesce("ip", F.lit("")).alias("ip"), "node_name")))


SEEN = """obs as (select k as seen_at, 'worker-' || c_custkey as name, ['Pending', 'Running', 'Failed'][(c_custkey + k) // 2 % 3 + 1] as phase,
  case when (c_custkey + k) % 7 <> 0 then '10.' || c_custkey || '.' || k else '' end as ip, 'node-' || k % 2 as node_name
  from customer, range(6) r(k) where k <> 3 and (c_custkey * 7 + k * 3) % 5 <> 0),
 changes as (
  select o.seen_at, case when p.name is null then 'insert' else 'phase' end as action, o.name, o.phase from obs o
    left join obs p on p.name = o.name and p.seen_at = o.seen_at - 1 where p.name is null or p.phase <> o.phase
  union all select p.seen_at + 1, 'delete', p.name, p.phase from obs p
    left join obs o on p.name = o.name and p.seen_at = o.seen_at - 1 where o.name is null and p.seen_at < 5),
 shown as (select seen_at, 'stored' as action, name, phase from obs where seen_at = 5 union all select * from changes)"""


def seen(spark, sf):
    """Six listings of the customers as workers, each leaving out some; the fourth shows nothing and stands for itself."""
    k = F.col("seen_at")
    rows = t.table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("seen_at")) \
        .filter((k != 3) & ((F.col("c_custkey") * 7 + k * 3) % 5 != 0))
    turn = F.expr("(c_custkey + seen_at) div 2 % 3")
    shown = rows.select("seen_at", F.format_string("worker-%d", "c_custkey").alias("name"),
                        F.when(turn == 0, "Pending").when(turn == 1, "Running").otherwise("Failed").alias("phase"),
                        F.when((F.col("c_custkey") + k) % 7 != 0, F.format_string("10.%d.%d", "c_custkey", "seen_at")).alias("ip"),
                        F.format_string("node-%d", k % 2).alias("node_name"))
    empty = t.table(spark, sf, "region").filter("r_regionkey = 0").select(
        F.lit(3).alias("seen_at"), *[F.lit(None).cast("string").alias(c) for c in ("name", "phase", "ip", "node_name")])
    return shown.unionByName(empty)


@query(f"with {SEEN}" + """ select s.seen_at::bigint as seen_at, s.action, s.name, s.phase, b.ip, b.node_name from shown s join obs b on b.name = s.name
 and b.seen_at = (select max(i.seen_at) from changes i where i.action = 'insert' and i.name = s.name
   and i.seen_at <= s.seen_at - (s.action = 'delete')::int)""")
def inventory_stream_many(spark, sf):
    """Three listings land in each of two triggers; every one of them counts."""
    root, rows = new_dir(spark, "inventory"), seen(spark, sf)
    _run(spark, [rows.filter("seen_at < 3"), rows.filter("seen_at >= 3")], lambda stream, checkpoint: jobs.start_presence(
        stream, rows.drop("seen_at").limit(0), root, checkpoint))
    entity = "name string, phase string, ip string, node_name string"
    changes = commits.read(spark, root, "changes", f"seen_at int, action string, {entity}")
    stored = commits.read(spark, root, "inventory", entity).select(F.lit(5).alias("seen_at"), F.lit("stored").alias("action"), "*")
    return changes.unionByName(stored).withColumn("seen_at", F.col("seen_at").cast("bigint"))


@query(with_tables(RECORDS) + f"""select run_id, max(value) as best, arg_max(epoch, (value, -epoch)) as best_step,
 min(case when value >= {TARGET} then epoch_us(ts) end) as reached_us from records group by run_id""")
def best_stream(spark, sf):
    out = new_dir(spark, "best")
    records = t.records(spark, sf).select("run_id", "epoch", "value", "ts")
    _run(spark, _parts(records, "ts"), lambda stream, checkpoint: jobs.start_best(
        stream, TARGET, out, checkpoint))
    return jobs.latest_best(spark, out)


@query(with_tables(RECORDS) + f"""select run_id, max(value) as best, arg_max(epoch, (value, -epoch)) as best_step,
 min(case when value >= {TARGET} then epoch_us(ts) end) as reached_us from records group by run_id""")
def best_stream_compacted(spark, sf):
    """Four triggers, every second of which folds the updates."""
    root = new_dir(spark, "best")
    records = t.records(spark, sf).select("run_id", "epoch", "value", "ts")
    days = [records.filter((F.dayofmonth("ts") % 4) == n) for n in range(4)]
    _run(spark, days, lambda stream, checkpoint: jobs.start_best_compacted(stream, TARGET, root, checkpoint, every=2))
    return jobs.current_best(spark, root)
