"""Pods, runs, metric series."""

from pyspark.sql import functions as F

from runlens.functions.scalars import format_instant
from runlens.operators import entities, series
from runlens.operators.scan import micros
from runlens.plans import tables as t
from runlens.plans.registry import query
from runlens.plans.tables import ARRIVALS, JOBS, METRICS, PODS, RUNS, with_tables

PAGE = 100
SINCE = "2024-01-16 00:00:00"

RATE = """rated as (select *, case when first_value(cumulative) over w then
   1000.0::double * greatest(0, value - coalesce(lag(value) over w, value))
   / greatest(1, (epoch_us(date) - coalesce(lag(epoch_us(date)) over w, epoch_us(date))) / 1000)
   else value end as rate from {source} window w as (partition by {keys} order by date, metric_id))"""

RUN_METRICS = """run_metrics as (select r.run_id, r.name as run_name, p.name as pod_name, m.pod_id, m.metric_id, m.name,
   m.date, m.value, m.cumulative from metrics m join pods p on m.pod_id = p.pod_id join runs r on p.run_id = r.run_id
   where m.date >= r.created_at and (r.finished_at is null or m.date <= r.finished_at))"""


@query(with_tables(PODS, RUNS, METRICS, RUN_METRICS, RATE.format(source="run_metrics", keys="run_id, pod_id, name")) + """
select run_id, name, count(*) as samples, round(avg(rate), 6) as mean_rate, round(max(rate), 6) as peak_rate
from rated where name in ('network_in', 'network_out') group by run_id, name""")
def run_network_rate(spark, sf):
    rows = entities.run_pod_metrics(t.runs(spark, sf), t.pods(spark, sf), t.pod_metrics(spark, sf))
    rows = rows.filter(F.col("name").isin("network_in", "network_out"))
    rated = series.counter_rate(rows, ["run_id", "pod_id", "name"])
    return rated.groupBy("run_id", "name").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg("rate"), 6).alias("mean_rate"),
        F.round(F.max("rate"), 6).alias("peak_rate"))


HISTORY = """history as (select o_orderkey as run_id, o_custkey % 100 + 1 as pod_id,
  timestamp '2024-01-01 00:00:00' + to_seconds(cast(floor(o_totalprice * 10) as bigint) % 2592000) as created_at,
  case when o_orderstatus <> 'P' then timestamp '2024-01-01 00:00:00'
    + to_seconds(cast(floor(o_totalprice * 10) as bigint) % 2592000 + o_custkey * 7919 % 40000) end as finished_at from orders)"""


@query(with_tables(METRICS, PODS, HISTORY) + """select h.run_id, h.run_id::varchar as run_name, m.pod_id, p.name as pod_name,
 m.metric_id, m.name, m.date, m.value from metrics m join pods p using (pod_id) join history h using (pod_id)
 where m.date >= h.created_at and (h.finished_at is null or m.date <= h.finished_at)""")
def run_pod_metrics_history(spark, sf):
    """Every pod has served many runs, some of which overlap or are still open."""
    runs, members = t.history(spark, sf)
    rows = entities.run_pod_metrics(runs, t.pods(spark, sf), t.pod_metrics(spark, sf), members)
    return rows.select("run_id", "run_name", "pod_id", "pod_name", "metric_id", "name", "date", "value")


@query(with_tables(PODS) + """select name, phase, ip, 'bench' as app, component,
 substr(node_name, 6) as zone from pods""")
def pod_list(spark, sf):
    listed = series.project_entity(t.pods(spark, sf), "pod")
    return listed.select("name", "phase", "ip", *[F.col("labels")[k].alias(k) for k in ("app", "component", "zone")])


@query(with_tables(RUNS) + """select run_id, name, created_at, finished_at, state,
 cast(null as varchar) as job_id, cast(null as varchar) as job_metadata from runs""")
def run_list(spark, sf):
    return series.project_entity(t.runs(spark, sf), "run")


@query(with_tables(METRICS) + """select name, value, strftime(date, '%Y-%m-%dT%H:%M:%S.%fZ') as date, metadata,
 cumulative from metrics""")
def metric_list(spark, sf):
    return series.project_entity(t.metrics(spark, sf), "metric") \
        .withColumn("date", format_instant(F.col("date")))


def _digest(samples):
    return F.md5(F.array_join(F.transform(samples, lambda s: F.concat(
        micros(s["date"]).cast("string"), F.lit("="), s["value"].cast("string"))), ";"))


@query(with_tables(METRICS) + f"""select pod_id, name, (rn // {PAGE}) as page, count(*) as samples,
 min(date) as first_date, max(date) as last_date,
 md5(string_agg(epoch_us(date) || '=' || value, ';' order by date, metric_id)) as digest
 from (select *, row_number() over (partition by pod_id, name order by date, metric_id) - 1 as rn
       from metrics where pod_id is not null) group by 1, 2, 3""")
def series_by_pod(spark, sf):
    paged = series.series(t.pod_metrics(spark, sf), ["pod_id", "name"], page_rows=PAGE)
    return paged.select("pod_id", "name", "page", F.size("samples").cast("bigint").alias("samples"),
                        F.col("samples")[0]["date"].alias("first_date"),
                        F.element_at("samples", -1)["date"].alias("last_date"),
                        _digest(F.col("samples")).alias("digest"))


@query(with_tables(METRICS) + f"""select run_id, name, (rn // {PAGE}) as page, count(*) as samples,
 md5(string_agg(epoch_us(date) || '=' || value, ';' order by date, metric_id)) as digest
 from (select *, row_number() over (partition by run_id, name order by date, metric_id) - 1 as rn
       from metrics where run_id is not null) group by 1, 2, 3""")
def series_by_run(spark, sf):
    own = t.metrics(spark, sf).filter(F.col("run_id").isNotNull())
    return series.series(own, ["run_id", "name"], page_rows=PAGE).select(
        "run_id", "name", "page", F.size("samples").cast("bigint").alias("samples"),
        _digest(F.col("samples")).alias("digest"))


@query(with_tables(METRICS) + f"""select pod_id, name, count(case when date >= timestamp '{SINCE}' then 1 end) as samples,
 min(case when date >= timestamp '{SINCE}' then date end) as first_date
 from metrics where pod_id is not null group by pod_id, name""")
def series_since_counts(spark, sf):
    instant = F.lit(SINCE).cast("timestamp_ntz")
    paged = series.series_since(t.pod_metrics(spark, sf), ["pod_id", "name"], instant)
    return paged.groupBy("pod_id", "name").agg(
        F.sum(F.size("samples")).alias("samples"), F.min(F.get("samples", F.lit(0))["date"]).alias("first_date"))


@query(with_tables(METRICS) + f"""select metric_id, name, date, value from metrics where date >= timestamp '{SINCE}'""")
def since(spark, sf):
    return series.since(t.metrics(spark, sf), F.lit(SINCE).cast("timestamp_ntz")) \
        .select("metric_id", "name", "date", "value")


@query(with_tables(METRICS) + "select distinct pod_id, name from metrics where pod_id is not null")
def metric_names(spark, sf):
    return series.metric_names(t.pod_metrics(spark, sf), ["pod_id"])


@query("select p_name as name, min(p_partkey) as part, arg_min(p_brand, p_partkey) as brand from part group by p_name")
def first_by_name(spark, sf):
    parts = t.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("part"),
                                              F.col("p_brand").alias("brand"))
    return series.first_by_name(parts, key="part")


@query(with_tables(PODS, METRICS) + """select p.name as pod_name, m.metric_id, m.name, m.date, m.value
 from metrics m join (select name, min(pod_id) as pod_id from pods group by name) p using (pod_id)
 where p.name in (select name from pods where phase = 'Running')""")
def select_by_pod(spark, sf):
    pods = t.pods(spark, sf)
    return series.select_metrics(t.metrics(spark, sf), pods.filter(F.col("phase") == "Running"), "pod", pods) \
        .select("pod_name", "metric_id", "name", "date", "value")


@query(with_tables(RUNS, METRICS) + """select run_id, metric_id, name, date, value from metrics
 where run_id in (select run_id from runs where state = 'finished')""")
def select_by_run(spark, sf):
    wanted = t.runs(spark, sf).filter(F.col("state") == "finished")
    return series.select_metrics(t.metrics(spark, sf), wanted, "run").select(
        "run_id", "metric_id", "name", "date", "value")


@query(with_tables(PODS) + "select pod_id, name from pods where component = 'worker'")
def label_match(spark, sf):
    return series.match_labels(t.pods(spark, sf), "component=worker,app=bench").select("pod_id", "name")


@query(with_tables(PODS) + """select case phase when 'Running' then 'success' when 'Pending' then 'warning' else 'danger'
 end as health, count(*) as pods from pods group by 1""")
def health_counts(spark, sf):
    return series.with_health(t.pods(spark, sf)).groupBy("health").agg(F.count(F.lit(1)).alias("pods"))


@query(with_tables(METRICS) + """select pod_id, name, max(date) as newest from metrics where pod_id is not null
 group by pod_id, name""")
def high_water(spark, sf):
    return series.high_water(t.pod_metrics(spark, sf))


ACCEPTED = """accepted as (select * from (select *, max(case when name <> 'network_out' then date end) over (
   partition by pod_id, case name when 'network_out' then 'network_in' else name end
   order by arrival range between unbounded preceding and 1 preceding) as seen from arrivals)
   where seen is null or date > seen)"""


@query(with_tables(METRICS, ARRIVALS, ACCEPTED) + "select metric_id, pod_id, name, date, value from accepted")
def accept_newer(spark, sf):
    return series.accept_newer(t.arrivals(spark, sf), "arrival").select("metric_id", "pod_id", "name", "date", "value")


POD_METRICS = "pod_metrics as (select * from metrics where pod_id is not null)"


@query(with_tables(METRICS, POD_METRICS, RATE.format(source="pod_metrics", keys="pod_id, name")) + """
select metric_id, pod_id, name, date, round(rate, 6) as rate from rated""")
def counter_rate(spark, sf):
    return series.counter_rate(t.pod_metrics(spark, sf)).select(
        "metric_id", "pod_id", "name", "date", F.round("rate", 6).alias("rate"))


@query(with_tables(METRICS, POD_METRICS, RATE.format(source="pod_metrics", keys="pod_id, name")) + """
select pod_id, name, min(date) as x_min, max(date) as x_max, 0.0::double as y_min,
 round(greatest(1.0::double, max(rate)), 6) as y_max from rated group by pod_id, name""")
def extents(spark, sf):
    out = series.extents(series.counter_rate(t.pod_metrics(spark, sf)))
    return out.withColumn("y_max", F.round("y_max", 6))


@query(with_tables(METRICS) + """, days as (select pod_id, cast(date as date) as day, name, date, value,
 count(*) over (partition by pod_id, cast(date as date), name) as n from metrics where pod_id is not null)
select pod_id, day, name, date, value from days
union all select pod_id, day, name, date - to_seconds(1), value from days where n = 1""")
def pad_singletons(spark, sf):
    daily = t.pod_metrics(spark, sf).select("pod_id", F.to_date("date").alias("day"), "name", "date", "value")
    return series.pad_singletons(daily, ["pod_id", "day", "name"])


@query(with_tables(PODS) + "select distinct node_name from pods")
def nodes(spark, sf):
    return series.nodes(t.pods(spark, sf))


@query("""select unnest(['name', 'value']) as "column", unnest([50, 100]::bigint[]) as width,
 unnest([(select count(*) from documents where length(source) > 50),
         (select count(*) from documents where length(text) > 100)]) as too_long""")
def overlong(spark, sf):
    from runlens.schemas import WIDTHS
    texts = t.table(spark, sf, "documents").select(F.col("source").alias("name"), F.col("text").alias("value"))
    return series.overlong(texts, WIDTHS)


@query(with_tables(PODS, METRICS) + """select p.name as pod_name, m.metric_id, m.name, m.date, m.value
 from pods p left join metrics m on p.pod_id = m.pod_id""")
def attach_metrics(spark, sf):
    pods = t.pods(spark, sf).select("pod_id", F.col("name").alias("pod_name"))
    return entities.attach_metrics(pods, t.pod_metrics(spark, sf), "pod_id", ["metric_id", "name", "date", "value"]) \
        .drop("pod_id")


@query(with_tables(PODS, RUNS, METRICS, RUN_METRICS) + """select run_id, pod_name, metric_id, name, date, value
 from run_metrics""")
def run_pod_metrics(spark, sf):
    return entities.run_pod_metrics(t.runs(spark, sf), t.pods(spark, sf), t.pod_metrics(spark, sf)).select(
        "run_id", "pod_name", "metric_id", "name", "date", "value")


@query(with_tables(PODS, RUNS, METRICS, RUN_METRICS) + """select r.run_id, 'result' as prefix, m.metric_id, m.name, m.date, m.value
 from metrics m join runs r on m.run_id = r.run_id
 where m.date >= r.created_at and (r.finished_at is null or m.date <= r.finished_at)
 union all select run_id, pod_name, metric_id, name, date, value from run_metrics""")
def run_export_rows(spark, sf):
    return entities.run_export_rows(t.runs(spark, sf), t.pods(spark, sf), t.metrics(spark, sf)).select(
        "run_id", "prefix", "metric_id", "name", "date", "value")


def payloads(spark, sf):
    """Posted payloads from the events: most name a pod, some a run, some neither."""
    kind = F.col("event_type")
    return t.table(spark, sf, "events").select(
        F.col("event_id").alias("metric_id"),
        F.when(~kind.isin("error", "view"), F.format_string("Supplier#%09d", "user_id")).alias("pod_name"),
        F.when(kind.isin("error", "click"), F.col("user_id").cast("string")).alias("run_id"),
        kind.alias("name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("date"),
        F.col("value").cast("string").alias("value"), F.lit("False").alias("cumulative"),
        F.col("props").alias("metadata"))


PAYLOADS = """payloads as (select event_id as metric_id,
  case when event_type not in ('error', 'view') then printf('Supplier#%09d', user_id) end as pod_name,
  case when event_type in ('error', 'click') then user_id end as run_id, event_type as name, ts, value from events)"""
JUDGED = """judged as (select e.metric_id, e.name, e.ts, e.value,
  case when e.pod_name is not null then (case when p.pod_id is null then 404 else 201 end)
       when e.run_id is not null then (case when r.run_id is null then 404 else 201 end) else 400 end as status,
  case when e.pod_name is not null then (case when p.pod_id is null then 'Pod not found' end)
       when e.run_id is not null then (case when r.run_id is null then 'Run not found' end)
       else 'Pod Name or run id have to be supplied' end as message,
  case when e.pod_name is not null then p.pod_id end as found_pod,
  case when e.pod_name is null then r.run_id end as found_run
  from payloads e left join (select name, min(pod_id) as pod_id from pods group by name) p on e.pod_name = p.name
  left join runs r on e.run_id = r.run_id)"""


@query(with_tables(PODS, RUNS, PAYLOADS, JUDGED) + """select metric_id, cast(status as bigint) as status, message,
 found_pod, found_run from judged""")
def ingest_status(spark, sf):
    return entities.ingest_status(payloads(spark, sf), t.pods(spark, sf), t.runs(spark, sf)).select(
        "metric_id", "status", "message", "found_pod", "found_run")


@query(with_tables(PODS, RUNS, PAYLOADS, JUDGED) + """select metric_id, name, ts as date, value, false as cumulative,
 found_pod as pod_id, found_run as run_id from judged where status = 201""")
def accepted_metrics(spark, sf):
    judged = entities.ingest_status(payloads(spark, sf), t.pods(spark, sf), t.runs(spark, sf))
    return entities.accepted_metrics(judged).select(
        "metric_id", "name", F.col("date").cast("timestamp_ntz").alias("date"),
        F.col("value").cast("double").alias("value"), "cumulative", "pod_id", "run_id")


@query(with_tables(PODS, METRICS) + """select metric_id, pod_id, name, date from metrics
 where pod_id in (select pod_id from pods)""")
def known_only(spark, sf):
    return entities.known_only(t.pod_metrics(spark, sf), t.pods(spark, sf)).select("metric_id", "pod_id", "name", "date")


CUT = "1998-01-01 00:00:00"


def listing(spark, sf, later: bool):
    """Workers seen before or after a date, with the state of their last order as phase."""
    orders = t.table(spark, sf, "orders")
    when = F.col("o_orderdate") >= F.lit(CUT).cast("timestamp_ntz")
    last = orders.filter(when if later else ~when).groupBy("o_custkey").agg(
        F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    return last.select(
        F.format_string("worker-%d", "o_custkey").alias("name"),
        F.when(F.col("status") == "O", "Running").when(F.col("status") == "P", "Pending").otherwise("Failed").alias("phase"),
        F.when(F.col("status") != "P", F.format_string("10.%d", "o_custkey")).alias("ip"),
        F.concat(F.lit("node-"), F.lower("status")).alias("node_name"))


LISTINGS = ",\n".join(f"""{name} as (select 'worker-' || o_custkey as name,
  case s when 'O' then 'Running' when 'P' then 'Pending' else 'Failed' end as phase,
  case when s <> 'P' then '10.' || o_custkey end as ip, 'node-' || lower(s) as node_name
  from (select o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as s from orders
        where o_orderdate {op} timestamp '{CUT}' group by o_custkey))"""
                      for name, op in (("stored", "<"), ("observed", ">=")))


@query(with_tables(LISTINGS) + """select coalesce(s.name, o.name) as name,
 case when s.name is null then 'insert' when o.name is null then 'delete' else 'keep' end as action,
 case when s.name is null then o.phase else s.phase end as phase,
 case when s.name is null then coalesce(o.ip, '') else s.ip end as ip,
 case when s.name is null then o.node_name else s.node_name end as node_name
 from stored s full join observed o on s.name = o.name""")
def inventory_changes(spark, sf):
    return entities.inventory_changes(listing(spark, sf, False), listing(spark, sf, True))


@query(with_tables(LISTINGS) + """select s.name, coalesce(o.phase, s.phase) as phase,
 o.phase is not null and o.phase <> s.phase as changed from stored s left join observed o on s.name = o.name""")
def phase_changes(spark, sf):
    return entities.refresh_phase(listing(spark, sf, False), listing(spark, sf, True)).select("name", "phase", "changed")


@query(with_tables(LISTINGS) + "select name, phase from stored where name not in (select name from observed)")
def removed(spark, sf):
    return entities.removed(listing(spark, sf, False), listing(spark, sf, True)).select("name", "phase")


@query(with_tables(PODS, RUNS, METRICS) + """select 'metric' as kind, metric_id as id, run_id from metrics
 where (pod_id is null or pod_id not in (select pod_id from pods where phase = 'Failed'))
   and (run_id is null or run_id not in (select run_id from runs where state = 'finished'))
 union all select 'pod', pod_id, case when run_id not in (select run_id from runs where state = 'finished') then run_id end
 from pods where phase <> 'Failed'
 union all select 'run', run_id, run_id from runs where state <> 'finished'""")
def cascade_delete(spark, sf):
    pods, runs, metrics = t.pods(spark, sf), t.runs(spark, sf), t.metrics(spark, sf)
    pods, runs, metrics = entities.delete_entities(
        pods, runs, metrics, pods.filter(F.col("phase") == "Failed"), runs.filter(F.col("state") == "finished"))
    return (metrics.select(F.lit("metric").alias("kind"), F.col("metric_id").alias("id"), "run_id")
            .unionByName(pods.select(F.lit("pod").alias("kind"), F.col("pod_id").alias("id"), "run_id"))
            .unionByName(runs.select(F.lit("run").alias("kind"), F.col("run_id").alias("id"), "run_id")))


@query(with_tables(PODS, JOBS) + """select p.pod_id, p.name, l.run_id from pods p left join (
 select owner, arg_max(run_id, (created_at, run_id)) as run_id from jobs group by owner) l on p.pod_id = l.owner""")
def assign_pods(spark, sf):
    taken = t.jobs(spark, sf).select(F.col("owner").alias("pod_id"), "run_id", F.col("created_at").alias("started"))
    return entities.assign_pods(t.pods(spark, sf), taken).select("pod_id", "name", "run_id")


@query(with_tables(JOBS) + """select run_id, created_at from (select run_id, created_at, max(finished_at) over (
 order by created_at, run_id rows between unbounded preceding and 1 preceding) as busy from jobs) where busy > created_at""")
def conflicting_runs(spark, sf):
    return entities.conflicting_runs(t.jobs(spark, sf)).select("run_id", "created_at")


@query(with_tables(JOBS) + "select count(*) as active from jobs where state = 'started'")
def active_runs(spark, sf):
    return entities.active_runs(t.jobs(spark, sf))
