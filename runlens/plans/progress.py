"""Averages over workers, progress of runs, schedules."""

from pyspark.sql import functions as F

from runlens.functions import schedules
from runlens.functions.scalars import checkpoint_file, run_dir, value_text
from runlens.operators import collective, progress
from runlens.plans import tables as t
from runlens.plans.registry import query
from runlens.plans.tables import JOBS, LOSSES, PODS, RECORDS, with_tables
from runlens.sources.checkpoints import parse_checkpoint_paths

TARGET = 70.0
BUDGET = 7200.0 * 24
SIZES = [1, 2, 3, 4, 5]


@query(with_tables(LOSSES) + """select rank, count(*) as batches, round(sum(val * n) / sum(n), 6) as mean
 from losses group by rank""")
def weighted_mean(spark, sf):
    losses = t.batch_losses(spark, sf)
    counts = losses.groupBy("rank").agg(F.count(F.lit(1)).alias("batches"))
    return collective.weighted_mean(losses, ["rank"], "val", "n").join(counts, "rank") \
        .withColumn("mean", F.round("mean", 6))


@query(with_tables(LOSSES) + """select batch, round(avg(m), 6) as mean from (
 select batch, rank, avg(val) as m from losses group by batch, rank) group by batch""")
def rank_mean(spark, sf):
    return collective.rank_mean(t.batch_losses(spark, sf), ["batch"], "val").withColumn("mean", F.round("mean", 6))


@query(with_tables(RECORDS) + """, steps as (select run_id, epoch, ln(1 + value) as v, event_id % 7 + 1 as n from records)
select run_id, epoch, round(sum(v * n) over w, 6) as running_sum, cast(sum(n) over w as bigint) as running_count,
 round(sum(v * n) over w / sum(n) over w, 9) as running_avg from steps window w as (partition by run_id order by epoch)""")
def average_meter(spark, sf):
    rows = t.records(spark, sf).select("run_id", "epoch", F.ln(1 + F.col("value")).alias("v"),
                                       (F.col("event_id") % 7 + 1).alias("n"))
    out = progress.average_meter(rows, ["run_id"], "epoch", "v", "n")
    return out.select("run_id", "epoch", F.round("running_sum", 6).alias("running_sum"), "running_count",
                      F.round("running_avg", 9).alias("running_avg"))


@query(with_tables(RECORDS) + """, prior as (select *, max(value) over (partition by run_id order by epoch
   rows between unbounded preceding and 1 preceding) as earlier from records),
 flagged as (select *, earlier is null or value > earlier as is_best from prior)
select run_id, epoch, value, greatest(value, coalesce(earlier, value)) as best, is_best,
 last_value(case when is_best then epoch end ignore nulls) over (partition by run_id order by epoch
   rows between unbounded preceding and current row) as best_step from flagged""")
def best_so_far(spark, sf):
    return progress.best_so_far(t.records(spark, sf), ["run_id"], "epoch", "value").select(
        "run_id", "epoch", "value", "best", "is_best", "best_step")


ACTIVE = """switches as (select user_id, event_id, ts, case event_type when 'click' then 'resume' else 'pause' end as kind
   from events where event_type in ('click', 'view')),
 gaps as (select *, case when lag(kind) over w = 'resume' or lag(kind) over w is null
   then coalesce(epoch_us(ts) - lag(epoch_us(ts)) over w, 0) else 0 end as gap
   from switches window w as (partition by user_id order by ts, event_id)),
 clocks as (select *, sum(gap) over (partition by user_id order by ts, event_id) as clock from gaps)"""


@query(with_tables(ACTIVE) + """select event_id, user_id, kind, round(coalesce(max(case when kind = 'pause' then clock end) over (
 partition by user_id order by ts, event_id), 0) / 1e6, 6) as active from clocks""")
def active_time(spark, sf):
    switches = t.table(spark, sf, "events").filter(F.col("event_type").isin("click", "view")).select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") == "click", "resume").otherwise("pause").alias("kind"))
    return progress.active_time(switches, ["user_id"]).select(
        "event_id", "user_id", "kind", F.round("active", 6).alias("active"))


@query(with_tables(RECORDS) + f"""select run_id, min(epoch) as step, arg_min(value, epoch) as reached
 from records where value >= {TARGET} group by run_id""")
def first_crossing(spark, sf):
    return progress.first_crossing(t.records(spark, sf), ["run_id"], "epoch", "value", TARGET)


@query(with_tables(RECORDS) + f"""select run_id, epoch, value, round(cumu_time, 6) as cumu_time from records
 where cumu_time <= {BUDGET}""")
def within_budget(spark, sf):
    return progress.within_budget(t.records(spark, sf), "cumu_time", BUDGET).select(
        "run_id", "epoch", "value", F.round("cumu_time", 6).alias("cumu_time"))


@query(with_tables(RECORDS) + f"""select run_id, round(min(case when value >= {TARGET} then cumu_time end), 6)
 as time_to_accuracy from records group by run_id""")
def time_to_accuracy(spark, sf):
    return progress.time_to_accuracy(t.records(spark, sf), t.run_ids(spark, sf), TARGET) \
        .withColumn("time_to_accuracy", F.round("time_to_accuracy", 6))


@query(with_tables(RECORDS) + f"""select run_id, arg_max(value, (cumu_time, epoch)) filter (where cumu_time <= {BUDGET})
 as accuracy from records group by run_id""")
def accuracy_after_time(spark, sf):
    return progress.accuracy_after_time(t.records(spark, sf), t.run_ids(spark, sf), BUDGET)


SIZED = """sized as (select owner % 5 + 1 as num_workers, task, count(*) * 50000 as samples,
  sum(epoch_us(finished_at) - epoch_us(created_at)) / 1e6 as seconds from jobs group by 1, 2)"""


def sized_runs(spark, sf):
    """Per task and number of workers: samples seen and seconds spent."""
    from runlens.operators.scan import micros
    return t.jobs(spark, sf).groupBy((F.col("owner") % 5 + 1).alias("num_workers"), "task").agg(
        (F.count(F.lit(1)) * 50000).alias("samples"),
        (F.sum(micros("finished_at") - micros("created_at")) / F.lit(1e6)).alias("seconds"))


@query(with_tables(JOBS, SIZED) + """, base as (select task, arg_min(samples / seconds, num_workers) as b,
  min(num_workers) as k0 from sized group by task)
select task, num_workers, round(samples / seconds, 6) as throughput, round(b * num_workers / k0, 6) as ideal,
 round((samples / seconds) / (b * num_workers / k0), 6) as efficiency from sized join base using (task)""")
def scaling(spark, sf):
    return progress.scaling(sized_runs(spark, sf)).select(
        "task", "num_workers", *[F.round(c, 6).alias(c) for c in ("throughput", "ideal", "efficiency")])


@query(with_tables(JOBS) + """select run_id, owner % 5 + 1 as num_workers, round(owner * 120 / 3600.0::double, 6) as hours,
 round((owner % 5 + 1) * (owner * 120 / 3600.0::double) * 0.19::double, 6) as regular_cost,
 round((owner % 5 + 1) * (owner * 120 / 3600.0::double) * case when owner * 120 / 3600.0::double <= 24 then 0.04::double
   else 0.19::double end, 6) as cost from jobs""")
def cost(spark, sf):
    runs = t.jobs(spark, sf).select("run_id", (F.col("owner") % 5 + 1).alias("num_workers"),
                                    (F.col("owner") * 120).alias("seconds"))
    return progress.cost(runs).select("run_id", "num_workers",
                                      *[F.round(c, 6).alias(c) for c in ("hours", "regular_cost", "cost")])


@query(with_tables(RECORDS) + "select epoch, " + ", ".join(
    f"round(avg(case when run_id % 5 + 1 = {n} then value end), 6) as w{n}" for n in SIZES)
    + " from records group by epoch")
def compare_runs(spark, sf):
    rows = t.records(spark, sf).withColumn("num_workers", F.col("run_id") % 5 + 1)
    out = progress.compare_runs(rows, SIZES)
    return out.select("epoch", *[F.round(f"w{n}", 6).alias(f"w{n}") for n in SIZES])


@query(with_tables(RECORDS) + """, lasts as (select run_id, cast(ceil(cumu_time / 86400) as bigint) as tick,
   arg_max(value, (cumu_time, epoch)) as value from records group by 1, 2),
 spans as (select *, coalesce(lead(tick) over (partition by run_id order by tick) - 1, tick) as until from lasts)
select run_id, value, unnest(range(tick, until + 1)) as tick from spans""")
def compare_over_time(spark, sf):
    return progress.compare_over_time(t.records(spark, sf), 86400.0)


CHECKPOINTS = """checkpoints as (select l_suppkey || '_set_net_sgd' as dir, cast(l_suppkey as varchar) as run_id,
  cast(l_quantity as bigint) as epoch, cast(l_linenumber as bigint) as rank from lineitem)"""


def checkpoint_paths(spark, sf):
    run = F.col("l_suppkey").cast("string")
    return t.table(spark, sf, "lineitem").select(F.concat_ws(
        "/", F.lit("/ckpt"), run_dir(run, F.lit("set"), F.lit("net"), F.lit("sgd")),
        checkpoint_file(F.col("l_quantity").cast("bigint"), F.col("l_linenumber"))).alias("path"))


@query(with_tables(CHECKPOINTS) + """select '/ckpt/' || dir || '/' || epoch || '_' || rank || '.pth.tar' as path, dir as directory, run_id,
 'set' as dataset, 'net' as model, 'sgd' as optimizer, epoch, rank, false as is_best from checkpoints""")
def checkpoint_listing(spark, sf):
    return parse_checkpoint_paths(checkpoint_paths(spark, sf))


@query(with_tables(CHECKPOINTS) + """select run_id, min(e) as epoch from (select run_id, rank, max(epoch) as e
 from checkpoints group by run_id, rank) group by run_id""")
def restorable_epoch(spark, sf):
    listed = parse_checkpoint_paths(checkpoint_paths(spark, sf))
    return collective.restorable_epoch(listed, directory="directory")


@query(with_tables(CHECKPOINTS) + """, saved as (select run_id, rank - 1 as rank, max(epoch) as e from checkpoints group by all),
 worlds as (select distinct run_id, 7 as world_size from checkpoints)
 select run_id, case when count(*) = 7 then min(e) end as epoch, case when count(*) = 7 then 'ok' else 'missing' end as status
 from worlds join saved using (run_id) where rank between 0 and 6 group by run_id""")
def restorable_missing_rank(spark, sf):
    listed = parse_checkpoint_paths(checkpoint_paths(spark, sf)).withColumn("rank", F.col("rank") - 1)
    return collective.restorable_status(listed, listed.select("run_id", F.lit(7).alias("world_size")).distinct())


@query(with_tables(PODS) + """select node_name as host, pod_id as rank,
 row_number() over (partition by node_name order by pod_id) - 1 as local_rank from pods""")
def local_rank(spark, sf):
    ranks = t.pods(spark, sf).select(F.col("node_name").alias("host"), F.col("pod_id").alias("rank"))
    return collective.local_rank(ranks)


def _elementwise_sql(fn, name):
    return f"""select label, i as pos, round({fn}(x), 6) as {name} from (
 select label, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings) group by label, i"""


def _elementwise(spark, sf, op, width=None):
    vectors = t.table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    out = collective.elementwise(vectors, ["label"], "v", op, width)
    return out.select("label", F.posexplode("v").alias("pos", "x")) \
        .select("label", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias(op))


@query(_elementwise_sql("sum", "sum"))
def elementwise_sum(spark, sf):
    return _elementwise(spark, sf, "sum", 64)


@query(_elementwise_sql("avg", "mean"))
def elementwise_mean(spark, sf):
    return _elementwise(spark, sf, "mean")


@query(_elementwise_sql("min", "min"))
def elementwise_min(spark, sf):
    return _elementwise(spark, sf, "min", 64)


@query(_elementwise_sql("max", "max"))
def elementwise_max(spark, sf):
    return _elementwise(spark, sf, "max")


@query("""select label, (rn // 16) as page, count(*) as vectors, arg_min(embedding[1], vec_id)::double as first_x,
 arg_max(embedding[1], vec_id)::double as last_x from (select *, row_number() over (partition by label order by vec_id) - 1
 as rn from embeddings) group by 1, 2""")
def gather(spark, sf):
    vectors = t.table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("rank"), "embedding")
    out = collective.gather(vectors, ["label"], "rank", "embedding", page_rows=16)
    return out.select("label", "page", F.size("samples").cast("bigint").alias("vectors"),
                      F.col("samples")[0][0].cast("double").alias("first_x"),
                      F.element_at("samples", -1)[0].cast("double").alias("last_x"))


# Schedules: the learning rate of every recorded step.

def _steps(spark, sf):
    return t.records(spark, sf).select("run_id", "epoch")


def _rates(spark, sf, lr):
    return _steps(spark, sf).select("run_id", "epoch", F.round(lr(F.col("epoch")), 9).alias("lr"))


def _rate_sql(expression):
    return with_tables(RECORDS) + f"select run_id, epoch, round({expression}, 9) as lr from records"


@query(_rate_sql("0.1::double"))
def schedule_const(spark, sf):
    return _rates(spark, sf, lambda s: schedules.schedule("const", s, lr=0.1))


@query(_rate_sql("""case when epoch <= 5 then epoch / 5.0::double * 35.2::double + (1 - epoch / 5.0::double) * 3.2::double
 else 35.2::double * pow(0.1::double, (epoch >= 32)::int + (epoch >= 59)::int) end"""))
def schedule_multistep_warmup(spark, sf):
    lr, start = schedules.initial_rates(lr_per_sample=0.1, batch_size=32)
    return _rates(spark, sf, lambda s: schedules.schedule(
        "MultiStepLRW", s, lr=lr, milestones=[32, 59], gamma=0.1, warmup=5, warmup_start=start, scale=11))


def _wave(amplitude, length=20):
    """From 0.001 up to 0.1 in the first half of a period and back in the second; the nearer end tells how far up."""
    return f"0.001::double + 0.099::double * 2 * least(epoch % {length}, {length} - epoch % {length}) / {length}.0::double * {amplitude}"


@query(_rate_sql(_wave("1")))
def schedule_triangular(spark, sf):
    return _rates(spark, sf, lambda s: schedules.schedule("CLR", s, base_lr=0.001, max_lr=0.1, length=20))


@query(_rate_sql(_wave("pow(0.5::double, epoch // 20)")))
def schedule_triangular2(spark, sf):
    return _rates(spark, sf, lambda s: schedules.cyclical(s, 0.001, 0.1, 20, "triangular2"))


@query(_rate_sql(_wave("pow(0.99::double, epoch)")))
def schedule_exp_range(spark, sf):
    return _rates(spark, sf, lambda s: schedules.cyclical(s, 0.001, 0.1, 20, "exp_range", gamma=0.99))


@query(_rate_sql(f"case when epoch <= 40 then {_wave('1', 40)} else 0.0001::double end"))
def schedule_one_cycle(spark, sf):
    return _rates(spark, sf, lambda s: schedules.cyclical(s, 0.001, 0.1, 40, "one_cycle", extra=0.1))


CONFIGURED = """configured as (select c_custkey as run_id, c_custkey % 5 as kind, 20 + c_custkey % 30 as steps, 0.01::double * (1 + c_custkey % 7) as lr,
  [10.0::double, 15.0::double + c_custkey % 4] as milestones, (c_custkey % 3 * 4)::double as warmup, 1 + c_custkey % 8 as workers,
  (6 + c_custkey % 9)::double as length, unnest(range(20 + c_custkey % 30)) as step from customer),
 phases as (select *, step % length as phase from configured)"""


@query(f"with {CONFIGURED}" + """ select run_id, step, round(case kind when 0 then lr
 when 1 then case when warmup > 0 and step <= warmup then lr * workers * step / warmup
   else lr * workers * pow(0.1::double, (step >= milestones[1])::int + (step >= milestones[2])::int) end
 when 4 then case when step > length then lr * 0.2::double else lr + (1 - lr) * 2 * least(phase, length - phase) / length end
 else lr + (1 - lr) * 2 * least(phase, length - phase) / length
   * case kind when 2 then 1 else pow(0.5::double, floor(step / length)) end end, 9) as lr from phases""")
def schedule_table(spark, sf):
    """A configuration per customer, of five kinds of schedule, each with lengths and milestones of its own."""
    key = F.col("c_custkey")
    kind, none = key % 5, F.lit(None)
    configurations = t.table(spark, sf, "customer").select(
        key.alias("run_id"), F.when(kind == 0, "const").when(kind == 1, "MultiStepLRW").otherwise("CLR").alias("schedule"),
        (20 + key % 30).cast("bigint").alias("steps"), (F.lit(0.01) * (1 + key % 7)).alias("lr"),
        none.cast("double").alias("lr_per_sample"), none.cast("bigint").alias("batch_size"), none.cast("double").alias("warmup_init_lr"),
        (1 + key % 8).alias("workers"), F.array(F.lit(10.0), F.lit(15.0) + key % 4).alias("milestones"), none.cast("double").alias("gamma"),
        (key % 3 * 4).cast("double").alias("warmup"),
        F.when(kind == 2, "triangular").when(kind == 3, "triangular2").when(kind == 4, "one_cycle").alias("mode"),
        F.lit(1.0).alias("max_lr"), (6 + key % 9).cast("double").alias("length"), F.lit(0.2).alias("extra"))
    return progress.schedule_table(configurations).withColumn("lr", F.round("lr", 9))


@query(with_tables(RECORDS) + """select run_id, epoch, printf('%.6f', value) as value, value as raw from records""")
def value_format(spark, sf):
    return t.records(spark, sf).select("run_id", "epoch", value_text(F.col("value")).alias("value"),
                                       F.col("value").alias("raw"))
