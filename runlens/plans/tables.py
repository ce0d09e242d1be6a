"""The given tables read as pods, runs, metrics, records and samples, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.scalars import label_map
from runlens.operators.scan import micros, ordinal
from runlens.session import tune


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf}/{name}.parquet")


def pods(spark, sf) -> DataFrame:
    worker = F.when(F.col("s_acctbal") < 0, "master").otherwise("worker")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("pod_id"), F.col("s_name").alias("name"),
        label_map(F.concat(F.lit("app=bench,component="), worker, F.lit(",zone="),
                           F.col("s_nationkey").cast("string"))).alias("labels"),
        F.when(F.col("s_acctbal") < 0, "Failed").when(F.col("s_acctbal") < 3000, "Pending")
         .otherwise("Running").alias("phase"),
        F.concat(F.lit("10.0."), F.col("s_nationkey").cast("string"), F.lit("."),
                 F.col("s_suppkey").cast("string")).alias("ip"),
        F.concat(F.lit("node-"), F.col("s_nationkey").cast("string")).alias("node_name"),
        F.col("s_nationkey").cast("bigint").alias("run_id"))


PODS = """pods as (select s_suppkey as pod_id, s_name as name,
  case when s_acctbal < 0 then 'master' else 'worker' end as component,
  case when s_acctbal < 0 then 'Failed' when s_acctbal < 3000 then 'Pending' else 'Running' end as phase,
  '10.0.' || s_nationkey || '.' || s_suppkey as ip, 'node-' || s_nationkey as node_name,
  cast(s_nationkey as bigint) as run_id from supplier)"""


def runs(spark, sf) -> DataFrame:
    start = "timestampadd(DAY, n_nationkey, timestamp_ntz'2024-01-01 00:00:00')"
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("run_id"), F.col("n_name").alias("name"),
        F.expr(start).alias("created_at"),
        F.when(F.col("n_regionkey") > 0, F.expr(f"timestampadd(DAY, 5, {start})")).alias("finished_at"),
        F.when(F.col("n_regionkey") > 0, "finished").otherwise("started").alias("state"),
        (F.col("n_regionkey") + 1).cast("bigint").alias("num_workers"))


RUNS = """runs as (select cast(n_nationkey as bigint) as run_id, n_name as name,
  timestamp '2024-01-01 00:00:00' + to_days(n_nationkey) as created_at,
  case when n_regionkey > 0 then timestamp '2024-01-01 00:00:00' + to_days(n_nationkey + 5) end as finished_at,
  case when n_regionkey > 0 then 'finished' else 'started' end as state,
  cast(n_regionkey + 1 as bigint) as num_workers from nation)"""


def metrics(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    name = (F.when(kind == "view", "cpu").when(kind == "click", "memory").when(kind == "signup", "network_in")
            .when(kind == "purchase", "network_out").otherwise("train_loss"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("metric_id"), name.alias("name"), F.col("ts").alias("date"), "value",
        F.col("props").alias("metadata"), kind.isin("signup", "purchase").alias("cumulative"),
        F.when(kind != "error", F.col("user_id")).alias("pod_id"),
        F.when(kind == "error", F.col("user_id") % 25).alias("run_id"))


METRICS = """metrics as (select event_id as metric_id,
  case event_type when 'view' then 'cpu' when 'click' then 'memory' when 'signup' then 'network_in'
    when 'purchase' then 'network_out' else 'train_loss' end as name,
  ts as date, value, props as metadata, event_type in ('signup', 'purchase') as cumulative,
  case when event_type <> 'error' then user_id end as pod_id,
  case when event_type = 'error' then user_id % 25 end as run_id from events)"""


def pod_metrics(spark, sf) -> DataFrame:
    return metrics(spark, sf).filter(F.col("pod_id").isNotNull())


def arrivals(spark, sf) -> DataFrame:
    """Pod samples with the whole number that orders their arrival: days in order, mixed up inside a day."""
    mixed = F.conv(F.substring(F.md5(F.col("metric_id").cast("string")), 1, 8), 16, 10).cast("bigint")
    day = F.datediff(F.to_date("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    return pod_metrics(spark, sf).withColumn("arrival", day * (1 << 32) + mixed)


ARRIVALS = """arrivals as (select *, datediff('day', date '2024-01-01', cast(date as date)) * 4294967296
  + cast('0x' || substr(md5(cast(metric_id as varchar)), 1, 8) as bigint) as arrival
  from metrics where pod_id is not null)"""


def jobs(spark, sf) -> DataFrame:
    """Runs as many as orders, all closed, on the clock of the order dates."""
    start = "timestampadd(SECOND, cast(floor(o_totalprice) as bigint) % 86400, o_orderdate)"
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("owner"),
        F.col("o_orderpriority").alias("task"), F.expr(start).alias("created_at"),
        F.expr(f"timestampadd(SECOND, o_custkey, {start})").alias("finished_at"),
        F.when(F.col("o_orderstatus") == "O", "started").when(F.col("o_orderstatus") == "F", "finished")
         .otherwise("failed").alias("state"), F.col("o_totalprice").alias("price"))


JOBS = """jobs as (select o_orderkey as run_id, o_custkey as owner, o_orderpriority as task,
  o_orderdate + to_seconds(cast(floor(o_totalprice) as bigint) % 86400) as created_at,
  o_orderdate + to_seconds(cast(floor(o_totalprice) as bigint) % 86400) + to_seconds(o_custkey) as finished_at,
  case o_orderstatus when 'O' then 'started' when 'F' then 'finished' else 'failed' end as state,
  o_totalprice as price from orders)"""


def history(spark, sf) -> tuple:
    """(runs, which pod served them): a run per order on the clock of the samples, some without an end."""
    seconds = "cast(floor(o_totalprice * 10) as bigint) % 2592000"
    begin = "timestamp_ntz'2024-01-01 00:00:00'"
    runs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderkey").cast("string").alias("name"),
        F.expr(f"timestampadd(SECOND, {seconds}, {begin})").alias("created_at"),
        F.expr(f"case when o_orderstatus <> 'P' then timestampadd(SECOND, {seconds} + o_custkey * 7919 % 40000, {begin}) end")
         .alias("finished_at"), (F.col("o_custkey") % 100 + 1).alias("pod_id"))
    return runs.drop("pod_id"), runs.select("run_id", "pod_id")


def records(spark, sf) -> DataFrame:
    """Evaluations of one run per user: epoch in time order, accuracy, seconds since the first."""
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), (F.col("value") / 5).alias("value"), "ts", "event_id")
    first = events.groupBy("run_id").agg(F.min(micros("ts")).alias("_t0"))
    return (ordinal(events, ["run_id"], ["ts", "event_id"], "epoch")
            .join(first, "run_id")
            .withColumn("cumu_time", (micros("ts") - F.col("_t0")) / F.lit(1e6)).drop("_t0"))


RECORDS = """records as (select user_id as run_id, event_id, ts, value / 5 as value,
  row_number() over (partition by user_id order by ts, event_id) - 1 as epoch,
  (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6 as cumu_time from events)"""


def run_ids(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("run_id")).distinct()


def batch_losses(spark, sf) -> DataFrame:
    """Per-worker, per-batch losses with sample counts."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("batch"), F.col("l_linenumber").cast("bigint").alias("rank"),
        F.col("l_discount").alias("val"), F.col("l_quantity").alias("n"))


LOSSES = """losses as (select l_suppkey as batch, cast(l_linenumber as bigint) as rank,
  l_discount as val, l_quantity as n from lineitem)"""


def ridge_samples(spark, sf) -> DataFrame:
    x = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10)
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("rank"), x.alias("features"),
        (F.col("l_extendedprice") / 100000).alias("label"))


RIDGE = """ridge as (select cast(l_linenumber as bigint) as rank, l_quantity / 50 as x0, l_discount * 10 as x1,
  l_tax * 10 as x2, l_extendedprice / 100000 as y from lineitem)"""


def logistic_samples(spark, sf) -> DataFrame:
    x = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10,
                F.col("l_extendedprice") / 100000)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("rank"),
        x.alias("features"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("label"))


LOGISTIC = """logistic as (select l_orderkey as order_id, cast(l_linenumber as bigint) as rank,
  l_quantity / 50 as x0, l_discount * 10 as x1, l_tax * 10 as x2, l_extendedprice / 100000 as x3,
  case when l_returnflag = 'R' then 1.0::double else 0.0::double end as y from lineitem)"""


def order_samples(spark, sf) -> DataFrame:
    """One sample per order, with a unique id."""
    x = F.array(F.lit(1.0), F.col("o_custkey") / 1000, F.dayofyear("o_orderdate") / 366)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample_id"), x.alias("features"),
        (F.col("o_totalprice") / 500000).alias("label"), F.col("o_orderpriority").alias("class"))


ORDER_SAMPLES = """order_samples as (select o_orderkey as sample_id, 1.0::double as x0, o_custkey / 1000 as x1,
  dayofyear(o_orderdate) / 366 as x2, o_totalprice / 500000 as y, o_orderpriority as class from orders)"""


def with_tables(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"
