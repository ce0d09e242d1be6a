"""Training progress: running best, active time, time to accuracy, scaling, cost, comparison."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.schedules import configured
from runlens.operators.intervals import counted_up
from runlens.operators.scan import MAX_ROWS, micros, ordered

# Node prices per hour and the longest run a preemptible node allows.
REGULAR_PRICE = 0.19
PREEMPTIBLE_PRICE = 0.04
PREEMPTIBLE_HOURS = 24.0


def proper(df: DataFrame, value: str) -> DataFrame:
    """Rows with a usable value; NaN would win every maximum."""
    return df.filter(F.col(value).isNotNull() & ~F.isnan(value))


def best_so_far(df: DataFrame, keys, step: str, value: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Adds the best value up to each step, the first step that reached it, and whether it is this one.

    Rows of one step count from the lowest value to the highest."""
    # A maximum over (value, -step) keeps the earliest of equal values.
    here = F.struct(F.col(value).alias("v"), (-F.col(step)).alias("s"))
    rows = ordered(proper(df, value), keys, [step, value], max_rows).carry(_earlier=("max", here))
    rows = rows.add(_best=F.greatest(F.max(here).over(rows.running()), F.col("_earlier")))
    return (rows.add(best=F.col("_best.v"), best_step=-F.col("_best.s"),
                     is_best=F.col("_best.s") == -F.col(step))
            .result().drop("_earlier", "_best"))


def average_meter(df: DataFrame, keys, step: str, value: str, count: str,
                  max_rows: int = MAX_ROWS) -> DataFrame:
    """Adds running weighted sum, count and average; rows of one step count from the lowest value to the highest."""
    part = F.col(value) * F.col(count)
    rows = ordered(df, keys, [step, value, count], max_rows)
    rows = rows.carry(_sum=("sum", part), _count=("sum", F.col(count)))
    total = F.sum(part).over(rows.running()) + F.coalesce(F.col("_sum"), F.lit(0.0))
    n = F.sum(count).over(rows.running()) + F.coalesce(F.col("_count"), F.lit(0))
    rows = rows.add(running_sum=total, running_count=n)
    return rows.add(running_avg=F.col("running_sum") / F.col("running_count")).result().drop("_sum", "_count")


def active_time(events: DataFrame, keys, date: str = "ts", kind: str = "kind", tie: str = "event_id",
                offset: Column = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Adds ``active``: seconds of unpaused time credited by each pause or resume.

    The clock runs from the first event; time counts once a pause closes it, so between pauses the
    value stays. Pausing twice or resuming twice changes nothing. ``offset`` continues earlier time.
    """
    rows = ordered(events, keys, [date, tie], max_rows)
    here = F.struct(F.col(kind).alias("k"), micros(date).alias("t"))

    def gap(before):
        running = F.when(before["k"] != "pause", micros(date) - before["t"])
        return F.coalesce(running, F.lit(0)).cast("bigint")

    pause = F.col(kind) == "pause"
    rows = rows.add(_gap=gap(F.lag(here).over(rows.window())))
    rows = rows.add(_clock=F.sum("_gap").over(rows.running()))
    credited = F.max(F.when(pause, F.col("_clock"))).over(rows.running())
    if rows.split:
        # Clocks above start at 0 in each segment; the table says how far earlier segments had come.
        order = rows.segments_in_order()
        table = rows.segment_table(
            _start=F.min(micros(date)), _last=rows.last(here), _total=F.sum("_gap"),
            _closed=F.max(F.when(pause, F.col("_clock")))).withColumn("_prev", F.lag("_last").over(order))
        bridge = F.when(F.col("_prev.k") != "pause", F.col("_start") - F.col("_prev.t"))
        table = table.withColumn("_bridge", F.coalesce(bridge, F.lit(0)))
        table = table.withColumn("_base", F.sum(F.col("_bridge") + F.col("_total")).over(order) - F.col("_total"))
        table = table.withColumn("_before", F.max(F.col("_closed") + F.col("_base")).over(rows.earlier()))
        rows = rows.attach(table.select(*rows.keys, rows.by[-1], "_base", "_before"))
        credited = F.coalesce(credited + F.coalesce(F.col("_base"), F.lit(0)), F.col("_before"))
    start = F.lit(0.0) if offset is None else offset
    return rows.add(active=start + F.coalesce(credited, F.lit(0)) / F.lit(1e6)) \
        .result().drop("_gap", "_clock", "_base", "_before")


def within_budget(df: DataFrame, time: str, seconds: float) -> DataFrame:
    """Evaluations whose cumulative time is inside the budget."""
    return df.filter(F.col(time) <= seconds)


def first_crossing(df: DataFrame, keys, step: str, value: str, threshold: float) -> DataFrame:
    """First step at which the value reaches the threshold, and the value there."""
    return (proper(df, value).filter(F.col(value) >= threshold).groupBy(*keys)
            .agg(F.min(step).alias("step"), F.min_by(value, step).alias("reached")))


def time_to_accuracy(records: DataFrame, runs: DataFrame, target: float, run: str = "run_id",
                     time: str = "cumu_time", value: str = "value") -> DataFrame:
    """Per run the first cumulative time with value >= target; null when never reached."""
    hit = proper(records, value).filter(F.col(value) >= target) \
        .groupBy(run).agg(F.min(time).alias("time_to_accuracy"))
    return runs.select(run).join(hit, run, "left")


def accuracy_after_time(records: DataFrame, runs: DataFrame, seconds: float, run: str = "run_id",
                        time: str = "cumu_time", value: str = "value", step: str = "epoch") -> DataFrame:
    """Per run the value of the last evaluation inside the time budget; null without one."""
    last = within_budget(proper(records, value), time, seconds) \
        .groupBy(run).agg(F.max_by(value, F.struct(time, step)).alias("accuracy"))
    return runs.select(run).join(last, run, "left")


def scaling(runs: DataFrame, task: str = "task", workers: str = "num_workers", samples: str = "samples",
            seconds: str = "seconds") -> DataFrame:
    """Throughput per run, the ideal for its size taken from the smallest run of its task, their ratio."""
    rated = runs.withColumn("throughput", F.col(samples) / F.col(seconds))
    base = rated.groupBy(task).agg(
        F.min_by(F.struct(workers, "throughput"),
                 F.struct(F.col(workers), -F.col("throughput"))).alias("_base"))
    ideal = F.col("_base.throughput") * F.col(workers) / F.col(f"_base.{workers}")
    return (rated.join(base, task).withColumn("ideal", ideal)
            .withColumn("efficiency", F.col("throughput") / F.col("ideal")).drop("_base"))


def cost(runs: DataFrame, workers: str = "num_workers", seconds: str = "seconds",
         regular: float = REGULAR_PRICE, preemptible: float = PREEMPTIBLE_PRICE,
         limit_hours: float = PREEMPTIBLE_HOURS) -> DataFrame:
    """Price of each run; preemptible nodes are usable up to the hour limit."""
    hours = F.col(seconds) / 3600.0
    price = F.when(hours <= limit_hours, preemptible).otherwise(regular)
    return (runs.withColumn("hours", hours)
            .withColumn("regular_cost", F.col(workers) * hours * regular)
            .withColumn("cost", F.col(workers) * hours * price))


def schedule_table(configurations: DataFrame, keys=("run_id",)) -> DataFrame:
    """The learning rate of every step from 0 to ``steps`` - 1 of each configuration (``schedules.CONFIGURATION``): keys, step, lr.

    Configurations are rows, however many; steps are numbered in blocks, so a long run makes no long array.
    """
    steps = counted_up(configurations.filter("steps > 0"), F.lit(0).cast("bigint"), F.col("steps") - 1, "step")
    return steps.select(*keys, "step", configured(F.col("step")).alias("lr"))


def compare_runs(records: DataFrame, sizes, by: str = "epoch", workers: str = "num_workers",
                 value: str = "value") -> DataFrame:
    """Mean value per epoch with one column per run size (``w<size>``)."""
    if by != "epoch":
        raise ValueError("use compare_over_time for alignment by time")
    return records.groupBy(by).agg(
        *[F.avg(F.when(F.col(workers) == n, F.col(value))).alias(f"w{n}") for n in sizes])


def compare_over_time(records: DataFrame, tick_seconds: float, run: str = "run_id",
                      time: str = "cumu_time", value: str = "value", step: str = "epoch",
                      max_rows: int = MAX_ROWS) -> DataFrame:
    """Per run the latest value at every time tick from its first to its last evaluation.

    Samples are reduced to the last one per tick before any ordering; gaps repeat the earlier value.
    """
    ticks = F.ceil(F.col(time) / tick_seconds).cast("bigint")
    last = (proper(records, value).withColumn("tick", ticks).groupBy(run, "tick")
            .agg(F.max_by(value, F.struct(time, step)).alias("value")))
    # A gap is filled from its left end: find where the next tick of the run lies. Across a segment
    # border the next tick is the following segment's first one, which is carried backwards.
    turned = ordered(last.withColumn("_turn", -F.col("tick")), [run], ["_turn"], max_rows)
    turned = turned.carry(_next=("last", F.col("tick")))
    following = F.coalesce(F.lag("tick").over(turned.window()), F.col("_next"))
    until = F.coalesce(following - 1, F.col("tick"))
    filled = turned.add(_until=until).df.select(run, "value", F.col("tick").alias("_from"), "_until")
    return counted_up(filled, F.col("_from"), F.col("_until"), "tick").select(run, "tick", "value")
