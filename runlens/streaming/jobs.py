"""Streaming jobs: ingest, high-water marks, rates, incremental reads, inventory, live best values.

Each trigger runs the batch operator on its new rows, so stream and batch agree and no key has to fit
into one task. State between triggers is a table with one row per key. Outputs and state are written
to a folder named after the trigger; a trigger repeated after a failure replaces its own folder, and
reads the state of the trigger before it, so every input row counts once.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens.operators.entities import accepted_metrics, ingest_status, reconcile_inventory, refresh_phase, rejected_events
from runlens.operators.presence import inventory_after
from runlens.operators.progress import proper
from runlens.operators.scan import micros
from runlens.operators.series import SHARED_MARK, accept_newer, counter_rate
from runlens.session import remove, written
from runlens.streaming import commits


def _reused(each):
    """Keep a trigger's rows while it works: the operator, its state and its output all read them."""
    def run(batch, batch_id):
        batch = batch.persist()
        try:
            each(batch, batch_id)
        finally:
            batch.unpersist()
    return run


def _start(stream: DataFrame, each, checkpoint: str, trigger: dict, mode: str = "append") -> StreamingQuery:
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).foreachBatch(each).start())


def _folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def _state_before(spark: SparkSession, path: str, batch_id: int, empty: DataFrame) -> DataFrame:
    return empty.limit(0) if batch_id == 0 else spark.read.parquet(_folder(path, batch_id - 1))


def start_ingest(events: DataFrame, pods, runs, out: str, checkpoint: str, trigger: dict = None) -> StreamingQuery:
    """Judge posted payloads against the current entities (functions that return tables).

    One pass writes both outcomes: folders ``accepted=true`` and ``accepted=false`` per trigger.
    """
    def each(batch, batch_id):
        judged = ingest_status(batch, pods(), runs())
        (judged.withColumn("accepted", F.col("status") == 201)
         .write.mode("overwrite").partitionBy("accepted").parquet(_folder(out, batch_id)))
    return _start(events, each, checkpoint, trigger)


def start_metric_ingest(events: DataFrame, pods, runs, root: str, checkpoint: str, trigger: dict = None) -> StreamingQuery:
    """As ``start_ingest``, into two tables below ``root``: ``metrics``, the rows of accepted payloads, and ``rejects``, the
    refused ones with status and message. A trigger's rows reach both or neither (``commits``).

    The entities may change while a trigger works, so payloads are judged once, and both tables are made of what was
    written then.
    """
    def each(batch, batch_id):
        spark = batch.sparkSession
        if batch_id <= commits.last_trigger(spark, root):
            return
        judged = written(ingest_status(batch, pods(), runs()), "judged")
        commits.commit(spark, root, batch_id, {"metrics": accepted_metrics(judged), "rejects": rejected_events(judged)})
        for path in {f.rpartition("/")[0] for f in judged.inputFiles()}:
            remove(spark, path)
    return _start(events, each, checkpoint, trigger)


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """Payloads judged so far, with ``accepted`` as a boolean."""
    return spark.read.parquet(out).withColumn("accepted", F.col("accepted").cast("boolean"))


def start_accept_newer(samples: DataFrame, arrival: str, out: str, state: str, checkpoint: str,
                       entity=("pod_id",), trigger: dict = None) -> StreamingQuery:
    """Keep samples newer than the mark of their (entity, metric); late ones are always dropped."""
    keys = [*entity, "_owner"]
    pairs = F.create_map(*[F.lit(x) for pair in SHARED_MARK.items() for x in pair])
    owner = F.coalesce(F.try_element_at(pairs, F.col("name")), F.col("name"))

    def each(batch, batch_id):
        spark = batch.sparkSession
        batch = batch.withColumn("_owner", owner)
        fresh = (batch.filter(F.col("name") == F.col("_owner")).groupBy(*keys)
                 .agg(F.max("date").alias("_mark")))
        before = _state_before(spark, state, batch_id, fresh)
        marked = batch.join(before, keys, "left")
        kept = accept_newer(marked, arrival, entity, mark="_mark").drop("_mark", "_owner")
        kept.write.mode("overwrite").parquet(_folder(out, batch_id))
        (before.unionByName(fresh).groupBy(*keys).agg(F.max("_mark").alias("_mark"))
         .write.mode("overwrite").parquet(_folder(state, batch_id)))
    return _start(samples, _reused(each), checkpoint, trigger)


def start_counter_rate(samples: DataFrame, out: str, state: str, checkpoint: str, keys=("pod_id", "name"),
                       trigger: dict = None, rejects: str = None) -> StreamingQuery:
    """Rates of accepted samples; the state row of a key is its last sample with its kind of series.

    Samples are ordered by date and metric_id, as in the batch operator. Those not after the last sample of an earlier
    trigger are late: no rate is made for them, they go to ``rejects`` if that path is given.
    """
    keys = list(keys)

    def each(batch, batch_id):
        spark = batch.sparkSession
        batch = batch.withColumn("_old", F.lit(False))
        newest = (batch.groupBy(*keys)
                  .agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]),
                                F.struct("date", "metric_id")).alias("_row"),
                       F.min_by("cumulative", F.struct("date", "metric_id")).alias("_kind")))
        fresh = newest.select(*keys, "_row.*", "_kind").withColumn("cumulative", F.col("_kind")) \
            .select(*batch.columns).withColumn("_old", F.lit(True))
        before = _state_before(spark, state, batch_id, fresh)
        last = before.select(*keys, F.struct("date", "metric_id").alias("_last"))
        judged = batch.join(last, keys, "left").withColumn(
            "_late", F.coalesce(F.struct("date", "metric_id") <= F.col("_last"), F.lit(False)))
        newer = judged.filter(~F.col("_late"))
        if rejects is not None:
            judged.filter("_late").select(*[c for c in batch.columns if c != "_old"]) \
                .write.mode("overwrite").parquet(_folder(rejects, batch_id))
        rated = counter_rate(before.unionByName(newer.select(*batch.columns)), keys)
        rated.filter(~F.col("_old")).drop("_old").write.mode("overwrite").parquet(_folder(out, batch_id))
        kinds = before.select(*keys, F.col("cumulative").alias("_first"))
        (before.unionByName(fresh).groupBy(*keys)
         .agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]),
                       F.struct("date", "metric_id")).alias("_row"))
         .select(*keys, "_row.*").join(kinds, keys, "left")
         .withColumn("cumulative", F.coalesce("_first", "cumulative")).select(*batch.columns)
         .write.mode("overwrite").parquet(_folder(state, batch_id)))
    return _start(samples, _reused(each), checkpoint, trigger)


def read_since(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Append everything that arrived since the last call and return only that.

    Source offsets are the cursor: nothing repeats and nothing is missed, whatever the clocks say.
    """
    spark = stream.sparkSession
    done = []

    def each(batch, batch_id):
        batch.write.mode("overwrite").parquet(_folder(out, batch_id))
        done.append(batch_id)
    _start(stream, each, checkpoint, None).awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(*[_folder(out, b) for b in done])


def start_inventory(observed: DataFrame, initial: DataFrame, table: str, changes: str, checkpoint: str,
                    trigger: dict = None, tie: str = "seen_at") -> StreamingQuery:
    """Bring the stored inventory in line with each observed listing, phases included.

    ``table`` holds one version per trigger; ``changes`` the inserts, deletes and phase changes. ``tie`` is the time of
    a listing, the same in all its rows: of several listings in one trigger the latest counts.
    """
    def each(batch, batch_id):
        spark = batch.sparkSession
        stored = initial if batch_id == 0 else spark.read.parquet(_folder(table, batch_id - 1))
        rest = [c for c in batch.columns if c != "name"]
        latest = batch.filter(F.col(tie).eqNullSafe(batch.agg(F.max(tie)).scalar()))
        seen = latest.groupBy("name").agg(F.max(F.struct(*rest)).alias("_row")).select("name", "_row.*")
        kept, moved = reconcile_inventory(stored, seen)
        refreshed = refresh_phase(kept, seen)
        (refreshed.drop("changed").write.mode("overwrite").parquet(_folder(table, batch_id)))
        (moved.unionByName(refreshed.filter("changed").drop("changed").withColumn("action", F.lit("phase")))
         .write.mode("overwrite").parquet(_folder(changes, batch_id)))
    return _start(observed, _reused(each), checkpoint, trigger or {"availableNow": True})


def start_presence(observed: DataFrame, initial: DataFrame, root: str, checkpoint: str, trigger: dict = None,
                   seen_at: str = "seen_at") -> StreamingQuery:
    """As ``start_inventory``, with every listing counted: however many land in one trigger, each of them makes its inserts,
    deletes and phase changes, also one that shows nothing (a row without a name).

    Below ``root``: ``inventory``, of which the newest version counts, and ``changes``. A listing that is not after the
    last one of an earlier trigger is late and changes nothing.
    """
    time = observed.schema[seen_at].dataType.simpleString()

    def each(batch, batch_id):
        spark = batch.sparkSession
        known = commits.last_trigger(spark, root) >= 0
        stored = commits.read(spark, root, "inventory", initial.schema) if known else initial
        mark = commits.read(spark, root, "mark", f"seen_at {time}")
        newest = mark.agg(F.max("seen_at")).first()[0]
        batch = batch if newest is None else batch.filter(F.col(seen_at) > F.lit(newest))
        after, changes = inventory_after(stored, batch, seen_at=seen_at)
        mark = batch.select(F.col(seen_at).alias("seen_at")).unionByName(mark).agg(F.max("seen_at").alias("seen_at"))
        commits.commit(spark, root, batch_id, {"changes": changes}, {"inventory": after, "mark": mark})
    return _start(observed, _reused(each), checkpoint, trigger)


def best_stream(records: DataFrame, target: float, run: str = "run_id", step: str = "epoch",
                value: str = "value", date: str = "ts") -> DataFrame:
    """Per run the best value, its earliest step, and the first time the target was reached."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(step)).alias("s")))
    reached = F.min(F.when(F.col(value) >= target, micros(date)))
    return (proper(records, value).groupBy(run).agg(best.alias("_best"), reached.alias("reached_us"))
            .select(run, F.col("_best.v").alias("best"), (-F.col("_best.s")).alias("best_step"), "reached_us"))


def start_best(records: DataFrame, target: float, out: str, checkpoint: str, trigger: dict = None,
               **names) -> StreamingQuery:
    """Write the runs whose best value or reach time changed, per trigger."""
    def each(batch, batch_id):
        batch.write.mode("overwrite").parquet(_folder(out, batch_id))
    return _start(best_stream(records, target, **names), each, checkpoint, trigger, mode="update")


def latest_best(spark: SparkSession, out: str, run: str = "run_id") -> DataFrame:
    """Current row per run from the updates written so far."""
    updates = spark.read.parquet(out)
    rest = [c for c in updates.columns if c not in (run, "batch_id")]
    return updates.groupBy(run).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("_row")) \
        .select(run, "_row.*")


def start_best_compacted(records: DataFrame, target: float, root: str, checkpoint: str, trigger: dict = None, every: int = 10,
                         run: str = "run_id", **names) -> StreamingQuery:
    """As ``start_best``, below ``root`` as committed parts; every ``every``-th trigger folds them into a snapshot of one row
    per run, so readers and folders have to do with no more than that many parts."""
    updates = best_stream(records, target, run, **names)

    def each(batch, batch_id):
        spark = batch.sparkSession
        part = batch.withColumn("trigger", F.lit(batch_id).cast("bigint"))
        if batch_id % every:
            commits.commit(spark, root, batch_id, {"best": part})
        else:
            whole = commits.read(spark, root, "best", part.schema).unionByName(part)
            commits.commit(spark, root, batch_id, snapshots={"best": _newest(whole, run)})
    return _start(updates, each, checkpoint, trigger, mode="update")


def _newest(updates: DataFrame, run: str) -> DataFrame:
    rest = [c for c in updates.columns if c != run]
    return updates.groupBy(run).agg(F.max_by(F.struct(*rest), "trigger").alias("_row")).select(run, "_row.*")


def current_best(spark: SparkSession, root: str, run: str = "run_id", run_type: str = "bigint", step_type: str = "bigint") -> DataFrame:
    """Current row per run of ``start_best_compacted``."""
    schema = f"{run} {run_type}, best double, best_step {step_type}, reached_us bigint, trigger bigint"
    return _newest(commits.read(spark, root, "best", schema), run).drop("trigger")
