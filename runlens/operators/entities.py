"""Pods, runs and their samples: joins, ingest validation, inventory upkeep, run conflicts.

No side is broadcast by hint: the dimension tables grow with the cluster, so Spark decides by size.
Fact tables are always the side a skew join may split.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.scalars import parse_flag, parse_instant, safe_file_name
from runlens.operators.intervals import FEW, in_spans
from runlens.operators.scan import MAX_ROWS, micros, ordered
from runlens.operators.series import first_by_name
from runlens.schemas import RUN_STATES

# Status codes and messages of a posted sample.
CREATED, BAD_REQUEST, NOT_FOUND = 201, 400, 404
POD_MISSING = "Pod not found"
RUN_MISSING = "Run not found"
NO_ENTITY = "Pod Name or run id have to be supplied"
MALFORMED = "Malformed sample"


def attach_metrics(entities: DataFrame, metrics: DataFrame, key: str, columns) -> DataFrame:
    """Every entity with its samples; an entity without samples appears once with nulls.

    Written as inner join plus the entities that have none: a left join could not split a hot entity.
    """
    samples = metrics.select(key, *columns)
    with_some = entities.join(samples, key)
    used = metrics.select(key).distinct()
    without = entities.join(used, key, "left_anti")
    return with_some.unionByName(without, allowMissingColumns=True)


def run_pod_metrics(runs: DataFrame, pods: DataFrame, metrics: DataFrame,
                    run_pods: DataFrame = None, carried=(), max_rows: int = MAX_ROWS) -> DataFrame:
    """Samples of a run's pods taken while the run lasted (an open run has no end).

    Membership is the pod's current run, or ``run_pods(run_id, pod_id)`` when a history is kept. ``carried`` names
    columns of the runs to keep. A pod may have served any number of runs (``in_spans``).
    """
    members = pods.select("pod_id", F.col("name").alias("pod_name"), "run_id") if run_pods is None else \
        run_pods.select("run_id", "pod_id").join(
            pods.select("pod_id", F.col("name").alias("pod_name")), "pod_id")
    spans = (members.filter(F.col("run_id").isNotNull())
             .join(runs.select("run_id", F.col("name").alias("run_name"), "created_at", "finished_at", *carried), "run_id"))
    # Without a history a pod has one span.
    few = None if run_pods is None else FEW
    return in_spans(metrics.drop("run_id"), spans, "pod_id", "date", "created_at", "finished_at", few, max_rows) \
        .drop("created_at", "finished_at")


def run_own_metrics(runs: DataFrame, metrics: DataFrame, carried=()) -> DataFrame:
    """A run's own samples within its lifetime."""
    spans = runs.select("run_id", F.col("name").alias("run_name"), "created_at", "finished_at", *carried)
    inside = (F.col("date") >= F.col("created_at")) & \
             (F.col("finished_at").isNull() | (F.col("date") <= F.col("finished_at")))
    return (metrics.filter(F.col("run_id").isNotNull()).join(spans, "run_id").filter(inside)
            .drop("created_at", "finished_at"))


def run_export_rows(runs: DataFrame, pods: DataFrame, metrics: DataFrame,
                    run_pods: DataFrame = None, since=None) -> DataFrame:
    """The samples of a run's export: its own under ``result``, its pods' under the pod name; from ``since`` on, if given.

    The archive's name is made on the table of runs.
    """
    columns = ["run_id", "run_name", "archive", "prefix", "name", "date", "value", "cumulative", "metric_id"]
    runs = runs.withColumn("archive", _archive("name"))
    metrics = metrics if since is None else metrics.filter(F.col("date") >= since)
    own = run_own_metrics(runs, metrics, ["archive"]).withColumn("prefix", F.lit("result"))
    of_pods = run_pod_metrics(runs, pods, metrics, run_pods, ["archive"]).withColumn("prefix", F.col("pod_name"))
    return own.select(*columns).unionByName(of_pods.select(*columns))


def pod_export_rows(pods: DataFrame, metrics: DataFrame, since=None) -> DataFrame:
    """The samples of each pod's own export, whenever taken; from ``since`` on, if given. ``run_id`` holds the pod's id."""
    named = pods.select("pod_id", F.col("name").alias("run_name"), _archive("name").alias("archive"))
    metrics = metrics if since is None else metrics.filter(F.col("date") >= since)
    return metrics.drop("run_id").join(named, "pod_id").select(
        F.col("pod_id").alias("run_id"), "run_name", "archive", F.lit("result").alias("prefix"), "name", "date", "value",
        "cumulative", "metric_id")


def _archive(name: str):
    return F.concat(F.lit("metrics_"), safe_file_name(F.col(name)))


def ingest_status(events: DataFrame, pods: DataFrame, runs: DataFrame) -> DataFrame:
    """Posted payloads with ``status``, ``message`` and the ids of the pod or run they belong to.

    A payload with a pod name is about that pod, otherwise its run id counts.
    """
    known_pods = first_by_name(pods.select("name", "pod_id")) \
        .select(F.col("name").alias("_pod_name"), F.col("pod_id").alias("_pod"))
    known_runs = runs.select(F.col("run_id").alias("_run")).distinct()
    wanted_run = F.when(F.col("pod_name").isNull(), F.col("run_id").cast("string").try_cast("bigint"))
    joined = (events.withColumn("_wanted", wanted_run)
              .join(known_pods, F.col("pod_name") == F.col("_pod_name"), "left")
              .join(known_runs, F.col("_wanted") == F.col("_run"), "left"))
    by_pod = F.col("pod_name").isNotNull()
    by_run = ~by_pod & F.col("run_id").isNotNull()
    whole = F.col("name").isNotNull() & parse_instant(F.col("date")).isNotNull() & F.col("value").isNotNull()
    status = (F.when(~by_pod & ~by_run, BAD_REQUEST)
              .when(by_pod & F.col("_pod").isNull(), NOT_FOUND)
              .when(by_run & F.col("_run").isNull(), NOT_FOUND)
              .when(~whole, BAD_REQUEST).otherwise(CREATED))
    message = (F.when(~by_pod & ~by_run, NO_ENTITY)
               .when(by_pod & F.col("_pod").isNull(), POD_MISSING)
               .when(by_run & F.col("_run").isNull(), RUN_MISSING)
               .when(~whole, MALFORMED))
    return joined.select(*events.columns, status.cast("bigint").alias("status"), message.alias("message"),
                         F.when(by_pod, F.col("_pod")).alias("found_pod"),
                         F.when(by_run, F.col("_run")).alias("found_run"))


def accepted_metrics(judged: DataFrame) -> DataFrame:
    """Metric rows of the accepted payloads."""
    keep = [c for c in ("metric_id", "arrival", "batch_id") if c in judged.columns]
    return judged.filter(F.col("status") == CREATED).select(
        *keep, "name", parse_instant(F.col("date")).alias("date"), "value",
        F.coalesce(F.col("metadata"), F.lit("")).alias("metadata"),
        F.coalesce(parse_flag(F.col("cumulative")), F.lit(False)).alias("cumulative"),
        F.col("found_pod").alias("pod_id"), F.col("found_run").alias("run_id"))


def rejected_events(judged: DataFrame) -> DataFrame:
    """Refused payloads with status and message."""
    return judged.filter(F.col("status") != CREATED).drop("found_pod", "found_run")


def known_only(metrics: DataFrame, pods: DataFrame) -> DataFrame:
    """Samples of known pods."""
    return metrics.join(pods.select("pod_id"), "pod_id", "left_semi")


def inventory_changes(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """One row per pod with ``action`` insert, keep or delete and the row's next content.

    Stored rows stay as they are; a missing address becomes the empty string on insert.
    """
    columns = ["phase", "ip", "node_name"]
    old = stored.select("name", F.struct(*columns).alias("_old"))
    new = observed.withColumn("ip", F.coalesce(F.col("ip"), F.lit(""))) \
        .select("name", F.struct(*columns).alias("_new"))
    both = old.join(new, "name", "full_outer")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("keep")
    content = F.coalesce(F.col("_old"), F.col("_new"))
    return both.select("name", action.alias("action"), *[content[c].alias(c) for c in columns])


def reconcile_inventory(stored: DataFrame, observed: DataFrame) -> tuple:
    """(next inventory, changes)."""
    changes = inventory_changes(stored, observed)
    return (changes.filter(F.col("action") != "delete").drop("action"),
            changes.filter(F.col("action") != "keep"))


def removed(stored: DataFrame, observed: DataFrame, key: str = "name") -> DataFrame:
    """Stored rows that are no longer observed."""
    return stored.join(observed.select(key), key, "left_anti")


def refresh_phase(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """Stored pods with the observed phase where there is one, and whether it changed."""
    seen = observed.select("name", F.col("phase").alias("_seen"))
    return (stored.join(seen, "name", "left")
            .withColumn("changed", F.col("_seen").isNotNull() & ~F.col("_seen").eqNullSafe(F.col("phase")))
            .withColumn("phase", F.coalesce(F.col("_seen"), F.col("phase"))).drop("_seen"))


def delete_entities(pods: DataFrame, runs: DataFrame, metrics: DataFrame, gone_pods: DataFrame = None,
                    gone_runs: DataFrame = None) -> tuple:
    """(pods, runs, metrics) after deletion: samples go with their owner, pods of a deleted run stay free."""
    if gone_pods is not None:
        ids = gone_pods.select("pod_id").distinct()
        pods = pods.join(ids, "pod_id", "left_anti")
        metrics = metrics.join(ids, "pod_id", "left_anti")
    if gone_runs is not None:
        ids = gone_runs.select("run_id").distinct()
        runs = runs.join(ids, "run_id", "left_anti")
        metrics = metrics.join(ids, "run_id", "left_anti")
        flagged = pods.join(ids.select("run_id", F.lit(True).alias("_gone")), "run_id", "left")
        pods = flagged.withColumn("run_id", F.when(F.col("_gone").isNull(), F.col("run_id"))) \
            .drop("_gone").select(*pods.columns)
    return pods, runs, metrics


def assign_pods(pods: DataFrame, run_pods: DataFrame) -> DataFrame:
    """Pods with the run that took them last; ``run_pods(run_id, pod_id, started)``."""
    latest = run_pods.groupBy("pod_id").agg(
        F.max_by("run_id", F.struct("started", "run_id")).alias("run_id"))
    return pods.drop("run_id").join(latest, "pod_id", "left")


def conflicting_runs(runs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Runs that started while an earlier one had not ended, with the latest end seen before them.

    Sorted sweep over the start times instead of comparing all pairs; an open run never ends.
    """
    end = F.coalesce(micros("finished_at"), F.lit((1 << 63) - 1))
    rows = ordered(runs.withColumn("_end", end), [], ["created_at", "run_id"], max_rows)
    rows = rows.carry(_earlier=("max", F.col("_end")))
    rows = rows.add(_busy=F.greatest(F.max("_end").over(rows.before()), F.col("_earlier")))
    out = rows.result().filter(F.col("_busy") > micros("created_at"))
    return out.drop("_end", "_earlier", "_busy")


def unknown_states(runs: DataFrame) -> DataFrame:
    """Runs whose state is none of the known ones."""
    return runs.filter(F.col("state").isNull() | ~F.col("state").isin(*RUN_STATES))


def active_runs(runs: DataFrame) -> DataFrame:
    """Number of started runs."""
    return runs.agg(F.count_if(F.col("state") == "started").alias("active"))

