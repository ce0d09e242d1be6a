"""Metric samples as time series: selection, paging, rates, high-water marks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.scalars import has_labels, health, numbers
from runlens.operators.scan import MAX_ROWS, micros, ordered

PAGE_ROWS = 10_000

# Fields exposed per entity; counters that share the mark of another counter.
FIELDS = {
    "pod": ["name", "labels", "phase", "ip"],
    "run": ["run_id", "name", "created_at", "finished_at", "state", "job_id", "job_metadata"],
    "metric": ["name", "value", "date", "metadata", "cumulative"],
}
SHARED_MARK = {"network_out": "network_in"}


def project_entity(df: DataFrame, kind: str) -> DataFrame:
    """The exposed fields of pods, runs or metrics; fields the table lacks become null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
                       for c in FIELDS[kind]])


def since(df: DataFrame, instant, date: str = "date") -> DataFrame:
    """Samples at or after ``instant``."""
    return df.filter(F.col(date) >= instant)


def match_labels(df: DataFrame, selector: str) -> DataFrame:
    """Rows whose label map satisfies ``k1=v1,k2=v2``."""
    return df.filter(has_labels(F.col("labels"), selector))


def with_health(df: DataFrame) -> DataFrame:
    return df.withColumn("health", health(F.col("phase")))


def first_by_name(df: DataFrame, name: str = "name", key: str = "pod_id") -> DataFrame:
    """The row with the lowest id per name."""
    rest = [c for c in df.columns if c != name]
    row = df.groupBy(name).agg(F.min_by(F.struct(*rest), F.col(key)).alias("_row"))
    return row.select(name, *[F.col("_row")[c].alias(c) for c in rest])


def select_metrics(metrics: DataFrame, wanted: DataFrame, metric_type: str = "pod",
                   pods: DataFrame = None) -> DataFrame:
    """Samples of the requested entities: pods by ``name`` (first match) or runs by ``run_id``."""
    if metric_type == "pod":
        ids = (first_by_name(pods).join(wanted.select("name").distinct(), "name", "left_semi")
               .select("pod_id", F.col("name").alias("pod_name")))
        return metrics.join(ids, "pod_id")
    if metric_type == "run":
        return metrics.join(wanted.select("run_id").distinct(), "run_id", "left_semi")
    raise ValueError(f"unknown metric type {metric_type}")


def pages(df: DataFrame, keys, order, sample: Column, page_rows: int = PAGE_ROWS,
          max_rows: int = MAX_ROWS) -> DataFrame:
    """Each series as numbered pages, every page an array of at most ``page_rows`` ordered samples.

    The pages of a series in order are the series; no series has to fit into one task or one value.
    """
    keys = list(keys)
    rows = ordered(df, keys, order, max_rows)
    page = F.floor((F.row_number().over(rows.window()) - 1) / page_rows)
    if rows.split:
        sizes = rows.segment_table(_pages=F.ceil(F.count(F.lit(1)) / page_rows))
        rows = rows.attach(sizes.withColumn("_pages", F.sum("_pages").over(rows.earlier())))
        page = page + F.coalesce(F.col("_pages"), F.lit(0))
    # Rows of a page already share a task: the window's partitioning covers the grouping.
    return (rows.add(page=page.cast("bigint")).df.groupBy(*rows.by, "page")
            .agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], sample.alias("_sample"))))
                 .alias("_all"))
            .select(*keys, "page", F.transform("_all", lambda e: e["_sample"]).alias("samples")))


def series(df: DataFrame, keys, fields=("date", "value", "cumulative"), **limits) -> DataFrame:
    """All samples of every (entity, metric), ascending by date."""
    return pages(df, keys, ["date", "metric_id"], F.struct(*fields), **limits)


def series_since(df: DataFrame, keys, instant, **limits) -> DataFrame:
    """As ``series`` from ``instant`` on; a metric without such a sample keeps an empty page."""
    keys = list(keys)
    found = series(since(df, instant), keys, **limits)
    stale = (df.groupBy(*keys).agg(F.max("date").alias("_last"))
             .filter(F.col("_last") < instant)
             .select(*keys, F.lit(0).cast("bigint").alias("page"),
                     F.array().cast(found.schema["samples"].dataType).alias("samples")))
    return found.unionByName(stale)


def metric_names(df: DataFrame, entity) -> DataFrame:
    """Distinct metric names per entity."""
    return df.select(*entity, "name").distinct()


def high_water(df: DataFrame, keys=("pod_id", "name")) -> DataFrame:
    """Newest date per (entity, metric)."""
    return df.groupBy(*keys).agg(F.max("date").alias("newest"))


def counter_rate(df: DataFrame, keys=("pod_id", "name"), max_rows: int = MAX_ROWS) -> DataFrame:
    """Adds ``rate``: change per second of counters (never negative), the value of other metrics.

    A series counts as cumulative if its first sample says so. The first sample has rate 0, and time
    steps below one millisecond count as one.
    """
    rows = ordered(df.withColumn("_v", numbers(df, "value")), keys, ["date", "metric_id"], max_rows)
    here = F.struct(F.col("_v").alias("v"), micros("date").alias("t"))
    rows = rows.carry(_last=("last", here), _kind=("first", F.struct("cumulative")))
    rows = rows.add(_prev=F.coalesce(F.lag(here).over(rows.window()), F.col("_last"), here),
                    _cumulative=F.coalesce(F.col("_kind"), F.first(F.struct("cumulative")).over(rows.running()))["cumulative"])
    step = F.greatest(F.lit(1.0), (micros("date") - F.col("_prev.t")) / F.lit(1000.0))
    gain = F.greatest(F.lit(0.0), F.col("_v") - F.col("_prev.v"))
    rate = F.when(F.col("_cumulative"), F.lit(1000.0) * gain / step).otherwise(F.col("_v"))
    return rows.add(rate=rate).result().drop("_v", "_last", "_kind", "_prev", "_cumulative")


def accept_newer(df: DataFrame, arrival: str, entity=("pod_id",), shared=SHARED_MARK,
                 max_rows: int = MAX_ROWS, mark: str = None) -> DataFrame:
    """Samples strictly newer than all that arrived before for the same (entity, metric).

    ``arrival`` is a whole number; samples of one arrival are judged together. A metric in ``shared``
    is judged by the mark of the metric it maps to. ``mark`` names a column with a newest date known
    from earlier input.
    """
    pairs = F.create_map(*[F.lit(x) for pair in shared.items() for x in pair]) if shared else None
    owner = F.coalesce(F.try_element_at(pairs, F.col("name")), F.col("name")) if shared else F.col("name")
    setter = F.when(F.col("name") == owner, F.col("date"))
    rows = df.withColumn("_owner", owner)
    keys = [*entity, "_owner"]
    # One row per arrival, added up before the exchange, goes through the window; the samples do not.
    newest = rows.groupBy(*keys, arrival).agg(F.max(setter).alias("_newest"))
    marks = ordered(newest, keys, [arrival], max_rows).carry(_earlier=("max", F.col("_newest")))
    before = marks.window().rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.add(_seen=F.greatest(F.max("_newest").over(before), F.col("_earlier"))) \
        .result(*keys, arrival, "_seen")
    marks = marks.select(*[F.col(c).alias(f"_m_{c}") for c in (*keys, arrival)], "_seen")
    same = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in (*keys, arrival)]
    joined = rows.join(marks, same)
    seen = F.greatest("_seen", mark) if mark else F.col("_seen")
    return joined.filter(seen.isNull() | (F.col("date") > seen)).select(*df.columns)


def extents(df: DataFrame, keys=("pod_id", "name"), y: str = "rate") -> DataFrame:
    """Axis ranges per series: dates from first to last, values from 0 to at least 1."""
    return df.groupBy(*keys).agg(
        F.min("date").alias("x_min"), F.max("date").alias("x_max"), F.lit(0.0).alias("y_min"),
        F.greatest(F.lit(1.0), F.max(y)).alias("y_max"))


def pad_singletons(df: DataFrame, keys=("pod_id", "name")) -> DataFrame:
    """A series with one sample gets a copy one second earlier."""
    rest = [c for c in df.columns if c not in keys]
    single = (df.groupBy(*keys)
              .agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
              .filter(F.col("_n") == 1)
              .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
              .withColumn("date", F.col("date") - F.expr("interval 1 second")))
    return df.unionByName(single.select(*df.columns))


def nodes(pods: DataFrame) -> DataFrame:
    """Distinct nodes that host pods."""
    return pods.select("node_name").distinct()


def overlong(df: DataFrame, widths) -> DataFrame:
    """Rows per column whose text is longer than the store's column width."""
    return df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(w).cast("bigint").alias("width"),
                                     F.count_if(F.length(F.col(c).cast("string")) > w).alias("too_long"))
                            for c, w in widths.items()]).alias("_c")).select(F.inline("_c"))
