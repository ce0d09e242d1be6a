"""Readers and writers of entity, metric, event and sample tables."""

from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions.scalars import cores, mebibytes, parse_instant
from runlens.operators.samples import correct_binary_labels, to_dense


def read_pods(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PODS).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RUNS).parquet(path)


def read_metrics(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Metric table; with ``since`` (a timestamp column) folders of earlier days are not read."""
    metrics = spark.read.schema(schemas.METRICS).parquet(path)
    if since is not None:
        metrics = metrics.filter(F.col("date") >= since)
        if "day" in metrics.columns:
            metrics = metrics.filter(F.col("day") >= F.to_date(since))
    return metrics.drop("day")


def register(**tables: DataFrame) -> None:
    """Make tables available to ``spark.sql`` under the given names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def write_metrics(metrics: DataFrame, path: str, mode: str = "append") -> None:
    """Metric table in folders per name and day, so that reads by name and date skip files."""
    (metrics.withColumn("day", F.to_date("date"))
     .repartitionByRange("name", "day", "date")
     .write.mode(mode).partitionBy("name", "day").parquet(path))


def read_metric_events(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "json",
                       **options) -> DataFrame:
    """Posted metric payloads; a malformed line keeps its text in ``_corrupt_record``."""
    reader = spark.readStream if streaming else spark.read
    schema = schemas.EVENTS + (", _corrupt_record STRING" if fmt == "json" else "")
    return reader.schema(schema).options(**options).format(fmt).load(path)


def snapshot_metrics(snapshots: DataFrame) -> DataFrame:
    """One row per (pod, metric) of resource snapshots; the first container speaks for the pod."""
    pod = snapshots.select(F.explode("pods").alias("p"))
    first = F.col("p.containers")[0]
    net = F.col("p.network")

    def metric(name, instant, value, cumulative):
        return F.struct(F.lit(name).alias("name"), parse_instant(instant).alias("date"), value.alias("value"),
                        F.lit(cumulative).alias("cumulative"))

    return pod.select(F.col("p.podRef.name").alias("pod_name"), F.inline(F.array(
        metric("cpu", first["cpu"]["time"], cores(first["cpu"]["usageNanoCores"]), False),
        metric("memory", first["memory"]["time"], mebibytes(first["memory"]["usageBytes"]), False),
        metric("network_in", net["time"], mebibytes(net["rxBytes"]), True),
        metric("network_out", net["time"], mebibytes(net["txBytes"]), True))))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of landed resource snapshots (nested JSON, one document per line)."""
    return snapshot_metrics(spark.read.schema(schemas.SNAPSHOTS).json(path))


def read_libsvm(spark: SparkSession, path: str, n_features: int, dense: bool = True) -> DataFrame:
    """LIBSVM text, possibly compressed: (label, features) dense, or (label, entries) as (idx, val) from 0."""
    if dense:
        raw = spark.read.format("libsvm").option("numFeatures", n_features).load(path)
        return raw.select("label", vector_to_array("features").alias("features"))
    parts = F.split(F.trim(F.regexp_replace("value", r"\s*#.*$", "")), r"\s+")
    entries = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: _entry(p, n_features))
    # Blank lines and comments hold no sample; any other line must be one, else its cast fails.
    return (spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
            .select(parts[0].cast("double").alias("label"), entries.alias("entries")))


def _entry(pair, n_features: int):
    """(idx from 0, val) of ``position:value``; a position outside 1 to ``n_features`` is an error."""
    at = F.split_part(pair, F.lit(":"), F.lit(1)).cast("bigint")
    checked = F.when(at.between(1, n_features), at - 1).otherwise(
        F.raise_error(F.concat(F.lit(f"feature outside 1 to {n_features}: "), pair)).cast("bigint"))
    return F.struct(checked.alias("idx"), F.split_part(pair, F.lit(":"), F.lit(2)).cast("double").alias("val"))


def libsvm_lines(df: DataFrame) -> DataFrame:
    """Dense samples as LIBSVM lines without the zeros."""
    pairs = F.filter(F.transform("features", lambda x, i: F.when(
        x != 0, F.concat((i + 1).cast("string"), F.lit(":"), x.cast("string")))), lambda p: p.isNotNull())
    return df.select(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(pairs, " ")).alias("value"))


def write_samples(df: DataFrame, path: str, name: str, split: str, mode: str = "append") -> None:
    """Sample table in folders per dataset and split; samples without id get a stored one, above all ids that the
    dataset and split hold already, so appends never repeat an id."""
    if "sample_id" not in df.columns:
        above = 0
        if mode == "append":
            try:
                above = read_samples(df.sparkSession, path, name, split).agg(F.max("sample_id")).first()[0]
                above = 0 if above is None else above + 1
            except AnalysisException as missing:
                if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
        df = df.withColumn("sample_id", F.monotonically_increasing_id() + above)
    (df.withColumns({"dataset": F.lit(name), "split": F.lit(split)})
     .write.mode(mode).partitionBy("dataset", "split").parquet(path))


def read_samples(spark: SparkSession, path: str, name: str, split: str) -> DataFrame:
    """All files of one dataset and split; only their folder is listed."""
    return spark.read.parquet(path).filter((F.col("dataset") == name) & (F.col("split") == split))


def prepare_libsvm(spark: SparkSession, source: str, target: str, name: str, split: str, n_features: int,
                   sparse: bool = False, is_01: bool = True) -> None:
    """LIBSVM text to a sample table with 0/1 labels."""
    write_samples(correct_binary_labels(read_libsvm(spark, source, n_features, dense=not sparse), is_01),
                  target, name, split)


def dense_samples(df: DataFrame, n_features: int) -> DataFrame:
    """Stored sparse samples as dense arrays."""
    return to_dense(df, n_features)
