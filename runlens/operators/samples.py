"""Labelled sample tables: label correction, feature layout, reproducible partitions and batches."""

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.scores import UNROLL, of_width
from runlens.operators.scan import MAX_ROWS, ordinal
from runlens.schemas import DATASETS

# Precisions by name.
PRECISIONS = {"fp32": "float", "fp64": "double"}
HASH_DIGITS = 4
# Bounds of shares stay whole numbers up to 9e12 samples.
SHARE_DENOMINATOR = 1_000_000
KEYED_HASH_DIGITS = 3


def cast_features(df: DataFrame, dtype: str, force_target: bool = False) -> DataFrame:
    """Features, and on request the label, as fp32 or fp64."""
    if dtype not in PRECISIONS:
        raise ValueError(f"unsupported precision {dtype}")
    to = PRECISIONS[dtype]
    out = df.withColumn("features", F.col("features").cast(f"array<{to}>"))
    return out.withColumn("label", F.col("label").cast(to)) if force_target else out


def correct_binary_labels(df: DataFrame, is_01: bool = True, label: str = "label") -> DataFrame:
    """Labels -1/1 to 0/1 if -1 occurs anywhere in the table."""
    if not is_01:
        return df
    signed = df.agg(F.bool_or(F.col(label) == -1).alias("_s")).scalar()
    return df.withColumn(label, F.when(signed & (F.col(label) == -1), F.lit(0).cast(df.schema[label].dataType))
                         .otherwise(F.col(label)))


def standardize(df: DataFrame, mean, std) -> DataFrame:
    """(x - mean) / std per feature; another number of features than means is an error."""
    x = F.col("features")
    if len(mean) <= UNROLL:
        scaled = F.array(*[(x[i] - float(m)) / float(s) for i, (m, s) in enumerate(zip(mean, std))])
    else:
        pairs = F.arrays_zip(x.alias("x"), F.lit([float(m) for m in mean]).alias("m"),
                             F.lit([float(s) for s in std]).alias("s"))
        scaled = F.transform(pairs, lambda e: (e["x"] - e["m"]) / e["s"])
    return df.withColumn("features", of_width(x, len(mean), scaled, "array<double>"))


def to_sparse(df: DataFrame) -> DataFrame:
    """Dense arrays to arrays of (idx, val) without the zeros."""
    entries = F.transform("features", lambda x, i: F.struct(i.cast("bigint").alias("idx"),
                                                            x.cast("double").alias("val")))
    return df.withColumn("entries", F.filter(entries, lambda e: e["val"] != 0)).drop("features")


def to_triplets(df: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Dense arrays to rows (sample, idx, val) without the zeros."""
    return (df.select(sample, F.posexplode("features").alias("idx", "val"))
            .filter(F.col("val") != 0)
            .select(sample, F.col("idx").cast("bigint").alias("idx"), F.col("val").cast("double").alias("val")))


def to_dense(df: DataFrame, n_features: int) -> DataFrame:
    """Arrays of (idx, val) to dense arrays of the given width."""
    entries = F.array_sort("entries")
    edges = F.concat(F.array(F.lit(-1).cast("bigint")), F.transform(entries, lambda e: e["idx"]))
    # Each entry brings the zeros between it and the entry before.
    runs = F.transform(entries, lambda e, i: F.concat(
        F.array_repeat(F.lit(0.0), (e["idx"] - F.get(edges, i) - 1).cast("int")), F.array(e["val"])))
    tail = F.array_repeat(F.lit(0.0), (F.lit(n_features) - 1 - F.element_at(edges, -1)).cast("int"))
    return df.withColumn("features", F.concat(F.flatten(runs), tail)).drop("entries")


def gather_entries(triplets: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Rows (sample, idx, val) to one array of (idx, val) per sample; bounded by the number of features."""
    return triplets.groupBy(sample).agg(
        F.array_sort(F.collect_list(F.struct("idx", "val"))).alias("entries"))


def shuffle_key(sample, seed: int, epoch: int = 0) -> Column:
    """Order key of a reproducible permutation."""
    return F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(sample).cast("string")))


def hashed_position(df: DataFrame, keys, sample: str, seed: int, epoch: int = 0, name: str = "pos",
                    total: str = None, digits: int = None) -> DataFrame:
    """Position of each row (per ``keys``) in the permutation of ``shuffle_key``.

    Rows are numbered inside buckets of the key's first hex digits, which hold equal shares whatever
    the data, and shifted by the number of rows in lower buckets. The offsets have one row per
    (key, bucket); joining on the bucket and numbering inside it use one and the same exchange.
    """
    keys = list(keys)
    digits = digits or (KEYED_HASH_DIGITS if keys else HASH_DIGITS)
    hashed = df.withColumn("_key", shuffle_key(sample, seed, epoch)) \
        .withColumn("_bucket", F.substring("_key", 1, digits))
    counts = hashed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    lower = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    extra = [F.sum("_n").over(whole).alias(total)] if total else []
    offsets = counts.select(*keys, "_bucket",
                            F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"), *extra)
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_key", sample)
    # Every bucket has its offset; as a left join the hash is not computed once more to test for null.
    return (hashed.join(offsets, [*keys, "_bucket"], "left")
            .withColumn(name, F.row_number().over(inside).cast("bigint") - 1 + F.col("_before"))
            .drop("_key", "_bucket", "_before"))


def partition_samples(df: DataFrame, sample: str, fractions, seed: int = 42, epoch: int = 0,
                      shuffle: bool = True, compat: bool = False, max_rows: int = MAX_ROWS,
                      digits: int = HASH_DIGITS) -> DataFrame:
    """Split one permutation of the samples over workers; adds ``pos``, ``rank`` and ``pos_in_rank``.

    ``fractions`` is a number of equal workers or a list of shares that sum to 1. Bounds are exact, of shares
    as fractions with denominators up to a million, and the last worker ends with the table; ``compat`` uses the
    float product instead, which can leave the last samples without a worker (dropped).
    Without ``shuffle`` the samples are taken in id order. ``digits`` sets the number of shuffle
    buckets (16 to that power): raise it where rows / buckets would not fit a task.
    """
    if shuffle:
        placed = hashed_position(df, [], sample, seed, epoch, total="_total", digits=digits)
    else:
        placed = ordinal(df, [], [sample], "pos", max_rows)
        placed = placed.withColumn("_total", df.agg(F.count(F.lit(1))).scalar())
    pos, total = F.col("pos"), F.col("_total")
    if isinstance(fractions, int) and not compat:
        world = fractions
        rank = F.expr(f"((pos + 1) * {world} - 1) div _total")
        placed = placed.withColumn("rank", rank)
        start = F.expr(f"(rank * _total) div {world}")
    else:
        shares = [1.0 / fractions] * fractions if isinstance(fractions, int) else list(fractions)
        if compat:
            ends = [F.floor(F.lit(float(c)) * total).cast("bigint") for c in np.cumsum(shares)]
        else:
            if abs(sum(shares) - 1) > 1e-6 or min(shares) < 0:
                raise ValueError(f"shares must sum to 1: {shares}")
            ends = [F.expr(f"(_total * {c.numerator}) div {c.denominator}") for c in (
                Fraction(float(s)).limit_denominator(SHARE_DENOMINATOR) for s in np.cumsum(shares[:-1]))] + [total]
        rank, start = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
        for end in ends:
            rank = rank + F.when(pos >= end, 1).otherwise(0)
            start = F.when(pos >= end, end).otherwise(start)
        placed = placed.filter(pos < ends[-1]).withColumn("rank", rank)
    return placed.withColumn("pos_in_rank", F.col("pos") - start).drop("_total")


def batches(df: DataFrame, batch_size: int, position: str = "pos_in_rank") -> DataFrame:
    """Adds ``batch_idx`` per worker; the last batch may be short."""
    return df.withColumn("batch_idx", F.floor(F.col(position) / batch_size))


def reshuffled(df: DataFrame, sample: str, seed: int, epoch: int) -> DataFrame:
    """Put each worker's samples in a new order; the partition stays."""
    return hashed_position(df.drop("pos_in_rank"), ["rank"], sample, seed, epoch, name="pos_in_rank")


def limit_batches(df: DataFrame, maximum: int = None) -> DataFrame:
    """The first ``maximum`` batches of each worker, or all."""
    return df if maximum is None else df.filter(F.col("batch_idx") < maximum)


def stride_of(df: DataFrame, sample: str, world: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """Adds ``pos`` in id order and the worker ``rank`` that takes every ``world``-th row."""
    return ordinal(df, [], [sample], "pos", max_rows) \
        .withColumn("rank", F.pmod("pos", F.lit(world)))


def stride(df: DataFrame, sample: str, rank: int, world: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of one worker under the strided split."""
    return stride_of(df, sample, world, max_rows).filter(F.col("rank") == rank)


def partition_stats(df: DataFrame, batch_size: int, label: str = "label") -> DataFrame:
    """Rows, batches and classes per worker."""
    n = F.count(F.lit(1))
    return df.groupBy("rank").agg(n.alias("samples"), F.ceil(n / batch_size).alias("batches"),
                                  F.count_distinct(F.col(label)).alias("classes"))


def dataset_registry(spark) -> DataFrame:
    """Registered datasets with their sizes."""
    return spark.createDataFrame(DATASETS, "name string, n_samples bigint, n_features bigint, sparse boolean")


def check_registry(df: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """Actual against registered size of every dataset in ``df``; unknown and ambiguous names are marked."""
    actual = df.groupBy(name).agg(F.count(F.lit(1)).alias("samples"),
                                  F.max(F.size("features")).cast("bigint").alias("features"))
    known = registry.groupBy("name").agg(F.count(F.lit(1)).alias("_entries"),
                                         F.max("n_samples").alias("n_samples"),
                                         F.max("n_features").alias("n_features"))
    joined = actual.withColumnRenamed(name, "name").join(known, "name", "left")
    verdict = (F.when(F.col("_entries").isNull(), "not found").when(F.col("_entries") > 1, "ambiguous")
               .when((F.col("samples") == F.col("n_samples")) & (F.col("features") == F.col("n_features")), "ok")
               .otherwise("differs"))
    return joined.select("name", "samples", "features", "n_samples", "n_features", verdict.alias("verdict"))


def synthetic_classification(ids: DataFrame, sample: str, n_features: int = 100, informative: int = 90,
                             seed: int = 42) -> DataFrame:
    """Standard normal features per id and a class from the sign of a fixed form of the informative ones.

    Every value is a function of (seed, id, feature), so any executor can recompute any row.
    """
    def uniform(digest, part):
        number = F.conv(F.substring(digest, 1 + 12 * part, 12), 16, 10).cast("double")
        return (number + 1) / float(1 << 48)

    digests = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda j: F.md5(
        F.concat(F.lit(f"{seed}:"), F.col(sample).cast("string"), F.lit(":"), j.cast("string"))))
    normal = F.transform(digests, lambda d: F.sqrt(-2 * F.ln(uniform(d, 0))) * F.cos(2 * float(np.pi) * uniform(d, 1)))
    signed = F.transform(F.slice("features", 1, informative),
                         lambda x, j: F.when(j % 2 == 0, x).otherwise(-x))
    form = F.aggregate(signed, F.lit(0.0), lambda a, b: a + b)
    return (ids.select(F.col(sample).alias("sample_id"), normal.alias("features"))
            .withColumn("label", F.when(form > 0, 1.0).otherwise(0.0)))
