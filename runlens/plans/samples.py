"""Sample tables: labels, features, partitions, batches."""

from pyspark.sql import functions as F

from runlens.operators import samples
from runlens.operators.scan import ordinal
from runlens.plans import tables as t
from runlens.plans.registry import query
from runlens.session import new_dir
from runlens.sources.indexed import APPEND_BITS, append_samples, read_indexed
from runlens.sources.tables import read_samples, write_samples
from runlens.plans.tables import LOGISTIC, ORDER_SAMPLES, RIDGE, with_tables

SEED = 42


def placed_sql(world: int, seed: int = SEED, epoch: int = 0, source: str = "orders", key: str = "o_orderkey") -> str:
    """Ranks and positions of an equal split of the permutation."""
    return f"""permuted as (select {key} as id, row_number() over (order by md5('{seed}:{epoch}:' || {key}), {key}) - 1
   as pos, count(*) over () as total from {source}),
 placed as (select id, pos, ((pos + 1) * {world} - 1) // total as rank,
   pos - ((((pos + 1) * {world} - 1) // total) * total) // {world} as pos_in_rank from permuted)"""


def orders(spark, sf):
    return t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))


@query(with_tables(LOGISTIC) + """select order_id, y as label, count(*) as n from logistic group by order_id, y""")
def correct_labels(spark, sf):
    out = samples.correct_binary_labels(t.logistic_samples(spark, sf))
    return out.groupBy("order_id", "label").agg(F.count(F.lit(1)).alias("n"))


MEAN, STD = [0.5, 0.4914, 0.4822], [0.25, 0.2023, 0.1994]


@query(with_tables(RIDGE) + "select rank, " + ", ".join(
    f"round((x{i} - {m}::double) / {s}::double, 9) as x{i}" for i, (m, s) in enumerate(zip(MEAN, STD))) + " from ridge")
def standardize(spark, sf):
    out = samples.standardize(t.ridge_samples(spark, sf), MEAN, STD)
    return out.select("rank", *[F.round(F.col("features")[i], 9).alias(f"x{i}") for i in range(3)])


TRIPLETS = """select id as sample_id, i as idx, v as val from (select vec_id as id, unnest(embedding)::double as v,
 unnest(range(len(embedding))) as i from embeddings) where v <> 0"""


def vectors(spark, sf):
    return t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"),
                                                   F.col("embedding").alias("features"), "label")


@query(TRIPLETS)
def to_triplets(spark, sf):
    return samples.to_triplets(vectors(spark, sf))


@query(with_tables(RIDGE) + """select rank, x0, x1, x2, (x0 <> 0)::bigint + (x1 <> 0)::bigint + (x2 <> 0)::bigint as stored
 from ridge""")
def to_dense(spark, sf):
    sparse = samples.to_sparse(t.ridge_samples(spark, sf)) \
        .withColumn("stored", F.size("entries").cast("bigint"))
    return samples.to_dense(sparse, 3).select(
        "rank", *[F.col("features")[i].alias(f"x{i}") for i in range(3)], "stored")


@query(with_tables(RIDGE) + "select rank, x0::float::double as x0, x1::float::double as x1, y::float::double as y from ridge")
def cast_features(spark, sf):
    out = samples.cast_features(t.ridge_samples(spark, sf), "fp32", force_target=True)
    return out.select("rank", F.col("features")[0].cast("double").alias("x0"),
                      F.col("features")[1].cast("double").alias("x1"), F.col("label").cast("double").alias("y"))


@query("""select o_orderkey as id, row_number() over (order by o_orderkey) - 1 as pos,
 (row_number() over (order by o_orderkey) - 1) % 4 as rank from orders""")
def stride(spark, sf):
    return samples.stride_of(orders(spark, sf), "id", 4).select("id", "pos", "rank")


@query(with_tables(placed_sql(7)) + "select id, pos, rank, pos_in_rank from placed")
def partition_samples(spark, sf):
    return samples.partition_samples(orders(spark, sf), "id", 7, SEED).select("id", "pos", "rank", "pos_in_rank")


@query(with_tables(placed_sql(1)) + """, sized as (select *, count(*) over () as n from placed)
select id, pos, case when pos < n * 7 // 10 then 0 when pos < n * 9 // 10 then 1 else 2 end::bigint as rank from sized""")
def split_samples(spark, sf):
    return samples.partition_samples(orders(spark, sf), "id", [0.7, 0.2, 0.1], SEED).select("id", "pos", "rank")


@query("""with placed as (select o_orderkey as id, row_number() over (order by o_orderkey) - 1 as pos,
 count(*) over () as n from orders) select id, pos, ((pos + 1) * 4 - 1) // n as rank from placed""")
def partition_in_order(spark, sf):
    return samples.partition_samples(orders(spark, sf), "id", 4, shuffle=False).select("id", "pos", "rank")


@query(with_tables(placed_sql(7)) + """select rank, count(*) as samples, cast(ceil(count(*) / 128) as bigint) as batches,
 count(distinct o_orderpriority) as classes from placed join orders on id = o_orderkey group by rank""")
def partition_stats(spark, sf):
    placed = samples.partition_samples(orders(spark, sf), "id", 7, SEED)
    return samples.partition_stats(placed, 128)


@query(with_tables(placed_sql(4)) + "select id, rank, pos_in_rank // 128 as batch_idx from placed")
def batches(spark, sf):
    placed = samples.partition_samples(orders(spark, sf), "id", 4, SEED)
    return samples.batches(placed, 128).select("id", "rank", "batch_idx")


@query(with_tables(placed_sql(4)) + """select id, rank, row_number() over (partition by rank order by md5('42:3:' || id), id) - 1
 as pos_in_rank from placed""")
def reshuffled(spark, sf):
    placed = samples.partition_samples(orders(spark, sf), "id", 4, SEED)
    return samples.reshuffled(placed, "id", SEED, 3).select("id", "rank", "pos_in_rank")


@query(with_tables(placed_sql(4)) + """select rank, pos_in_rank // 128 as batch_idx, count(*) as n from placed
 where pos_in_rank // 128 < 10 group by 1, 2""")
def limit_batches(spark, sf):
    placed = samples.partition_samples(orders(spark, sf), "id", 4, SEED)
    return samples.limit_batches(samples.batches(placed, 128), 10).groupBy("rank", "batch_idx").agg(
        F.count(F.lit(1)).alias("n"))


@query("""with actual as (select 'synthetic-dense' as name, count(*) as samples, 3 as features from lineitem
 union all select 'class-' || label, count(*), max(len(embedding)) from embeddings group by label)
select name, samples, cast(features as bigint) as features,
 case when name = 'synthetic-dense' then 10000 end::bigint as n_samples,
 case when name = 'synthetic-dense' then 100 end::bigint as n_features,
 case when name <> 'synthetic-dense' then 'not found' when samples = 10000 and features = 100 then 'ok'
 else 'differs' end as verdict from actual""")
def check_registry(spark, sf):
    named = t.ridge_samples(spark, sf).select(F.lit("synthetic-dense").alias("name"), "features").unionByName(
        vectors(spark, sf).select(F.concat(F.lit("class-"), F.col("label").cast("string")).alias("name"),
                                  F.col("features").cast("array<double>").alias("features")))
    return samples.check_registry(named, samples.dataset_registry(spark))


def _uniform_sql(part: int) -> str:
    return f"((cast('0x' || substr(md5('42:' || o_orderkey || ':' || j), {1 + 12 * part}, 12) as bigint) + 1)::double / 281474976710656)"


@query(f"""with drawn as (select o_orderkey as sample_id, j, sqrt(-2 * ln({_uniform_sql(0)})) * cos(2 * pi() * {_uniform_sql(1)})
 as x from orders, range(10) r(j))
select sample_id, round(sum(x), 6) as total, round(max(x), 6) as largest,
 case when sum(case when j >= 8 then 0 when j % 2 = 0 then x else -x end) > 0 then 1.0::double else 0.0::double end as label
 from drawn group by sample_id""")
def synthetic_classification(spark, sf):
    ids = t.table(spark, sf, "orders").select("o_orderkey")
    out = samples.synthetic_classification(ids, "o_orderkey", 10, 8, SEED)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return out.select("sample_id", F.round(total, 6).alias("total"),
                      F.round(F.array_max("features"), 6).alias("largest"), "label")


@query("select o_orderkey as id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as pos from orders")
def positions(spark, sf):
    from runlens.operators.scan import micros
    rows = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate")
    return ordinal(rows, ["o_custkey"], ["o_orderdate", "id"]).select("id", "pos")


@query(with_tables(placed_sql(1)) + """, sized as (select *, count(*) over () as n from placed)
select rank, count(*) as samples, min(pos) as first, max(pos) as last from (select pos,
 case when pos < n // 3 then 0 when pos < n * 2 // 3 then 1 else 2 end::bigint as rank from sized) group by rank""")
def partition_thirds(spark, sf):
    """Shares that are no decimal fractions lose no sample."""
    placed = samples.partition_samples(orders(spark, sf), "id", [1 / 3] * 3, SEED)
    return placed.groupBy("rank").agg(F.count(F.lit(1)).alias("samples"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query("select 2 * count(*) as samples, 2 * count(*) as ids from orders")
def samples_two_appends(spark, sf):
    """Samples stored in two appends have an id each."""
    path = new_dir(spark, "samples")
    for _ in range(2):
        write_samples(orders(spark, sf).drop("id"), path, "orders", "train")
    stored = read_samples(spark, path, "orders", "train")
    return stored.agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("sample_id").alias("ids"))


@query("""select o_orderkey, row_number() over (order by o_orderkey % 2, o_orderkey) - 1 as pos, o_orderkey % 2 as number,
 row_number() over (partition by o_orderkey % 2 order by o_orderkey) - 1 as at from orders""")
def samples_indexed(spark, sf):
    """Two sorted appends of several files each; places come from the index, ids from the number of the append."""
    path, rows = new_dir(spark, "samples"), t.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    for odd in (0, 1):
        part = rows.filter(F.col("o_orderkey") % 2 == odd)
        append_samples(part.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey"), path, "orders", "train")
    number = F.shiftright("sample_id", APPEND_BITS)
    return read_indexed(spark, path, "orders", "train").select(
        "o_orderkey", "pos", number.alias("number"), (F.col("sample_id") - F.shiftleft(number, APPEND_BITS)).alias("at"))
