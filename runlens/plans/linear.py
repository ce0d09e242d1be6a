"""Linear models: scores, losses, gradients, training, evaluation."""

from pyspark.sql import functions as F

from runlens.functions.schedules import multistep
from runlens.functions.scores import top_classes
from runlens.operators import linear, samples
from runlens.operators.collective import elementwise
from runlens.plans import tables as t
from runlens.plans.registry import query
from runlens.plans.samples import placed_sql
from runlens.plans.tables import LOGISTIC, ORDER_SAMPLES, RIDGE, with_tables

W3 = [0.8, -0.05, 0.02]
W4 = [0.1, -0.2, 0.3, -0.4]
L1, L2 = 0.001, 0.01


def _z(w):
    return "(" + " + ".join(f"x{i} * {v}::double" for i, v in enumerate(w)) + ")"


def _penalty(w):
    return L2 / 2 * sum(v * v for v in w) + L1 * sum(abs(v) for v in w)


def logistic(spark, sf):
    return samples.correct_binary_labels(t.logistic_samples(spark, sf))


@query(with_tables(LOGISTIC) + f"select order_id, rank, round(1 / (1 + exp(-{_z(W4)})), 9) as score from logistic")
def predict_logistic(spark, sf):
    return linear.predict_logistic(t.logistic_samples(spark, sf), W4).select(
        "order_id", "rank", F.round("score", 9).alias("score"))


@query(with_tables(RIDGE) + f"select rank, round({_z(W3)}, 9) as score from ridge")
def predict_ridge(spark, sf):
    return linear.predict_ridge(t.ridge_samples(spark, sf), W3).select("rank", F.round("score", 9).alias("score"))


_BCE = f"ln(1 + exp(-abs({_z(W4)}))) + greatest({_z(W4)}, 0) - {_z(W4)} * y"


@query(with_tables(LOGISTIC) + f"select count(*) as n, round(avg({_BCE}) + {_penalty(W4)}::double, 9) as loss from logistic")
def loss_bce(spark, sf):
    return linear.loss(logistic(spark, sf), W4, "BCE", L1, L2).withColumn("loss", F.round("loss", 9))


@query(with_tables(RIDGE) + f"select count(*) as n, round(avg(({_z(W3)} - y) ** 2) + {_penalty(W3)}::double, 9) as loss from ridge")
def loss_mse(spark, sf):
    return linear.loss(t.ridge_samples(spark, sf), W3, "MSE", L1, L2).withColumn("loss", F.round("loss", 9))


def _gradient_sql(source, slope, w):
    rows = " union all ".join(
        f"select {i}::bigint as idx, round(avg(g{i}) + {L2 * v + L1 * (v > 0) - L1 * (v < 0)}::double, 9) as grad from per_rank"
        for i, v in enumerate(w))
    means = ", ".join(f"avg({slope} * x{i}) as g{i}" for i in range(len(w)))
    return f", per_rank as (select rank, {means} from {source} group by rank) {rows}"


@query(with_tables(LOGISTIC) + _gradient_sql("logistic", f"(1 / (1 + exp(-{_z(W4)})) - y)", W4))
def gradient_logistic(spark, sf):
    return linear.gradient(logistic(spark, sf), W4, "BCE", L1, L2).withColumn("grad", F.round("grad", 9))


@query(with_tables(RIDGE) + _gradient_sql("ridge", f"(2 * ({_z(W3)} - y))", W3))
def gradient_ridge(spark, sf):
    return linear.gradient(t.ridge_samples(spark, sf), W3, "MSE", L1, L2).withColumn("grad", F.round("grad", 9))


@query(with_tables(ORDER_SAMPLES, placed_sql(4)) + """, joined as (select rank, x0, x1, x2, y,
  (x0 * 0.3::double + x1 * 0.1::double + x2 * 0.2::double) as z from order_samples join placed on id = sample_id),
 per_rank as (select rank, avg(2 * (z - y) * x0) as g0, avg(2 * (z - y) * x1) as g1, avg(2 * (z - y) * x2) as g2
  from joined group by rank)
""" + " union all ".join(f"select {i}::bigint as idx, round(avg(g{i}) + {L2 * v + L1}::double, 9) as grad from per_rank"
                         for i, v in enumerate([0.3, 0.1, 0.2])))
def gradient_sparse(spark, sf):
    placed = samples.partition_samples(t.order_samples(spark, sf), "sample_id", 4)
    weights = t.table(spark, sf, "orders").agg(F.array(F.lit(0.3), F.lit(0.1), F.lit(0.2)).alias("w")) \
        .select(F.posexplode("w").alias("idx", "value")).withColumn("idx", F.col("idx").cast("bigint"))
    return linear.gradient_table(samples.to_triplets(placed), placed.select("sample_id", "label", "rank"), weights,
                                 "MSE", L1, L2).withColumn("grad", F.round("grad", 9))


@query("""select vec_id, round(sum(abs(v)), 6) as norm1, round(sum(v * v), 6) as norm2_squared
 from (select vec_id, unnest(embedding)::double as v from embeddings) group by vec_id""")
def norms(spark, sf):
    weights = t.table(spark, sf, "embeddings").select("vec_id", F.explode("embedding").alias("value")) \
        .withColumn("value", F.col("value").cast("double"))
    out = linear.norms(weights, ["vec_id"])
    return out.select("vec_id", F.round("norm1", 6).alias("norm1"), F.round("norm2_squared", 6).alias("norm2_squared"))


@query("""with cur as (select vec_id as idx, embedding[1]::double as value, embedding[2]::double as buffer,
  embedding[3]::double + 0.01::double * embedding[1]::double as g from embeddings)
select idx, round(value - 0.1::double * (g + 0.9::double * (0.9::double * buffer + g)), 9) as value,
 round(0.9::double * buffer + g, 9) as buffer from cur""")
def sgd_step(spark, sf):
    v = t.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("idx"), *[F.col("embedding")[i].cast("double").alias(n)
                                        for i, n in enumerate(("value", "buffer", "grad"))])
    out = linear.sgd_table(v.select("idx", "value", "buffer"), v.select("idx", "grad"), 0.1, 0.9, 0.01, True)
    return out.select("idx", F.round("value", 9).alias("value"), F.round("buffer", 9).alias("buffer"))


CLASSES = 10
SCORES = """centroids as (select label as c, i, avg(v) as m from (select label, unnest(embedding)::double as v,
   unnest(range(len(embedding))) as i from embeddings) group by 1, 2),
 elements as (select vec_id, label, unnest(embedding)::double as v, unnest(range(len(embedding))) as i from embeddings),
 scores as (select vec_id, label, c, sum(v * m) as s from elements join centroids using (i) group by 1, 2, 3),
 ranked as (select *, row_number() over (partition by vec_id order by s desc, c) as k from scores)"""


def class_scores(spark, sf):
    """Scores of every vector against the class means; one small row of means for all classes."""
    vectors = t.table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = elementwise(vectors, ["label"], "v", "mean", 64)
    table = means.agg(F.array_sort(F.collect_list(F.struct("label", "v"))).alias("m")).scalar()
    scores = F.transform(F.col("_means"), lambda e: F.aggregate(
        F.zip_with(F.col("v"), e["v"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    return vectors.withColumn("_means", table).select("vec_id", "label", scores.alias("scores"))


@query(with_tables(SCORES) + "select vec_id, k::bigint as place, c as class from ranked where k <= 5")
def topk_classes(spark, sf):
    return class_scores(spark, sf).select("vec_id", F.posexplode(top_classes(F.col("scores"), 5)).alias("p", "class")) \
        .select("vec_id", (F.col("p") + 1).cast("bigint").alias("place"), "class")


@query(with_tables(SCORES) + """select round(100 * avg((k <= 1)::int), 6) as prec_1, round(100 * avg((k <= 5)::int), 6) as prec_5
 from ranked where c = label""")
def topk_accuracy(spark, sf):
    out = linear.topk_accuracy(class_scores(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(with_tables(SCORES) + """select count(*) as n, round(avg(l), 6) as loss from (
 select vec_id, ln(sum(exp(s))) - max(case when c = label then s end) as l from scores group by vec_id)""")
def cross_entropy(spark, sf):
    return linear.cross_entropy_loss(class_scores(spark, sf)).withColumn("loss", F.round("loss", 6))


@query(with_tables(LOGISTIC) + f"""select count(*) as n, round(avg({_BCE}) + {_penalty(W4)}::double, 9) as val_loss,
 round(100 * avg((({_z(W4)} > 0) = (y > 0.5))::int), 6) as hits from logistic""")
def validate(spark, sf):
    hits = {"hits": lambda z, y: F.when((z > 0) == (y > 0.5), 100.0).otherwise(0.0)}
    out = linear.validate(logistic(spark, sf), W4, "BCE", L1, L2, hits)
    return out.select("n", F.round("val_loss", 9).alias("val_loss"), F.round("hits", 6).alias("hits"))


WORLD, START, LR, MOMENTUM, DECAY = 4, [0.0, 0.0, 0.0], 0.1, 0.9, 0.0001


def _training_sql(epochs: int, steps: int) -> str:
    """Every step of training on batches of a third of a worker's rows, as one query per step."""
    parts = [ORDER_SAMPLES, placed_sql(WORLD),
             f"""laid as (select rank, x0, x1, x2, y, pos_in_rank // (select ceil(count(*) / {WORLD * steps}.0)::bigint
   from orders) as batch from order_samples join placed on id = sample_id)""",
             "w0 as (select 0.0::double as a0, 0.0::double as a1, 0.0::double as a2, 0.0::double as b0, 0.0::double as b1, 0.0::double as b2)"]
    step = 0
    for _ in range(epochs):
        for batch in range(steps):
            z = "(x0 * a0 + x1 * a1 + x2 * a2 - y)"
            means = ", ".join(f"avg(2 * {z} * x{i}) as g{i}" for i in range(3))
            parts.append(f"""r{step} as (select rank, avg({z} ** 2) as loss, {means} from laid, w{step}
   where batch = {batch} group by rank)""")
            parts.append(f"""s{step} as (select avg(loss) as loss, avg(g0) as g0, avg(g1) as g1, avg(g2) as g2 from r{step})""")
            g = [f"(g{i} + {DECAY}::double * a{i})" for i in range(3)]
            b = [f"({MOMENTUM}::double * b{i} + {g[i]})" for i in range(3)]
            new = ", ".join(f"a{i} - {LR}::double * ({g[i]} + {MOMENTUM}::double * {b[i]}) as a{i}, {b[i]} as b{i}"
                            for i in range(3))
            parts.append(f"w{step + 1} as (select {new} from w{step}, s{step})")
            step += 1
    rows = [f"select {n + 1}::bigint as step, 'train_loss' as name, round(loss, 9) as value from s{n}" for n in range(step)]
    rows += [f"select {step}::bigint, 'w{i}', round(a{i}, 9) from w{step}" for i in range(3)]
    return with_tables(*parts) + " union all ".join(rows)


def settings(spark, sf, epochs, steps, mode="exact"):
    count = t.table(spark, sf, "orders").count()
    return linear.Training("MSE", WORLD, -(-count // (WORLD * steps)), epochs, LR, momentum=MOMENTUM,
                           weight_decay=DECAY, nesterov=True, mode=mode)


def outcome(spark, state, history):
    """Training losses and final weights as one table."""
    weights = linear.weights_table(spark, state.weights).select(
        F.lit(state.steps).cast("bigint").alias("step"),
        F.concat(F.lit("w"), F.col("idx").cast("string")).alias("name"), F.round("value", 9).alias("value"))
    return history.filter(F.col("name") == "train_loss").select("step", "name", F.round("value", 9).alias("value")) \
        .unionByName(weights)


@query(_training_sql(2, 3))
def train_ridge(spark, sf):
    state, history = linear.train(t.order_samples(spark, sf), None, START, settings(spark, sf, 2, 3))
    return outcome(spark, state, history)


@query(_training_sql(3, 4))
def train_ridge_moments(spark, sf):
    state, history = linear.train(t.order_samples(spark, sf), None, START, settings(spark, sf, 3, 4, "moments"))
    return outcome(spark, state, history)


def _logistic_sql(epochs: int) -> str:
    """Full-batch training on the first 80 % of the permutation, evaluated on the rest."""
    parts = [ORDER_SAMPLES, placed_sql(1), f"""split as (select x0, x1, x2, case when class < '3' then 1.0::double else 0.0::double end as y,
   pos >= total * 8 // 10 as held, ((pos + 1) * {WORLD} - 1) // (total * 8 // 10) as rank
   from (select *, count(*) over () as total from placed) join order_samples on id = sample_id)""",
             "w0 as (select 0.0::double as a0, 0.0::double as a1, 0.0::double as a2)"]
    z = "(x0 * a0 + x1 * a1 + x2 * a2)"
    bce = f"ln(1 + exp(-abs({z}))) + greatest({z}, 0) - {z} * y"
    size = "0.0005::double * (a0 * a0 + a1 * a1 + a2 * a2)"
    rows = []
    for n in range(epochs):
        means = ", ".join(f"avg((1 / (1 + exp(-{z})) - y) * x{i}) as g{i}" for i in range(3))
        parts.append(f"r{n} as (select rank, avg({bce} + {size}) as loss, {means} from split, w{n} where not held group by rank)")
        parts.append(f"s{n} as (select avg(loss) as loss, avg(g0) as g0, avg(g1) as g1, avg(g2) as g2 from r{n})")
        parts.append(f"w{n + 1} as (select " + ", ".join(
            f"a{i} - 0.5::double * (g{i} + 0.001::double * a{i}) as a{i}" for i in range(3)) + f" from w{n}, s{n})")
        at = f"{n}::bigint as epoch, {n + 1}::bigint as step"
        rows += [f"select {at}, 'train_loss' as name, round(loss, 9) as value from s{n}", f"select {at}, 'lr', 0.5::double",
                 f"select {at}, 'val_loss', round(avg({bce} + {size}), 9) from split, w{n + 1} where held",
                 f"select {at}, 'hits', round(100 * avg((({z} > 0) = (y > 0.5))::int), 9) from split, w{n + 1} where held"]
    return with_tables(*parts) + " union all ".join(rows)


@query(_logistic_sql(3))
def train_logistic(spark, sf):
    data = t.order_samples(spark, sf).withColumn("label", F.when(F.col("class") < "3", 1.0).otherwise(0.0))
    split = samples.partition_samples(data, "sample_id", [0.8, 0.2])
    keep = ["sample_id", "features", "label"]
    cfg = linear.Training("BCE", WORLD, 1 << 30, 3, 0.5, "epoch", l2=0.001,
                          metrics={"hits": lambda z, y: F.when((z > 0) == (y > 0.5), 100.0).otherwise(0.0)})
    _, history = linear.train(split.filter("rank = 0").select(*keep), split.filter("rank = 1").select(*keep), START, cfg)
    return history.select("epoch", "step", "name", F.round("value", 9).alias("value"))


@query(with_tables(RIDGE, "w0 as (select 0.0::double as a0, 0.0::double as a1, 0.0::double as a2)", *[
    part for n in range(4) for part in (
        f"r{n} as (select rank, " + ", ".join(
            f"sum(2 * (x0 * a0 + x1 * a1 + x2 * a2 - y) * x{i}) as g{i}" for i in range(3)) + f" from ridge, w{n} group by rank)",
        f"w{n + 1} as (select " + ", ".join(f"any_value(a{i}) - 1e-6::double * avg(g{i}) as a{i}" for i in range(3))
        + f" from r{n}, w{n})")]) + " union all ".join(f"select {i}::bigint as idx, round(a{i}, 9) as value from w4" for i in range(3)))
def train_local_sgd(spark, sf):
    weights = linear.train_local_sgd(t.ridge_samples(spark, sf), START, 4, 1e-6)
    return linear.weights_table(spark, weights).withColumn("value", F.round("value", 9))


# Both sides of the width up to which dot products are written out: all 64 values of a vector, and one more.
WIDE = [round(((i * 37) % 11 - 5) / 50, 2) for i in range(65)]
WIDE_SQL = """wide as (select vec_id, 64 as width, vec_id % 4 as rank, embedding::double[] as x,
  case when vec_id % 10 > 0 then label::double end as y from embeddings
 union all select vec_id, 65, vec_id % 4, list_append(embedding::double[], 1.0::double),
  case when vec_id % 10 > 0 then label::double end from embeddings),
 scored as (select *, list_dot_product(x, (""" + str(WIDE) + """::double[])[1:width]) as z from wide)"""


def wide_samples(spark, sf, width):
    x = F.col("embedding").cast("array<double>")
    x = x if width == 64 else F.array_append(x, F.lit(1.0))
    return t.table(spark, sf, "embeddings").select(
        "vec_id", (F.col("vec_id") % 4).cast("int").alias("rank"), x.alias("features"),
        F.when(F.col("vec_id") % 10 > 0, F.col("label").cast("double")).alias("label"))


@query(with_tables(WIDE_SQL) + "select vec_id, width, round(z, 6) as score from scored")
def predict_wide(spark, sf):
    parts = [linear.predict_ridge(wide_samples(spark, sf, n), WIDE[:n]).select(
        "vec_id", F.lit(n).alias("width"), F.round("score", 6).alias("score")) for n in (64, 65)]
    return parts[0].unionByName(parts[1])


@query(with_tables(WIDE_SQL) + """, each as (select width, rank, 2 * (z - y) as slope, unnest(x) as x,
  unnest(range(width)) as idx from scored where y is not null),
 ranks as (select width, rank, idx, avg(slope * x) as g from each group by all)
select width, idx, round(avg(g), 6) as grad from ranks group by width, idx""")
def gradient_wide(spark, sf):
    """Rows without label count nowhere, and workers may be numbered by 32-bit integers, at any width."""
    parts = [linear.gradient(wide_samples(spark, sf, n), WIDE[:n], "MSE").select(
        F.lit(n).alias("width"), "idx", F.round("grad", 6).alias("grad")) for n in (64, 65)]
    return parts[0].unionByName(parts[1])
