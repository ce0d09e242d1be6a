"""Known values of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from runlens.functions import scalars, schedules, scores


def values(spark, expressions, rows=None, schema="x string"):
    df = spark.createDataFrame(rows if rows is not None else [(None,)], schema)
    return [r[0] for r in df.select(expressions).collect()]


def test_file_names(spark):
    names = ["My cool movie.mov", "../../../etc/passwd", "i contain cool \xfcml\xe4uts.txt", "  a\t b\nc ", "漢字",
             "ﬁle² ½", None, "._x._"]
    assert values(spark, scalars.safe_file_name(F.col("x")), [(n,) for n in names]) == [
        "My_cool_movie.mov", "etc_passwd", "i_contain_cool_umlauts.txt", "a_b_c", "", "file2_12", None, "x"]


def test_cpu_quantities(spark):
    assert values(spark, scalars.cpu_quantity(F.col("x")), [("2.5",), ("12",)]) == ["2500.0m", "12000.0m"]
    assert values(spark, scalars.cpu_cores(F.col("x")), [("12000m",), ("2500.0m",), ("8",), ("bad",)]) == [12.0, 2.5, 8.0, None]


def test_instants(spark):
    texts = ["2018-08-14T09:21:44Z", "2018-08-14T09:21:44.331823Z", "2018-08-14 09:21:44.5", "2018-08-14T11:21:44+02:00",
             "yesterday", "2018", None]
    got = values(spark, scalars.format_instant(scalars.parse_instant(F.col("x"))), [(t,) for t in texts])
    assert got == ["2018-08-14T09:21:44.000000Z", "2018-08-14T09:21:44.331823Z", "2018-08-14T09:21:44.500000Z",
                   "2018-08-14T09:21:44.000000Z", None, None, None]


def test_flags_numbers_values(spark):
    assert values(spark, scalars.parse_flag(F.col("x")), [("False",), ("true",), ("maybe",)]) == [False, True, None]
    assert values(spark, scalars.number(F.col("x")), [("1.5",), ("x",), (None,)]) == [1.5, None, None]
    assert values(spark, scalars.value_text(F.lit(0.1234567))) == ["0.123457"]


def test_labels(spark):
    got = values(spark, scalars.label_map(F.col("x")), [("{'app': 'bench', 'component': 'worker'}",), ("app=bench,component=worker",)])
    assert got == [{"app": "bench", "component": "worker"}] * 2
    has = scalars.has_labels(scalars.label_map(F.col("x")), "app=bench,component=worker")
    assert values(spark, has, [("app=bench,component=worker,z=1",), ("app=bench",), ("app=b,component=worker",)]) == [True, False, False]


def test_checkpoint_names(spark):
    assert values(spark, scalars.run_dir(F.col("x"), F.lit("set"), F.lit("net"), F.lit("sgd")), [("7",), ("a_b",)]) == ["7_set_net_sgd", None]
    assert values(spark, scalars.run_of_dir(F.col("x")), [("7_set_net_sgd",)]) == ["7"]
    assert values(spark, F.struct(scalars.checkpoint_epoch(F.col("x")), scalars.checkpoint_rank(F.col("x"))),
                  [("10_3.pth.tar",), ("model_best.pth.tar",)]) == [(10, 3), (None, None)]


def rates(spark, fn, steps):
    return [r[0] for r in spark.createDataFrame([(s,) for s in steps], "s bigint").select(fn(F.col("s"))).collect()]


def test_multistep_with_warmup(spark):
    lr, start = schedules.initial_rates(lr_per_sample=0.1, batch_size=32)
    got = rates(spark, lambda s: schedules.multistep(s, lr, [82, 109], 0.1, 5, start, 11), [0, 5, 81, 82, 108, 109])
    assert got == pytest.approx([3.2, 35.2, 35.2, 3.52, 3.52, 0.352])


def test_schedule_arguments():
    s = None
    with pytest.raises(ValueError):
        schedules.multistep(s, 0.1, [5, 3])
    with pytest.raises(ValueError):
        schedules.multistep(s, 0.1, [5], warmup=5)
    with pytest.raises(ValueError):
        schedules.cyclical(s, 0.1, 1, 10, "square")
    with pytest.raises(ValueError):
        schedules.initial_rates(lr=1, lr_per_sample=1, batch_size=1)
    with pytest.raises(ValueError):
        schedules.schedule("other", s)


def test_single_milestone_without_warmup(spark):
    assert rates(spark, lambda s: schedules.multistep(s, 1.0, 3), [0, 2, 3]) == pytest.approx([1, 1, 0.1])


@pytest.mark.parametrize("mode", schedules.CYCLICAL_MODES)
def test_cyclical(spark, mode):
    """A period of 20 begins and ends at the low rate and has its peak in the middle, with straight lines between; peaks
    differ by mode."""
    low, high = 0.01, 0.5
    got = rates(spark, lambda s: schedules.cyclical(s, low, high, 20, mode), list(range(61)))
    tops = {"triangular2": [1, 0.5, 0.25]}.get(mode, [1, 1, 1])
    for n, top in enumerate(tops[:1] if mode == "one_cycle" else tops):
        period = got[20 * n:20 * n + 21]
        share = [(r - low) / (high - low) for r in period]
        if mode == "exp_range":
            share = [x / 0.99 ** (20 * n + i) for i, x in enumerate(share)]
        assert share[0] == pytest.approx(0) and share[10] == pytest.approx(top) and share[20] == pytest.approx(0)
        assert [y - x for x, y in zip(share, share[1:])] == pytest.approx([top / 10] * 10 + [-top / 10] * 10)
    if mode == "one_cycle":
        assert got[21:] == pytest.approx([low * 0.1] * 40)


def test_own_amplitude(spark):
    assert rates(spark, lambda s: schedules.cyclical(s, 0.0, 1.0, 2, scale_fn=lambda c, i: F.lit(0.5)), [1]) == [0.5]


BLANK = dict.fromkeys(c.split()[0] for c in schedules.CONFIGURATION.split(", "))


def configured(spark, *rows):
    table = spark.createDataFrame([tuple((BLANK | r).values()) for r in rows], schedules.CONFIGURATION)
    from runlens.operators.progress import schedule_table
    found = schedule_table(table.withColumn("run_id", F.monotonically_increasing_id()), ["schedule", "mode", "run_id"])
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.run_id, r.step)):
        out.setdefault(r.run_id, []).append(r.lr)
    return list(out.values())


def test_configurations_are_the_single_schedules(spark):
    steps = list(range(30))
    got = configured(
        spark, {"schedule": "const", "steps": 30, "lr": 0.5},
        {"schedule": "MultiStepLRW", "steps": 30, "lr_per_sample": 0.01, "batch_size": 10, "workers": 4, "milestones": [8.0, 20.0], "warmup": 5.0},
        {"schedule": "MultiStepLRW", "steps": 30, "lr": 1.0, "gamma": 0.5, "milestones": [3.0]},
        {"schedule": "MultiStepLRW", "steps": 30, "lr": 1.0},
        *[{"schedule": "CLR", "steps": 30, "lr": 0.1, "max_lr": 0.9, "length": 7.0, "mode": m} for m in schedules.CYCLICAL_MODES])
    want = [lambda s: schedules.constant(s, 0.5), lambda s: schedules.multistep(s, 0.1, [8, 20], warmup=5, warmup_start=0.1, scale=4),
            lambda s: schedules.multistep(s, 1.0, 3, 0.5), lambda s: schedules.multistep(s, 1.0, []),
            *[lambda s, m=m: schedules.cyclical(s, 0.1, 0.9, 7, m) for m in schedules.CYCLICAL_MODES]]
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(rates(spark, b, steps))


@pytest.mark.parametrize("wrong", [{"schedule": "other"}, {"schedule": "MultiStepLRW", "lr": 1.0, "milestones": [5.0, 2.0]}, {
    "schedule": "MultiStepLRW", "lr": 1.0, "milestones": [5.0], "warmup": 5.0}, {"schedule": "MultiStepLRW", "lr": 1.0, "lr_per_sample": 1.0, "batch_size": 1}, {
    "schedule": "CLR", "lr": 1.0, "max_lr": 2.0, "length": 4.0, "mode": "square"}])
def test_wrong_configurations(spark, wrong):
    with pytest.raises(Exception, match="unknown schedule|milestones must|needs a known mode"):
        configured(spark, {"steps": 2} | wrong)


def test_scores(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9, 0.3], 2), ([5.0, 1.0, 2.0, 3.0], 0)], "s array<double>, l int")
    assert [r[0] for r in df.select(scores.top_classes(F.col("s"), 3)).collect()] == [[1, 2, 3], [0, 3, 2]]
    for k in (1, 2, 4):
        got = [r[0] for r in df.select(scores.in_top(F.col("s"), F.col("l"), k)).collect()]
        want = [r[0] for r in df.select(F.array_contains(scores.top_classes(F.col("s"), k), F.col("l")).cast("double")).collect()]
        assert got == want
    ce = [r[0] for r in df.select(scores.cross_entropy(F.col("s"), F.col("l"))).collect()]
    assert ce[1] == pytest.approx(math.log(sum(math.exp(v) for v in (5, 1, 2, 3))) - 5)


def test_losses_are_stable(spark):
    df = spark.createDataFrame([(800.0, 0.0), (-800.0, 1.0), (800.0, 1.0)], "z double, y double")
    assert [r[0] for r in df.select(scores.bce(F.col("z"), F.col("y"))).collect()] == [800.0, 800.0, 0.0]
    with pytest.raises(ValueError):
        scores.loss_pair("hinge")


def test_wide_dot(spark):
    n = scores.UNROLL + 5
    df = spark.range(1).select(F.array(*[F.lit(float(i)) for i in range(n)]).alias("x"))
    assert df.select(scores.dot(F.col("x"), [2.0] * n)).first()[0] == 2.0 * sum(range(n))
