"""Points joined with the spans that hold them, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import intervals
from runlens.operators.intervals import counted_up, in_spans, layered

SPANS = "span_id long, pod long, began long, ended long"
POINTS = "point_id long, pod long, at long"


def spans_of(seed, n, pods, longest):
    draw, out = random.Random(seed), []
    for i in range(n):
        began = draw.randrange(400)
        ended = None if draw.random() < 0.05 else began + draw.randrange(longest)
        out.append((i, draw.choice(pods), None if draw.random() < 0.02 else began, ended))
    return [*out, (n, pods[0], 50, 40), (n + 1, None, 0, 400), (n + 2, pods[0], 7, 7), (n + 2, pods[0], 7, 7)]


def points_of(seed, n, pods):
    draw = random.Random(seed)
    return [(i, draw.choice([*pods, 99, None]), None if draw.random() < 0.02 else draw.randrange(-5, 460)) for i in range(n)]


def brute(points, spans):
    return sorted((p, pod, at, s, b, e or -1) for p, pod, at in points for s, own, b, e in spans
                  if pod is not None and pod == own and at is not None and b is not None and b <= at and (e is None or at <= e))


def run(spark, points, spans, **limits):
    got = in_spans(spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS), "pod", "at", "began", "ended", **limits)
    assert got.columns == ["point_id", "pod", "at", "span_id", "began", "ended"]
    return sorted((*r[:5], r[5] or -1) for r in got.collect())


@pytest.mark.parametrize("longest,limits", [(3, {}), (60, {"few": 0, "max_rows": 40}), (500, {"few": 3, "max_rows": 7})])
def test_all_pairs(spark, longest, limits):
    pods = [1, 1, 1, 2, 3]
    points, spans = points_of(1, 300, pods), spans_of(2, 120, pods, longest)
    assert run(spark, points, spans, **limits) == brute(points, spans)


def test_no_points_or_spans(spark):
    assert run(spark, [], spans_of(3, 40, [1], 9)) == [] and run(spark, points_of(3, 9, [1]), []) == []


def test_tables_stay_linear(spark):
    """A pod that served 2,000 runs one after the other: spans are held about twice, and a point meets two at most."""
    spans = [(i, 1, 10 * i, 10 * i + 9) for i in range(2000)]
    table = spark.createDataFrame(spans, SPANS)
    binned = layered(table, "pod", "began", "ended").collect()
    assert {r["_size"] for r in binned} == {1} and len(binned) == 2000
    nested = layered(spark.createDataFrame([(i, 1, i, 4000 - i) for i in range(2000)], SPANS), "pod", "began", "ended")
    assert nested.count() <= 4000
    long = layered(spark.createDataFrame(spans + [(-1, 1, 0, None)], SPANS), "pod", "began", "ended")
    assert long.count() <= 2 * 2001 and long.groupBy("_bin").count().agg(F.max("count")).first()[0] <= 4


def test_long_ranges_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(intervals, "STEP", 4)
    pairs = spark.createDataFrame([(0, 0, 0), (1, 3, 70), (2, 15, 16), (3, 63, 64)], "id long, a long, b long")
    got = counted_up(pairs, F.col("a"), F.col("b"), "n").groupBy("id").agg(F.sort_array(F.collect_list("n")).alias("all")).collect()
    assert {r.id: r.all for r in got} == {0: [0], 1: list(range(3, 71)), 2: [15, 16], 3: [63, 64]}


def test_plan_has_no_all_pairs(spark):
    """The sweep joins by pod and bin."""
    points, spans = points_of(5, 50, [1]), spans_of(6, 60, [1], 9)
    joined = in_spans(spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS), "pod", "at", "began", "ended")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "_bin" in plan
