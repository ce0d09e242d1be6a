import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import pivots


def brute(rows, k=20, every=20):
    held = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in held]
    out = []
    for at, (query, q) in enumerate(whole):
        if query is None or query % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, c)), i is None, i or 0, n) for n, (i, c) in enumerate(whole) if n != at)
        out += [(query, rank, None if none else i, -score) for rank, (score, none, i, _) in enumerate(found[:k], 1)]
    return in_order(out)


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0], r[1], r[3], r[2] is not None, r[2]))


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit("x") for c in ("row", "rank", "score", "far", "home", "vector", "block", "least", "hits")})


def check(spark, rows, **parameters):
    assert in_order(pivots.top_k(table(spark, rows), **parameters).collect()) == brute(rows, parameters.get("k", 20))


def clustered(n, width, seed):
    rng = np.random.RandomState(seed)
    centers = rng.randn(5, width)
    return [(i, (centers[i % 5] + 0.2 * rng.randn(width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("parameters", [{"block": 16, "queries": 3, "pivots": 7}, {"k": 3, "block": 32, "pivots": 1, "sample": 5}])
def test_agrees_with_brute_force(spark, parameters):
    check(spark, clustered(203, 8, 1), **parameters)


def test_ties_and_repeated_rows(spark):
    rows = [(i % 60, [1.0, float(i % 2), 0.0]) for i in range(150)] + [(None, [1.0, 1.0, 0.0])] * 3
    check(spark, rows, block=16, queries=4)


def test_one_vector_holds_most_rows(spark):
    rows = [(i, [0.5, -0.25]) for i in range(300)] + clustered(40, 2, 2)
    check(spark, rows, block=32, queries=8)


def test_vectors_that_take_no_part(spark):
    odd = [None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [1.0, -float("inf")]]
    rows = [(20 * i, v) for i, v in enumerate(odd)] + [(i, [i / 10, 1.0]) for i in range(30)]
    check(spark, rows)


def test_fewer_candidates_than_asked_for(spark):
    check(spark, [(0, [1.0]), (20, [2.0]), (3, [-1.0])])
    check(spark, [])


def test_unequal_lengths_count_as_zeros(spark):
    check(spark, [(0, [1.0, 2.0, 3.0]), (20, [1.0]), (40, []), (1, [0.0, 5.0]), (2, [0.0, 0.0, 0.0, 9.0])])


def test_large_scores_are_exact_and_larger_ones_an_error(spark):
    check(spark, [(i, [1e6 + i, -1e6 + 3 * i, 0.015625 * i]) for i in range(45)], block=8, queries=2)
    with pytest.raises(Exception, match="do not fit 64 bits"):
        pivots.top_k(table(spark, [(0, [1e30])])).collect()


def test_bounds_are_never_below_scores():
    rng = np.random.RandomState(3)
    for scale in (1, 1000, 2 ** 20):
        c, base = np.floor(scale * rng.randn(400, 16)), np.floor(scale * rng.randn(9, 16))
        far = pivots.distances(c, base).astype(np.float32)
        bounds = pivots.upper_bounds(c[:50], far[:50], c, far)
        assert (bounds >= c[:50] @ c.T).all()
        assert (bounds < (c[:50] ** 2).sum(1)[:, None] / 2 + (c ** 2).sum(1) / 2).any()


def test_elimination_stops_early():
    """Far clusters are ruled out by bounds: the block is not scored to its end."""
    rng = np.random.RandomState(4)
    c = np.floor(np.concatenate([rng.randn(100, 4) + 300, rng.randn(4000, 4) - 300]))
    far = pivots.distances(c, c[[0, 2000]]).astype(np.float32)
    scored, real = [], pivots.scores
    pivots.scores = lambda q, some: scored.append(len(some)) or real(q, some)
    try:
        i, j, s = pivots.search_block(c[:3], far[:3], np.arange(3), np.full(3, -np.inf), c, far, np.arange(len(c)),
                                      np.arange(len(c)), 20)
    finally:
        pivots.scores = real
    assert sum(scored) <= 2 * pivots.STEP and len(i) == 60


def test_query_agrees_with_brute_force(spark, sf):
    from runlens.llm.queries import QUERIES
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert in_order(QUERIES["op12_pivot_search"](spark, sf).collect()) == brute(rows)
