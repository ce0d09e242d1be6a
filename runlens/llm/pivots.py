"""Exact top-k search by inner product: distances to pivots bound every score, candidates are taken in the order of bounds."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from runlens.llm.tables import ranked, settle

SCALE = 64
# Pivots, and the sample they are chosen from: rows with the smallest hashes of their number.
PIVOTS = 32
SAMPLE = 4096
# Rows of a block of candidates and of queries.
BLOCK = 2048
QUERIES = 512
# Candidates that are scored before the bounds are looked at again.
STEP = 256
# Components beyond this could make an inner product exceed 64 bits.
LARGEST = 1 << 26


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither it nor any component is null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def pivots_of(rows: DataFrame, pivots: int, sample: int) -> np.ndarray:
    """Vectors of the sample that lie far from each other: each next one has the largest distance to those chosen."""
    held = rows.orderBy(F.xxhash64("row"), "row").limit(sample).select("vector").collect()
    vectors = padded([r.vector for r in held])
    chosen, least = [], np.full(len(vectors), np.inf)
    while len(chosen) < min(pivots, len(vectors)):
        at = int(np.argmax(least))
        if chosen and least[at] <= 0:
            break
        chosen.append(at)
        least = np.minimum(least, ((vectors - vectors[at]) ** 2).sum(1))
    return vectors[chosen]


def padded(vectors, width: int = None) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros."""
    width = max([0, *map(len, vectors)]) if width is None else width
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances; the squares are sums of differences, so nothing cancels."""
    out = np.empty((len(vectors), len(pivots)))
    for i, p in enumerate(pivots):
        out[:, i] = np.sqrt(((vectors - p) ** 2).sum(1))
    return out


def index(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (row, vec_id, asks, vector) with home, the nearest pivot, and distances to all pivots (floats, as bytes)."""
    kind, width = rows.schema["vec_id"].dataType.simpleString(), pivots.shape[1]

    def place(batches):
        for batch in batches:
            vectors = padded(batch.column("vector").to_pylist(), width)
            if vectors.size and np.abs(vectors).max() > LARGEST:
                raise ValueError(f"components of more than {LARGEST} have inner products that do not fit 64 bits")
            far = distances(vectors, pivots)
            home = far.argmin(1) if far.size else np.zeros(len(vectors), int)
            near = far[np.arange(len(far)), home] if far.size else np.zeros(len(vectors))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), batch.column("asks"),
                 pa.array([v.tobytes() for v in vectors.astype(np.int32)], pa.binary()),
                 pa.array([v.tobytes() for v in far.astype(np.float32)], pa.binary()),
                 pa.array(home, pa.int32()), pa.array(near, pa.float64())],
                ["row", "vec_id", "asks", "vector", "far", "home", "near"])

    return settle(rows.mapInArrow(place, f"row long, vec_id {kind}, asks boolean, vector binary, far binary, home int, "
                                         "near double"), "index")


def blocks(rows: DataFrame, size: int, label: str) -> DataFrame:
    """``rows`` of an index packed by ``size``: block, least and largest distances to the pivots (low, high), the largest
    squared length (norm), and the vectors, distances, numbers and ids of its rows. Rows of a block are neighbours in the
    order of home pivot and distance to it."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def pack(batches):
        rest = None

        def packed(part):
            vectors = part.column("vector").to_pylist()
            far = np.stack([np.frombuffer(v, np.float32) for v in part.column("far").to_pylist()])
            return pa.RecordBatch.from_arrays(
                [pa.array([far.min(0)], pa.list_(pa.float32())), pa.array([far.max(0)], pa.list_(pa.float32())),
                 pa.array([max(float((np.frombuffer(v, np.int32).astype(np.float64) ** 2).sum()) for v in vectors)]),
                 pa.array([b"".join(vectors)], pa.binary()), pa.array([far.tobytes()], pa.binary()),
                 pa.array([part.column("row").to_pylist()], pa.list_(pa.int64())),
                 pa.ListArray.from_arrays([0, part.num_rows], part.column("vec_id").combine_chunks())],
                ["low", "high", "norm", "vectors", "far", "rows", "ids"])

        for batch in batches:
            new = pa.Table.from_batches([batch])
            rest = new if rest is None else pa.concat_tables([rest, new])
            while rest.num_rows >= size:
                yield packed(rest.slice(0, size))
                rest = rest.slice(size)
        if rest is not None and rest.num_rows:
            yield packed(rest)

    ordered = rows.repartitionByRange("home", "near", "row").sortWithinPartitions("home", "near", "row")
    found = ordered.select("row", "vec_id", "vector", "far").mapInArrow(
        pack, f"low array<float>, high array<float>, norm double, vectors binary, far binary, rows array<long>, ids array<{kind}>")
    return settle(found.withColumn("block", F.monotonically_increasing_id()), label)


def unpacked(row, width: int, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(row["rows"])
    return (np.frombuffer(row["vectors"], np.int32).reshape(n, width).astype(np.float64),
            np.frombuffer(row["far"], np.float32).reshape(n, n_pivots), np.array(row["rows"], np.int64))


def upper_bounds(q: np.ndarray, q_far: np.ndarray, c: np.ndarray, c_far: np.ndarray) -> np.ndarray:
    """For every query and candidate a score that is not exceeded.

    By the triangle inequality the two are at least |d(q, p) - d(c, p)| apart for every pivot p, and the inner product is
    half of |q|^2 + |c|^2 less their squared distance. The largest of these distances counts, less what rounding may add.
    """
    least = np.zeros((len(q), len(c)), np.float32)
    gap = np.empty_like(least)
    for p in range(q_far.shape[1]):
        np.subtract(q_far[:, p, None], c_far[None, :, p], out=gap)
        np.abs(gap, out=gap)
        np.maximum(least, gap, out=least)
    if q_far.size and c_far.size:
        least = np.maximum(least - np.float32(1e-6) * (q_far.max() + c_far.max()), 0)
    bounds = (q ** 2).sum(1)[:, None] + (c ** 2).sum(1)[None, :]
    bounds -= least.astype(np.float64) ** 2
    return bounds * (0.5 + 1e-12) + 1e-6


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles where all sums are below 2 ** 53, else in 64-bit integers."""
    most = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * q.shape[1]
    return q @ c.T if most < 2 ** 53 else (q.astype(np.int64) @ c.astype(np.int64).T)


def search_block(q, q_far, q_rows, least, c, c_far, c_rows, place, k: int, step: int = STEP):
    """(query, candidate, score) arrays: the block's ``k`` best candidates of each query that reach ``least``.

    ``least`` holds the k-th best score known of each query and is raised in place. Candidates are taken in the order of
    the largest bound any query has for them, ``step`` at a time, until no query's bound reaches its k-th best score. A
    bound that equals it still counts, as ``place`` (the candidate's order among equal scores) decides ties.
    """
    bounds = upper_bounds(q, q_far, c, c_far)
    order = np.argsort(-(bounds - least[:, None]).max(0), kind="stable") if len(q) else np.empty(0, int)
    best, found = np.full((len(q), k), -np.inf), []
    for start in range(0, len(order), step):
        part = order[start:start + step]
        at = np.flatnonzero((bounds[:, part] >= least[:, None]).any(1))
        if not len(at):
            # The order was made with the scores known at first; what follows may still concern another query.
            if not (bounds[:, order[start:]] >= least[:, None]).any():
                break
            continue
        got = scores(q[at], c[part]).astype(np.float64)
        got[q_rows[at, None] == c_rows[None, part]] = -np.inf
        pool = np.concatenate([best[at], got], axis=1)
        best[at] = -np.partition(-pool, k - 1, axis=1)[:, :k]
        np.maximum(least, best.min(1), out=least)
        i, j = np.nonzero(got >= np.maximum(least[at], np.finfo(float).min)[:, None])
        found.append((at[i], part[j], got[i, j]))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    i, j, s = map(np.concatenate, zip(*found))
    ranks = np.lexsort((place[j], -s, i))
    i, j, s = i[ranks], j[ranks], s[ranks]
    first = np.searchsorted(i, i)
    keep = (np.arange(len(i)) - first < k) & (s >= least[i])
    return i[keep], j[keep], s[keep]


def places(ids: pa.Array, rows: np.ndarray) -> np.ndarray:
    """The order of candidates of equal score: by id, null last, then by row."""
    order = pa.compute.sort_indices(pa.table({"id": ids, "row": rows}), sort_keys=[("id", "ascending"), ("row", "ascending")])
    out = np.empty(len(rows), np.int64)
    out[order.to_numpy()] = np.arange(len(rows))
    return out


def searched(pairs: DataFrame, width: int, n_pivots: int, k: int) -> DataFrame:
    """q_block, least, and hits (q_row, query_id, row, vec_id, score) of every pair of a block of queries (q_*) with one of
    candidates (c_*): the pair's best, and the k-th best score known of each query afterwards."""
    ids = to_arrow_type(pairs.schema["c_ids"].dataType.elementType)
    kind = pairs.schema["c_ids"].dataType.elementType.simpleString()
    fields = ["q_row", "query_id", "row", "vec_id", "score"]

    def block(row, side):
        n, rows = len(row[f"{side}_rows"]), np.array(row[f"{side}_rows"], np.int64)
        return (np.frombuffer(row[f"{side}_vectors"], np.int32).reshape(n, width).astype(np.float64),
                np.frombuffer(row[f"{side}_far"], np.float32).reshape(n, n_pivots), rows)

    def search(batches):
        known = (None, None)
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                q, c = block(row, "q"), block(row, "c")
                q_ids, c_ids = pa.array(row["q_ids"], ids), pa.array(row["c_ids"], ids)
                least = np.full(len(q[2]), -np.inf) if row["least"] is None else np.array(row["least"], np.float64)
                # What this task has found for the same queries before raises the scores to reach.
                if known[0] == row["q_block"]:
                    least = np.maximum(least, known[1])
                known = row["q_block"], least
                i, j, s = search_block(*q, least, *c, places(c_ids, c[2]), k)
                hits = pa.StructArray.from_arrays([pa.array(q[2][i]), q_ids.take(pa.array(i)), pa.array(c[2][j]),
                                                   c_ids.take(pa.array(j)), pa.array(s.astype(np.int64))], fields)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["q_block"]], pa.int64()), pa.array([least], pa.list_(pa.float64())),
                     pa.ListArray.from_arrays([0, len(hits)], hits)], ["q_block", "least", "hits"])

    return pairs.mapInArrow(search, "q_block long, least array<double>, hits array<struct<q_row:long,"
                                    f"query_id:{kind},row:long,vec_id:{kind},score:long>>")


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = SCALE, pivots: int = PIVOTS, sample: int = SAMPLE,
          vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows with the largest inner product for every row whose id is
    divisible by ``every``; of equal scores the smaller vec_id comes first.

    Components are floor(scale * x). All rows but the query's own are candidates; a query with fewer has them all. Vectors that
    are null, or hold a null or a component that is not finite, take no part; a shorter vector counts as ending in zeros,
    an empty one scores 0. Null ids ask nothing and come last among ties. A repeated row is a row of its own: it is found
    for its copy, and asks once more. Components above ``LARGEST`` are an error, as scores would not fit 64 bits.

    ``pivots`` vectors are chosen from a ``sample`` of bounded size; every row is indexed by its distances to them. Rows are
    range-sorted by nearest pivot and packed into blocks, which carry the range of their distances. Blocks of queries first
    search the block of candidates whose bound is best; the k-th best scores found there rule out other blocks, and within
    a block candidates are scored in the order of their bounds until none can reach the k-th best score (``search_block``).
    All blocks that bounds do not rule out are searched, each pair of blocks being one row that any task can take.
    """
    held = vectors.select(vectors[vec_id].alias("vec_id"), quantised(vectors[vector], scale).alias("vector"),
                          usable(vectors[vector]).alias("_usable")).where("_usable")
    held = settle(held.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector",
                              F.coalesce(F.col("vec_id") % every == 0, F.lit(False)).alias("asks")), "vectors")
    width = held.agg(F.max(F.size("vector"))).first()[0] or 0
    base = pivots_of(held, pivots, sample)
    base = np.hstack([base, np.zeros((len(base), width - base.shape[1]))])
    n_pivots, kind = len(base), held.schema["vec_id"].dataType.simpleString()
    rows = index(held, base)
    c = blocks(rows, block, "candidates")
    q = blocks(rows.where("asks"), queries, "queries")
    c = c.select(*[F.col(n).alias(f"c_{n}") for n in c.columns])
    q = q.select(*[F.col(n).alias(f"q_{n}") for n in q.columns])
    # The least distance between two blocks: the widest gap between their ranges of distances to a pivot.
    def less(a, b):
        return a - b

    gap = F.concat(F.zip_with("q_low", "c_high", less), F.zip_with("c_low", "q_high", less))
    slack = F.lit(1e-6).cast("float") * (F.coalesce(F.array_max("q_high"), F.lit(0.0)) + F.coalesce(F.array_max("c_high"), F.lit(0.0)))
    gap = F.greatest(F.coalesce(F.array_max(gap), F.lit(0.0)) - slack, F.lit(0.0)).cast("double")
    bound = (F.col("q_norm") + F.col("c_norm") - gap * gap) * (0.5 + 1e-12) + 1e-6
    asking = settle(ranked(q.select("q_block", "q_low", "q_high", "q_norm"), [], ["q_block"], "asking"), "asking")
    n_asking = asking.count()
    if not n_asking:
        return rows.where("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id",
                                          F.lit(0).cast("long").alias("score"))
    # The stated queries meet all rows in blocks: only the ranges of blocks are multiplied here.
    ranges = c.select("c_block", "c_low", "c_high", "c_norm", F.explode(F.sequence(F.lit(0), F.lit(n_asking - 1))).alias("rank"))
    met = settle(ranges.join(asking, "rank").select("q_block", "c_block", bound.alias("bound")), "met")
    first = met.groupBy("q_block").agg(F.max_by("c_block", F.struct("bound", "c_block")).alias("c_block"))
    none = F.lit(None).cast("array<double>")
    seeds = settle(searched(first.join(q, "q_block").join(c, "c_block").withColumn("least", none), width, n_pivots, k).select(
        "q_block", "least"), "seeds")
    open_pairs = met.join(seeds, "q_block").where(F.col("bound") >= F.array_min("least")).drop("bound")
    found = searched(open_pairs.join(q, "q_block").join(c, "c_block"), width, n_pivots, k)
    hits = found.select(F.explode("hits").alias("hit")).select("hit.*")
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
