"""Joins of points with the time spans that hold them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.scan import MAX_ROWS, REPLICATED_ROWS, ordered
from runlens.session import written

# Spans of a key that every point of it is simply compared with.
FEW = 8
# Entries of an array that numbers a range.
STEP = 1024


def counted_up(df: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """One row per whole number from ``low`` to ``high``; no array holds more than STEP of them, or of their blocks."""
    blocks = df.withColumns({"_low": low, "_high": high}).withColumn("_at", F.explode(
        F.sequence(F.expr(f"_low div {STEP * STEP}"), F.expr(f"_high div {STEP * STEP}"))))
    for width in (STEP, 1):
        first = F.greatest(F.expr(f"_low div {width}"), F.col("_at") * STEP)
        last = F.least(F.expr(f"_high div {width}"), F.col("_at") * STEP + (STEP - 1))
        blocks = blocks.withColumn("_at", F.explode(F.sequence(first, last)))
    return blocks.drop("_low", "_high").withColumnRenamed("_at", name)


def layered(spans: DataFrame, key: str, start: str, end: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """``spans`` with the bins of their key that they reach into, one row per bin: ``_bin``, and ``_size``, how many spans
    start in a bin of the key.

    A sorted sweep over starts and ends numbers the starts and finds how many spans of a key are open at once at most. That
    many starts make a bin: so a bin holds at most twice as many spans, and all bins together hold each span twice on
    average. A span ends after those that start at its end, as both ends belong to it.
    """
    spans = spans.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))
    spans = spans.withColumn("_span", F.monotonically_increasing_id())
    spans = written(spans, "spans")
    events = spans.select(key, "_span", F.inline(F.array(
        F.struct(F.col(start).alias("_at"), F.lit(0).alias("_side")),
        F.struct(F.col(end).alias("_at"), F.lit(1).alias("_side"))))).filter("_at is not null")
    rows = ordered(events, [key], ["_at", "_side", "_span"], max_rows)
    opens, change = (F.col("_side") == 0).cast("bigint"), F.when(F.col("_side") == 0, 1).otherwise(-1).cast("bigint")
    rows = rows.carry(_opened=("sum", opens), _level=("sum", change))
    rows = rows.add(_no=F.sum(opens).over(rows.running()) + F.coalesce("_opened", F.lit(0)),
                    _open=F.sum(change).over(rows.running()) + F.coalesce("_level", F.lit(0)))
    swept = written(rows.result(key, "_span", "_side", "_no", "_open"), "swept")
    sizes = swept.groupBy(key).agg(F.max("_open").alias("_size"), F.max("_no").alias("_last"))
    reach = swept.groupBy(key, "_span").agg(F.min("_no").alias("_from"), F.max(F.when(F.col("_side") == 1, F.col("_no"))).alias("_to"))
    reach = reach.join(sizes, key).select("_span", "_size", "_from", F.coalesce("_to", "_last").alias("_to"))
    binned = spans.join(reach, "_span").drop("_span")
    return counted_up(binned, F.expr("(_from - 1) div _size"), F.expr("(_to - 1) div _size"), "_bin").drop("_from", "_to")


def in_spans(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, few: int = FEW,
             max_rows: int = MAX_ROWS) -> DataFrame:
    """Every point with every span of its key that holds it: ``start`` <= ``at`` <= ``end``, an absent end being none.

    Keys with up to ``few`` spans are joined by key and compared. For the others a sweep over points and span starts, sorted
    per key and cut where a key is long, counts the starts up to each point, the count of earlier segments being carried
    over; that count names the point's bin of ``layered`` spans, with whose spans alone it is compared. A point thus
    meets at most twice as many spans as its key ever has open at once, however many the key has seen, and the table of
    spans grows to about twice its rows. Points and spans without key, points without time and spans that end before
    they start match nothing. ``few=None`` says that every key has few. Output columns: those of ``points``, then those of
    ``spans`` without ``key``.
    """
    inside = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) <= F.col(end)))
    columns = [*points.columns, *[c for c in spans.columns if c != key]]
    if few is None:
        return points.join(spans, key).filter(inside).select(*columns)
    often = written(spans.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
                    .filter(F.col("_n") > few).select(key), "long_keys")
    n_often = often.limit(REPLICATED_ROWS + 1).count()
    if not n_often:
        return points.join(spans, key).filter(inside).select(*columns)
    often = F.broadcast(often) if n_often <= REPLICATED_ROWS else often
    plain = points.join(spans.join(often, key, "left_anti"), key).filter(inside).select(*columns)

    binned = written(layered(spans.join(often, key, "left_semi"), key, start, end, max_rows), "binned")
    starts = spans.join(often, key, "left_semi").filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))
    marks = starts.groupBy(key, F.col(start).alias(at)).agg(F.count(F.lit(1)).alias("_starts"))
    sizes = binned.select(key, "_size").distinct()
    swept = points.join(often, key, "left_semi").filter(F.col(at).isNotNull()).withColumn("_row", F.struct(*points.columns))
    swept = swept.select(key, at, F.lit(0).cast("bigint").alias("_starts"), "_row", F.xxhash64(
        *[c for c in points.columns if not points.schema[c].dataType.typeName() in ("map", "variant")]).alias("_tie"))
    # Starts sort before points of the same time; the hash only parts points that share a time.
    events = marks.select(key, at, "_starts", F.lit(None).cast(swept.schema["_row"].dataType).alias("_row"),
                          F.lit(None).cast("bigint").alias("_tie")).unionByName(swept)
    rows = ordered(events.withColumn("_point", F.col("_row").isNotNull()), [key], [at, "_point", "_tie"], max_rows)
    rows = rows.carry(_opened=("sum", F.col("_starts")))
    rows = rows.add(_no=F.sum("_starts").over(rows.running()) + F.coalesce("_opened", F.lit(0)))
    found = rows.result(key, "_row", "_no").filter("_row is not null and _no > 0").join(sizes, key)
    found = found.select("_row.*", F.expr("(_no - 1) div _size").alias("_bin"))
    held = binned.withColumnRenamed("_bin", "_in").withColumnRenamed(key, "_key").drop("_size")
    swept = found.join(held, (found[key] == held["_key"]) & (found["_bin"] == held["_in"])).filter(inside).select(*columns)
    return plain.unionByName(swept)
