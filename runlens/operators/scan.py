"""Ordered computations over series of any length.

``Window.partitionBy(key).orderBy(t)`` sends all rows of a key to one task, which fails when one key
holds a large share of the data. ``ordered`` sketches the keys first: rows per key, and of the order
columns a sample that hashing picks, counted with a map-side combined aggregate that reads the key and
order columns only. Keys below ``max_rows`` need nothing special, and if there are no others the result
is the plain window. A longer key is cut between sampled places into segments of equal expected size;
windows then run per (key, segment), and what a segment needs from the ones before it (a running sum, a
running maximum, the last row) comes from a small table with one row per segment. Places are compared
as the order columns themselves, whatever their types, so cutting never changes an order.
"""

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from runlens.session import written

MAX_ROWS = 2_000_000
SEGMENT = "_segment"
LONG = "_long"
# Sampled places of a segment of full size; segments aim at half of it, which leaves room for chance.
SAMPLES = 512
# Segments a row is compared with in one join.
FANOUT = 64
# Tables of cut keys and of carried values are replicated up to this many rows, and joined by
# exchange beyond.
REPLICATED_ROWS = 500_000


def micros(column) -> Column:
    """Microseconds since the epoch of a timestamp with or without time zone (UTC session)."""
    return F.unix_micros(F.col(column).cast("timestamp") if isinstance(column, str) else column.cast("timestamp"))


def _attach(df: DataFrame, table: DataFrame, names, rows: int) -> DataFrame:
    """Left join of a small table; replicated to all tasks only up to a known number of rows."""
    own = {name: f"_k{i}" for i, name in enumerate(names)}
    table = table.withColumnsRenamed(own)
    if rows <= REPLICATED_ROWS:
        table = F.broadcast(table)
    same = F.lit(True)
    for name, key in own.items():
        same = same & F.col(name).eqNullSafe(F.col(key))
    return df.join(table, same, "left").drop(*own.values())


@dataclass(frozen=True)
class Ordered:
    """Rows of ``df`` grouped by ``keys`` and ordered by ``order``; cut keys have at most ``segments`` parts in all."""

    df: DataFrame
    keys: tuple
    order: tuple
    segments: int = 0

    @property
    def split(self) -> bool:
        return self.segments > 0

    @property
    def by(self) -> list:
        return [*self.keys, SEGMENT] if self.split else list(self.keys)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def running(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def before(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, -1)

    def with_df(self, df: DataFrame) -> "Ordered":
        return replace(self, df=df)

    def add(self, **columns) -> "Ordered":
        return self.with_df(self.df.withColumns(columns))

    def carry(self, **wanted) -> "Ordered":
        """Add, per row, what earlier segments of the same key amount to.

        ``wanted[name] = (kind, column)`` with kind ``sum``, ``max``, ``min``, ``last`` or ``first``; null in the first
        segment and for keys that were not cut. Null values are passed over; wrap a column in a struct to carry them.
        """
        if not self.split:
            types = self.df.select(*[c.alias(n) for n, (_, c) in wanted.items()]).schema
            return self.add(**{n: F.lit(None).cast("bigint" if kind == "sum" and
                                                   types[n].dataType.typeName() in ("integer", "long")
                                                   else types[n].dataType)
                               for n, (kind, _) in wanted.items()})
        fold = {"sum": F.sum, "max": F.max, "min": F.min, "last": self.last, "first": self.first}
        over = {"sum": F.sum, "max": F.max, "min": F.min,
                "last": lambda c: F.last(c, ignorenulls=True),
                "first": lambda c: F.first(c, ignorenulls=True)}
        table = self.segment_table(**{name: fold[kind](column) for name, (kind, column) in wanted.items()})
        return self.attach(table.select(
            *self.keys, SEGMENT,
            *[over[kind](F.col(name)).over(self.earlier()).alias(name) for name, (kind, _) in wanted.items()]))

    def last(self, column: Column) -> Column:
        """Aggregate: the last value in order."""
        return F.max_by(column, F.when(column.isNotNull(), F.struct(*self.order)))

    def first(self, column: Column) -> Column:
        return F.min_by(column, F.when(column.isNotNull(), F.struct(*self.order)))

    def segments_in_order(self) -> WindowSpec:
        """Window over the segment table."""
        return Window.partitionBy(*self.keys).orderBy(SEGMENT)

    def earlier(self) -> WindowSpec:
        return self.segments_in_order().rowsBetween(Window.unboundedPreceding, -1)

    def segment_table(self, **aggregates) -> DataFrame:
        """One row per segment of the cut keys."""
        return self.df.filter(LONG).groupBy(*self.keys, SEGMENT).agg(*[c.alias(n) for n, c in aggregates.items()])

    def attach(self, table: DataFrame) -> "Ordered":
        """Add the columns of a segment table to its rows; null for keys that were not cut."""
        return self.with_df(_attach(self.df, table, [*self.keys, SEGMENT], self.segments))

    def result(self, *columns) -> DataFrame:
        return self.df.select(*columns) if columns else self.df.drop(SEGMENT, LONG)


def cuts(df: DataFrame, keys, order, max_rows: int = MAX_ROWS) -> DataFrame:
    """The segments of keys with more than ``max_rows`` rows: keys, segment (from 0), and lo and hi, the places (structs of
    the ``order`` columns) between which it lies, from lo on and below hi; null at the ends.

    A place is sampled if its hash says so, whichever task reads it, so the counts of tasks simply add up. Rows of one
    place are never parted: order columns that many rows share should end in one that tells them apart.
    """
    keys, bits = list(keys), max(0, (max_rows // SAMPLES).bit_length() - 1)
    chosen = F.xxhash64(*order).bitwiseAND(F.lit((1 << bits) - 1)) == 0
    counts = df.groupBy(*keys, F.when(chosen, F.struct(*order)).alias("_at")).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum(F.when(F.col("_at").isNotNull(), F.col("_c"))).over(earlier)
    size = max(1, (max_rows // 2) >> bits)
    part = F.floor(F.coalesce(before, F.lit(0)) / size)
    long = (counts.withColumns({"_n": F.sum("_c").over(whole), "_part": part})
            .filter((F.col("_n") > max_rows) & F.col("_at").isNotNull())
            .groupBy(*keys, "_part").agg(F.min("_at").alias("_lo")))
    numbered = whole.orderBy("_lo")
    found = long.select(*keys, (F.row_number().over(numbered) - 1).cast("bigint").alias(SEGMENT), "_lo",
                        F.lead("_lo").over(numbered).alias("_hi"))
    return found.withColumn("_lo", F.when(F.col(SEGMENT) > 0, F.col("_lo")))


def _placed(df: DataFrame, keys, order, segments: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` with the segment of its row, null for keys that are not cut.

    Rows meet at most FANOUT ranges of their key at a time: first those of many segments together, then the segments in
    the range they fell into.
    """
    width = 1
    while width * FANOUT < most:
        width *= FANOUT
    place, df, first = F.struct(*order), df.withColumn("_in", F.lit(None).cast("bigint")), True
    while width:
        table = segments.groupBy(*keys, F.expr(f"{SEGMENT} div {width}").alias("_part")).agg(
            F.min_by("_lo", SEGMENT).alias("_lo"), F.max_by("_hi", SEGMENT).alias("_hi"))
        table = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_part", "_lo", "_hi",
                             F.expr(f"_part div {FANOUT}").alias("_of"))
        same = (F.col("_lo").isNull() | (place >= F.col("_lo"))) & (F.col("_hi").isNull() | (place < F.col("_hi")))
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        if not first:
            same = same & (F.col("_in") == F.col("_of"))
        table = F.broadcast(table) if rows <= REPLICATED_ROWS else table
        df = df.join(table, same, "left").withColumn("_in", F.col("_part")) \
            .drop("_part", "_lo", "_hi", "_of", *[f"_k{i}" for i in range(len(keys))])
        width, first = width // FANOUT, False
    return df.withColumnRenamed("_in", SEGMENT)


def ordered(df: DataFrame, keys, order, max_rows: int = MAX_ROWS) -> Ordered:
    """Prepare windows over ``keys`` ordered by the columns ``order`` (ascending, nulls first)."""
    keys, order = tuple(keys), tuple(order)
    segments = written(cuts(df, keys, order, max_rows), "segments")
    rows, most = segments.agg(F.count(F.lit(1)), F.max(SEGMENT)).first()
    if not rows:
        return Ordered(df, keys, order)
    cut = _placed(df, keys, order, segments, rows, most + 1)
    cut = cut.withColumns({LONG: F.col(SEGMENT).isNotNull(), SEGMENT: F.coalesce(SEGMENT, F.lit(0).cast("bigint"))})
    return Ordered(cut, keys, order, rows)


def ordinal(df: DataFrame, keys, order, name: str = "pos", max_rows: int = MAX_ROWS) -> DataFrame:
    """Number the rows of each key from 0 in ``order``."""
    rows = ordered(df, keys, order, max_rows).carry(_before=("sum", F.lit(1).cast("bigint")))
    local = F.row_number().over(rows.window()).cast("bigint") - 1
    return rows.add(**{name: local + F.coalesce(F.col("_before"), F.lit(0))}).result().drop("_before")
