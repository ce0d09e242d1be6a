"""Which entities a sequence of listings shows, from when to when."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def listings_of(observed: DataFrame, seen_at: str = "seen_at") -> DataFrame:
    """The listings in their order: seen_at, n (from 1). A row without a name stands for the listing alone, which so
    counts even if it shows nothing."""
    times = observed.select(F.col(seen_at).alias("seen_at")).filter("seen_at is not null").distinct()
    return times.withColumn("n", F.row_number().over(Window.orderBy("seen_at")).cast("bigint"))


def presence(stored: DataFrame, observed: DataFrame, listings: DataFrame, key: str = "name", seen_at: str = "seen_at",
             changing: str = "phase") -> DataFrame:
    """Every entity of every listing, with ``stored`` as listing 0: n, ``start`` (it was not in the listing before), the
    number of its next listing, its ``changing`` column there and before, and its other columns as they were at the start
    of that presence. An entity named twice in a listing counts with its greatest row."""
    rest = [c for c in stored.columns if c not in (key, changing)]
    seen = observed.filter(F.col(key).isNotNull()).groupBy(key, F.col(seen_at).alias("seen_at")).agg(
        F.max(F.struct(changing, *rest)).alias("_row"))
    rows = seen.join(listings, "seen_at").select(key, "n", f"_row.{changing}", F.struct(*[F.col("_row")[c].alias(c) for c in rest]).alias("_rest"))
    before = stored.select(key, F.lit(0).cast("bigint").alias("n"), changing, F.struct(*rest).alias("_rest"))
    own = Window.partitionBy(key).orderBy("n")
    rows = before.unionByName(rows).withColumns({
        "_last": F.lag("n").over(own), "next": F.lead("n").over(own), "before": F.lag(changing).over(own)})
    rows = rows.withColumn("start", F.col("_last").isNull() | (F.col("n") - F.col("_last") > 1))
    first = F.last(F.when(F.col("start"), F.col("_rest")), ignorenulls=True).over(
        own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_rest", first).select(key, "n", "start", "next", changing, "before", *[F.col("_rest")[c].alias(c) for c in rest])


def inventory_after(stored: DataFrame, observed: DataFrame, key: str = "name", seen_at: str = "seen_at",
                    changing: str = "phase") -> tuple:
    """(inventory after the last listing, all changes on the way): ``changes`` holds seen_at, action (insert, delete, phase),
    and the entity. An entity is inserted by the first listing that shows it again, deleted by the first that does not, and
    changes its phase between two listings that follow each other. A missing address becomes the empty string."""
    observed = observed.withColumn("ip", F.coalesce("ip", F.lit(""))) if "ip" in observed.columns else observed
    columns = stored.columns
    listings = listings_of(observed, seen_at)
    # One row per listing.
    count = listings.agg(F.max("n")).first()[0] or 0
    rows = presence(stored, observed, listings, key, seen_at, changing)
    entity = [F.col(c) for c in columns]
    insert = rows.filter("start and n > 0").select("n", F.lit("insert").alias("action"), *entity)
    changed = rows.filter(~F.col("start") & ~F.col("before").eqNullSafe(F.col(changing))).select(
        "n", F.lit(changing).alias("action"), *entity)
    delete = rows.filter((F.col("n") < count) & (F.col("next").isNull() | (F.col("next") > F.col("n") + 1))).select(
        (F.col("n") + 1).alias("n"), F.lit("delete").alias("action"), *entity)
    changes = insert.unionByName(changed).unionByName(delete).join(listings, "n")
    return rows.filter(F.col("n") == count).select(*columns), changes.select("seen_at", "action", *columns)
