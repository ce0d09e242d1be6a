"""Exact deduplication by a tree merge of digest runs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.tables import settle, small, text_of

# Runs that one task set merges into one per round, as a power of two: 3 stands for eight-way merges.
RADIX_BITS = 3


def normalised(docs: DataFrame, text: str = "text"):
    """The text with every run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(text_of(docs, text), r"[\x20\x09-\x0D]+", " ")


def digest_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, sha (binary), n_bytes and a second hash of the normalised text, and run.

    A run is what one scan task read, sorted by digest. The table is written, so texts are read and hashed once.
    """
    plain = docs.select(docs[doc_id].alias("doc_id"), normalised(docs, text).alias("_norm"))
    rows = plain.select("doc_id", F.unhex(F.sha2("_norm", 256)).alias("sha"), F.octet_length("_norm").alias("n_bytes"),
                        F.xxhash64("_norm").alias("second"), F.spark_partition_id().alias("run"))
    return settle(rows.sortWithinPartitions("sha"), "digests")


def merge_runs(runs: DataFrame, radix_bits: int = RADIX_BITS) -> DataFrame:
    """The groups of equal texts: sha, n_bytes, second, keep_id (smallest doc_id), group_size.

    Round by round, runs whose numbers agree but for their lowest bits exchange their entries and are merged, until one
    run is left. Each level first folds the entries within its tasks (sort, then partial minimum and count), so a group
    that holds a third of all rows leaves every task as a single entry. An entry is only folded into another if digest,
    length and second hash all agree: that verifies at every level that the smallest identifier belongs to the text.
    No level holds a run in one task; its entries stay spread by digest.
    """
    keys = ["run", "sha", "n_bytes", "second"]
    top = runs.agg(F.max("run")).first()[0] or 0
    # The first level folds what every task has sorted already.
    merged = runs.groupBy((F.shiftright("run", radix_bits)).alias("run"), *keys[1:]).agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    top >>= radix_bits
    while top:
        merged = merged.groupBy(F.shiftright("run", radix_bits).alias("run"), *keys[1:]).agg(
            F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        top >>= radix_bits
    return merged.drop("run")


def exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radix_bits: int = RADIX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Two texts are equal if they agree after every run of ASCII white space has become one space. Null texts count as
    empty and so equal each other. The smallest doc_id of a group stays; null ids come last, and a group of null ids
    only has a null keep_id and keeps its rows. Rows that repeat a doc_id and its text share its fate (both stay or both
    go); ``without_copies`` makes them one. An empty table gives an empty result. Further columns are not read.
    """
    runs = digest_runs(docs, doc_id, text)
    groups = merge_runs(runs, radix_bits)
    return runs.join(groups, ["sha", "n_bytes", "second"]).select(
        "doc_id", "keep_id", "group_size", runs.doc_id.eqNullSafe(groups.keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, in their own columns.

    Only digests are exchanged; the texts are where no more rows go than can be replicated. Rows that repeat a doc_id
    and its text become one; rows with equal texts and null ids become one if the group has no other id to keep.
    """
    fates = settle(exact_copies(docs, doc_id, text).select(
        F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"), "kept", "group_size"), "fates")
    gone = small(fates.where("not kept").select("_id", F.col("_sha").alias("_gone")).distinct())
    names = [F.col(f"`{c}`") for c in docs.columns]
    held = docs.withColumn("_sha", F.unhex(F.sha2(normalised(docs, text), 256)))
    out = held.join(gone, held[doc_id].eqNullSafe(gone["_id"]) & (held["_sha"] == gone["_gone"]), "left_anti")
    twice = fates.where("kept and group_size > 1").groupBy("_id", "_sha").count().where("count > 1")
    twice = settle(twice.select("_id", F.col("_sha").alias("_twice")), "repeated")
    if twice.isEmpty():
        return out.select(*names)
    again = small(twice)
    same = out[doc_id].eqNullSafe(again["_id"]) & (out["_sha"] == again["_twice"])
    once = out.join(again, same, "left_semi").dropDuplicates([doc_id, "_sha"])
    return out.join(again, same, "left_anti").select(*names).unionByName(once.select(*names))
