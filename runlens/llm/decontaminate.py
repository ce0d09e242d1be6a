"""Benchmark passages in documents: SimHash fingerprints of item-sized windows, found by Hamming blocks, then verified."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.llm.tables import settle, small, text_of

SHINGLE = 5
SIMILARITY = 0.8
# Fingerprints have 64 bits in five blocks. Any two within RADIUS = 5 * (FLIPS + 1) - 1 bits of each other have a block in
# which at most FLIPS bits differ, so looking up every such variant of each block of an item misses none.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
FLIPS = 3
RADIUS = len(BLOCKS) * (FLIPS + 1) - 1


def with_marks(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with marks: hashes of all runs of five words (letters and digits in lower case) of ``text``; a shorter text
    is one shingle, a text without words has none."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    # The words are a column of their own: within the function below an expression would be evaluated for each element.
    cut = rows.withColumn("_w", F.split(plain, " "))
    w, n = F.col("_w"), F.size("_w")
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    none = F.array().cast("array<long>")
    return cut.withColumn("marks", F.when(n >= SHINGLE, runs).when(F.get(w, F.lit(0)) != "", F.array(
        F.xxhash64(F.array_join(w, " ")))).otherwise(none)).drop("_w")


def with_print(rows: DataFrame) -> DataFrame:
    """``rows`` with print, the 64-bit SimHash of marks: a bit is set if more than half of the hashes, by multiplicity,
    have it set.

    The 64 counts are kept in 16 long values of four 16-bit lanes each, for windows of up to 32,767 shingles.
    """
    lane = 0x0001000100010001
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(16)])
    summed = rows.withColumn("_sums", F.aggregate("marks", zero, lambda acc, x: F.struct(*[
        (acc[f"c{k}"] + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(lane))).alias(f"c{k}") for k in range(16)])))
    out = F.lit(0).cast("long")
    for bit in range(64):
        count = F.shiftrightunsigned(F.col(f"_sums.c{bit % 16}"), bit - bit % 16).bitwiseAND(F.lit(0xFFFF))
        out = out.bitwiseOR(F.when(count * 2 > F.size("marks"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(0))
    return summed.withColumn("print", out).drop("_sums")


def block(print_: Column, number: int) -> Column:
    start, width = BLOCKS[number]
    return F.shiftrightunsigned(print_, start).bitwiseAND(F.lit((1 << width) - 1))


def item_table(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, marks, m (their number) and a fingerprint per item with words, written once; equal rows are one."""
    rows = with_marks(items.select(items[item_id].alias("item_id"), text_of(items, text).alias("text")))
    rows = rows.where(F.size("marks") > 0).select("item_id", "marks", F.size("marks").alias("m")).dropDuplicates()
    return settle(with_print(rows), "items")


def block_index(listed: DataFrame) -> DataFrame:
    """m, item_id, block, value: every value of a block that differs from the item's own in FLIPS bits or fewer."""
    masks = F.lit([v for v in range(1 << max(w for _, w in BLOCKS)) if v.bit_count() <= FLIPS]).cast("array<long>")
    own = F.array(*[F.struct(F.lit(b).alias("block"), block(F.col("print"), b).alias("own"), F.lit(1 << BLOCKS[b][1]).alias("top"))
                    for b in range(len(BLOCKS))])
    rows = listed.select("m", "item_id", F.explode(own).alias("_b")).select("m", "item_id", "_b.*", F.explode(masks).alias("_mask"))
    return rows.where("_mask < top").select("m", "item_id", "block", F.col("own").bitwiseXOR(F.col("_mask")).alias("value"))


def text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text), F.octet_length(text))


def candidate_windows(marks: DataFrame, listed: DataFrame) -> DataFrame:
    """key, start, m of the item-sized windows that can reach the threshold with any item at all.

    ``marks``: key, position, mark of every shingle. A window at 0.8 or more to an item of m shingles has 4 / 5 of
    them in common with it, also where the text ends within the window, so it is enough to fingerprint windows with that
    many shingles that occur in the benchmark. The best window of an item starts with such a shingle: one that does not is not worse when moved on to the next.
    The number of shingles in a window is read off ranks: the one that completes it must lie within it.
    """
    known = settle(listed.select(F.explode("marks").alias("mark"), "m").distinct(), "marks")
    hits = settle(marks.join(known, "mark").groupBy("key", "position").agg(F.collect_set("m").alias("sizes")), "hits")
    # A partition is one text, its rows the benchmark shingles in it.
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("position")))
    opened = ranked.select("key", F.col("position").alias("start"), F.explode("sizes").alias("m"), "rank")
    opened = opened.withColumn("_last", F.col("rank") + F.ceil(F.col("m") * 4 / 5).cast("int") - 1)
    last = ranked.select(F.col("key").alias("_key"), F.col("rank").alias("_rank"), F.col("position").alias("_position"))
    return opened.join(last, (opened.key == last["_key"]) & (opened["_last"] == last["_rank"])).where(
        "_position < start + m").select("key", "start", "m")


def passages(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
             item_text: str = "text") -> DataFrame:
    """key, item_id, similarity, start (in words), n_words, distance: the best window of each text and item found.

    ``key`` is ``text_key`` of a document's text; texts that occur often are searched once per task and joined by key.
    """
    listed = item_table(items, item_id, item_text)
    hashed = docs.select(text_of(docs, text).alias("text")).select(text_key(F.col("text")).alias("key"), "text")
    # The outer form, as for the plain one Spark would test the size of marks before, by making them once more.
    marks = with_marks(hashed).select("key", F.posexplode_outer("marks").alias("position", "mark"))
    windows = settle(candidate_windows(marks, listed), "windows")
    starts = windows.groupBy("key").agg(F.collect_set(F.struct("start", "m")).alias("windows"))
    # Only texts with windows are hashed again; of texts alike, one.
    keys = small(windows.select("key").distinct())
    again = with_marks(hashed.join(keys, "key", "left_semi").dropDuplicates(["key"])).select("key", "marks")
    cut = again.join(starts, "key").select("key", "marks", F.explode("windows").alias("w")).select(
        "key", F.col("w.start").alias("start"), F.col("w.m").alias("m"), F.expr("slice(marks, w.start + 1, w.m)").alias("marks"))
    prints = settle(with_print(cut), "prints")
    blocks = prints.select("key", "start", "m", F.explode(F.array(*[
        F.struct(F.lit(b).alias("block"), block(F.col("print"), b).alias("value")) for b in range(len(BLOCKS))])).alias("_b"))
    pairs = blocks.select("key", "start", "m", "_b.*").join(block_index(listed), ["m", "block", "value"]).select(
        "key", "start", "m", "item_id").distinct()
    sides = pairs.join(prints, ["key", "start", "m"]).join(listed.select(
        "item_id", "m", F.col("marks").alias("_marks"), F.col("print").alias("_print")), ["item_id", "m"])
    near = sides.withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("_print")))).where(
        F.col("distance") <= RADIUS)
    times = lambda array, x: F.size(F.filter(array, lambda y: y == x))
    common = F.aggregate(F.array_distinct("marks"), F.lit(0), lambda acc, x: acc + F.least(
        times(F.col("marks"), x), times(F.col("_marks"), x)))
    judged = near.withColumn("_common", common).withColumn(
        "similarity", F.col("_common") / (F.size("marks") + F.size("_marks") - F.col("_common")))
    best = judged.where(F.col("similarity") >= SIMILARITY).groupBy("key", "item_id").agg(F.max(F.struct(
        "similarity", (-F.col("start")).alias("_start"), "m", "distance")).alias("_best"))
    return best.select("key", "item_id", F.col("_best.similarity").alias("similarity"),
                       (-F.col("_best._start")).alias("start"),
                       (F.col("_best.m") + SHINGLE - 1).alias("n_words"), F.col("_best.distance").alias("distance"))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, similarity, start, n_words, distance.

    Windows of as many words as an item has are compared with it by weighted Jaccard similarity of five-word shingles
    (words: letters and digits in lower case; weights: how often a shingle occurs); 0.8 or more counts. Each candidate
    passes three steps: enough benchmark shingles in the window (exact), SimHash fingerprints within RADIUS = 19 of 64
    bits (a pair at 0.8 is about 10 apart), exact similarity. start is the word at which the best window begins; ties
    take the first one that starts with a shingle of the benchmark.

    Null texts and texts without words hold nothing. Items of fewer than five words are one shingle, found only in
    documents that consist of just them; items without words are not searched. Repeated rows and equal texts all get
    their rows; null ids are kept; either table may be empty. Other columns are not read.
    """
    found = passages(docs, items, text, item_id, item_text)
    rows = docs.select(docs[doc_id].alias("doc_id"), text_key(text_of(docs, text)).alias("key"))
    return rows.join(found, "key").select("doc_id", "item_id", "similarity", "start", "n_words", "distance")


def without_passages(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                     item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item is found, in their own columns."""
    found = settle(passages(docs, items, text, item_id, item_text).select("key").distinct(), "found")
    held = docs.withColumn("_key", text_key(text_of(docs, text)))
    found = small(found)
    return held.join(found, held["_key"] == found["key"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
