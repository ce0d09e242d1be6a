"""Near-duplicate documents by Order MinHash and banded alignment."""

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.tables import settle, short_batches, slices, small, text_of

# Words in a shingle; the similarity from which texts are near duplicates.
SHINGLE = 5
SIMILARITY = 0.8
# Sketches of a text, and the shingles in each. Two texts at the threshold agree in a sketch with a probability of about
# 0.8 ** 4 = 0.41 and so miss each other in all of them with 3e-6.
SKETCHES = 24
MINIMA = 4
# Texts of up to SHORT_TO shingles have sketches of SHORT_MINIMA, those of LONG_FROM or more have the others; as lengths of
# near duplicates differ by a fifth at most, any two of them share one kind.
SHORT_MINIMA, SHORT_TO, LONG_FROM = 3, 12, 10
# The square of this many pairs of a bucket are compared by their bits: members outside its largest connected part with all
# others, BLOCK of them at a time. Where there would be more, members are dealt anew.
FEW = 4096
BLOCK = 256
# Bits of a text, and how many of them may differ in similar texts. Of two texts that share 0.8 of their shingles a bit
# differs with a probability of 0.1, more than DIFFER of them with 2e-7.
BITS = 2048
DIFFER = 276
_WORD = re.compile(r"[^\W_]+")
_MULTIPLIERS = np.random.RandomState(20).randint(1, 2**63 - 1, 64 + SHINGLE + MINIMA, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text: runs of letters and digits in lower case."""
    words = [_WORD.findall(t.lower()) for t in texts]
    look = {w: xxhash.xxh64_intdigest(w) for w in set().union(*words)}.__getitem__
    return [np.fromiter(map(look, w), np.uint64, len(w)) for w in words]


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE words; a shorter text is one shingle, a text without words has none."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, SHINGLE)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out += words[k:n - width + 1 + k] * _MULTIPLIERS[64 + k]
    return _mix(out + np.uint64(width))


def labelled(marks: np.ndarray) -> np.ndarray:
    """Shingles with the number of equal ones before them, as new hashes: all are different."""
    order = np.argsort(marks, kind="stable")
    ranked = marks[order]
    new = np.ones(len(marks), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return marks
    at = np.arange(len(marks))
    seen = np.empty(len(marks), np.uint64)
    seen[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(seen > 0, _mix(marks + seen * np.uint64(0x9E3779B97F4A7C15)), marks)


def sketch(marks: np.ndarray, sketches: int = SKETCHES) -> list[int]:
    """Order MinHash: each value stands for the smallest labelled shingles under one order, in the order of the text."""
    n, out = len(marks), []
    if n == 0:
        return out
    own = labelled(marks)
    orders = own[None, :] * _MULTIPLIERS[:sketches, None]
    for minima, kind, fits in ((SHORT_MINIMA, 1, n <= SHORT_TO), (MINIMA, 2, n >= LONG_FROM)):
        if fits:
            least = min(minima, n)
            at = np.argpartition(orders, least - 1, axis=1)[:, :least] if least < n else np.tile(np.arange(n), (sketches, 1))
            chosen = own[np.sort(at, axis=1)]
            value = np.arange(sketches, dtype=np.uint64) * np.uint64(4) + np.uint64(kind)
            for k in range(least):
                value = _mix(value * _MULTIPLIERS[64 + SHINGLE + k] + chosen[:, k])
            out += value.astype(np.int64).tolist()
    return out


_ORDERS = np.random.RandomState(21).randint(0, 2**32, (2, BITS), dtype=np.uint64).astype(np.uint32)


def bits(marks: np.ndarray) -> bytes:
    """One bit of the smallest labelled shingle under each of BITS orders."""
    own = (_mix(labelled(marks)) >> np.uint64(32)).astype(np.uint32)
    least = np.empty(BITS, np.uint32)
    step = max(1, (1 << 18) // len(own))
    for start in range(0, BITS, step):
        flips, factors = _ORDERS[:, start:start + step, None]
        least[start:start + step] = ((own ^ flips) * (factors | np.uint32(1))).min(axis=1)
    return np.packbits(_mix(least.astype(np.uint64) + np.uint64(1)) >> np.uint64(40) & np.uint64(1)).tobytes()


def needed(n_a: int, n_b: int) -> int:
    """The fewest aligned shingles that make two texts near duplicates: 4 / 9 of all, as a / (n_a + n_b - a) >= 0.8."""
    return -(-4 * (n_a + n_b) // 9)


def aligned(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """The longest common subsequence of two shingle sequences if it has ``least`` entries or more, else -1.

    An alignment that good leaves its diagonal by no more than the entries it may skip, so only that band is filled: one
    row of differences as the bits of an integer, which moves along the diagonal. Common ends are taken off before.
    """
    n_a, n_b = len(a), len(b)
    if min(n_a, n_b) < least:
        return -1
    m = min(n_a, n_b)
    differ = np.flatnonzero(a[:m] != b[:m])
    head = int(differ[0]) if len(differ) else m
    tail = 0
    if head < m:
        differ = np.flatnonzero(a[n_a - m + head:][::-1] != b[n_b - m + head:][::-1])
        tail = int(differ[0]) if len(differ) else m - head
    a, b = a[head:n_a - tail], b[head:n_b - tail]
    if not len(a) or not len(b):
        return head + tail if head + tail >= least else -1
    if head + tail + min(np.isin(a, b).sum(), np.isin(b, a).sum()) < least:
        return -1
    band = n_a + n_b - 2 * least
    places: dict = {}
    for at, mark in enumerate(a.tolist()):
        places.setdefault(mark, []).append(at)
    often = {}
    for mark, ats in places.items():
        if len(ats) > 16:
            bits = np.zeros(len(a), np.uint8)
            bits[ats] = 1
            often[mark] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    width = 2 * band + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    row, gone = full, 0
    for at, mark in enumerate(b.tolist()):
        if at:
            gone += not row & 1
            row = row >> 1 | top
        ats = places.get(mark)
        if ats is None:
            continue
        low = at - band
        if mark in often:
            hits = (often[mark] >> low if low >= 0 else often[mark] << -low) & full
        else:
            hits = 0
            for p in ats[bisect_left(ats, low):bisect_right(ats, at + band)]:
                hits |= 1 << (p - low)
        some = row & hits
        row = (row + some | row - some) & full
    found = head + tail + gone + width - row.bit_count()
    return found if found >= least else -1


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sketches: int = SKETCHES) -> DataFrame:
    """One row per document, written once: doc_id, text_key (md5 of the text), words_key (of its words, or of the text if
    it has none), n_shingles, sketches."""
    plain = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"))
    plain = plain.select("doc_id", "text", F.unhex(F.md5("text")).alias("text_key"))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts, keys = part.column("text").to_pylist(), part.column("text_key").to_pylist()
                words, counts, values = [], [], []
                for hashes, key in zip(word_hashes(texts), keys):
                    marks = shingles(hashes)
                    words.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else key)
                    counts.append(len(marks))
                    values.append(sketch(marks, sketches))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(words, pa.binary()), pa.array(counts, pa.int64()),
                     pa.array(values, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "words_key", "n_shingles", "sketches"])

    with short_batches(docs.sparkSession):
        return settle(plain.mapInArrow(
            sign, f"doc_id {kind}, text_key binary, words_key binary, n_shingles long, sketches array<long>"), "signatures")


def shingle_table(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """words_key, marks (the shingles as bytes), bits of the texts in ``wanted`` (doc_id, text_key, words_key), written once."""
    plain = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text")).withColumn(
        "text_key", F.unhex(F.md5("text")))
    wanted = small(wanted.withColumnRenamed("doc_id", "_id"))
    plain = plain.join(wanted, (plain.text_key == wanted.text_key) & plain.doc_id.eqNullSafe(wanted["_id"])).select(
        "words_key", "text")

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                marks = [shingles(h) for h in word_hashes(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("words_key"), pa.array([m.tobytes() for m in marks], pa.binary()),
                                                  pa.array(map(bits, marks), pa.binary())], ["words_key", "marks", "bits"])

    with short_batches(docs.sparkSession):
        return settle(plain.mapInArrow(cut, "words_key binary, marks binary, bits binary").dropDuplicates(["words_key"]), "shingles")


def alike(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The written ``pairs`` (member, center, deal) whose bits let them be similar."""
    a, b = (marks.select(F.col("words_key").alias(c), F.col("bits").alias(f"_{c}")) for c in ("member", "center"))

    def judge(batches):
        for batch in batches:
            x, y = (_words(batch.column(c)) for c in ("_member", "_center"))
            near = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= DIFFER
            yield batch.select(["member", "center", "deal"]).filter(pa.array(near))

    both = pairs.join(a, "member").join(b, "center").select("member", "center", "deal", "_member", "_center")
    return settle(both.mapInArrow(judge, pairs.select("member", "center", "deal").schema), "alike")


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def meetings(few: DataFrame, marks: DataFrame) -> DataFrame:
    """member, center: pairs that share a bucket of ``few`` (bucket, member, root, main, n_shingles, blocks), have different
    roots, and may be similar by their lengths and bits.

    The members outside the main part of a bucket, FEW at most, meet all its members block by block, so no exchange holds
    pairs. A pair is listed in the smallest of its buckets; a member brings up to 2 * SKETCHES of those before each.
    """
    buckets = few.groupBy("member").agg(F.slice(F.sort_array(F.collect_list("bucket")), 1, 2 * SKETCHES).alias("_buckets"))
    of = marks.select(F.col("words_key").alias("member"), "bits")
    rows = few.join(buckets, "member").join(of, "member").select(
        "bucket", "main", F.pmod(F.xxhash64("bucket", "member"), "blocks").alias("_block"),
        F.struct("member", "root", "main", "n_shingles", "bits", F.filter("_buckets", lambda b: b < F.col("bucket")).alias("before")).alias("_row"))
    rows = settle(rows, "meeting")
    others = rows.groupBy("bucket", "_block").agg(F.collect_list("_row").alias("all"))
    both = others.join(rows.where("not main").groupBy("bucket").agg(F.collect_list("_row").alias("few")), "bucket").select("few", "all")

    def meet(batches):
        for batch in batches:
            sides = [(c.value_lengths().to_pylist(), c.flatten()) for c in (batch.column("few"), batch.column("all"))]
            starts = [0, 0]
            for lengths in zip(*(x[0] for x in sides)):
                x, y = (rows.slice(start, n) for (_, rows), start, n in zip(sides, starts, lengths))
                starts = [start + n for start, n in zip(starts, lengths)]
                found = _met(x, y)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], ["member", "center"])

    return both.mapInArrow(meet, "member binary, center binary")


def _met(few: pa.StructArray, rows: pa.StructArray) -> list[tuple[bytes, bytes]]:
    """The pairs of ``few`` and ``rows`` that ``meetings`` lists."""
    names, roots = ([side.field(c).to_pylist() for side in (few, rows)] for c in ("member", "root"))
    (member, center), (root, other) = ([np.array([code[v] for v in part]) for part in side] for side in (names, roots)
                                       for code in ({v: at for at, v in enumerate(sorted({*side[0], *side[1]}))},))
    n, m = (side.field("n_shingles").to_numpy(zero_copy_only=False) for side in (few, rows))
    main = rows.field("main").to_numpy(zero_copy_only=False)
    x, y = _words(few.field("bits")), _words(rows.field("bits"))
    before = [side.field("before").to_pylist() for side in (few, rows)]
    out = []
    step = max(1, (1 << 15) // len(y))
    for start in range(0, len(x), step):
        at = slice(start, start + step)
        # Texts whose lengths differ by more than a fifth of the longer one cannot be similar.
        fits = (root[at, None] != other) & (main | (member[at, None] > center)) & (
            4 * (n[at, None] + m) <= 9 * np.minimum(n[at, None], m))
        if fits.any():
            fits &= np.bitwise_count(x[at, None, :] ^ y).sum(axis=2, dtype=np.int64) <= DIFFER
            for i, j in zip(*(k.tolist() for k in np.nonzero(fits))):
                if not before[0][start + i] or set(before[0][start + i]).isdisjoint(before[1][j]):
                    a, b = names[0][start + i], names[1][j]
                    out.append((max(a, b), min(a, b)))
    return out


def prefix(n: int) -> int:
    """How many shingles of a text of ``n``, first in any order common to all texts, hold one of every similar text's
    first ones: similar texts have 0.8 of the longer one's shingles in common."""
    return n - -(-4 * n // 5) + 1


def apart(member: np.ndarray, center: np.ndarray) -> np.ndarray:
    """All labelled shingles that ``member`` has and ``center`` has not, in the order of their hashes."""
    return np.sort(np.setdiff1d(labelled(member), labelled(center), assume_unique=True))


def within(member: np.ndarray, center: np.ndarray) -> np.ndarray:
    """The labelled shingles of ``center`` that ``member`` has, in the order of their hashes, as far as they belong to its
    ``prefix`` where the shingles of the center come last."""
    common = np.intersect1d(labelled(member), labelled(center), assume_unique=True)
    return common[:max(0, prefix(len(member)) - len(member) + len(common))]


def verify(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (member, center, deal) with their similarity, null below the threshold, the number of shingles of the
    member (n) and how many of them the center has (inside), and where ``deal`` the ``prefix`` of ``apart``."""
    def judge(batches):
        for batch in batches:
            for part in slices(batch, "_a"):
                values, keys, sizes, inside = [], [], [], []
                for x, y, deal in zip(part.column("_a"), part.column("_b"), part.column("deal").to_pylist()):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    found = aligned(x, y, needed(len(x), len(y)))
                    values.append(found / (len(x) + len(y) - found) if found >= 0 else None)
                    outside = apart(x, y) if deal else x[:0]
                    keys.append(outside[:prefix(len(x))].astype(np.int64))
                    sizes.append(len(x))
                    inside.append(len(x) - len(outside) if deal else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("member"), part.column("center"), part.column("deal"), pa.array(values, pa.float64()),
                     pa.array(sizes, pa.int64()), pa.array(inside, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    ["member", "center", "deal", "similarity", "n", "inside", "apart"])

    return with_marks(pairs, marks).select("member", "center", "deal", "_a", "_b").mapInArrow(
        judge, "member binary, center binary, deal boolean, similarity double, n long, inside long, apart array<long>")


def with_marks(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The written ``pairs`` with the shingles of the member (_a) and of the center (_b)."""
    a = marks.select(F.col("words_key").alias("member"), F.col("marks").alias("_a"))
    b = marks.select(F.col("words_key").alias("center"), F.col("marks").alias("_b"))
    return a.join(small(pairs), "member").join(b, "center")


def contained(again: DataFrame, marks: DataFrame) -> DataFrame:
    """member, center, _mark: ``within`` of those members that may have all they share with a similar text in the center
    although one of the two misses it, as the center is longer or has another order.

    Two texts of n and m shingles share 4 / 9 (n + m) of them at least. If the center has all of those, 4 m is no more than
    9 inside - 4 n (reach), and the same holds the other way round.
    """
    again = again.withColumn("reach", F.expr("9 * inside - 4 * n")).where("5 * reach >= 16 * n")
    missed = again.where("similarity is null").groupBy("center").agg(F.min("n").alias("_low"), F.max("reach").alias("_top"))
    missed = settle(missed, "missed")
    found = again.join(small(missed), "center").where("4 * n <= _top and reach >= 4 * _low").select("member", "center")

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "_a"):
                keys = [within(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair)).astype(np.int64)
                        for pair in zip(part.column("_a"), part.column("_b"))]
                yield pa.RecordBatch.from_arrays([part.column("member"), part.column("center"), pa.array(keys, pa.list_(pa.int64()))],
                                                 ["member", "center", "within"])

    cuts = with_marks(settle(found, "contained"), marks).select("member", "center", "_a", "_b").mapInArrow(
        cut, "member binary, center binary, within array<long>")
    return settle(cuts, "within").select("member", "center", F.explode("within").alias("_mark"))


def links(docs: DataFrame, signed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Near-duplicate pairs (member, center, similarity) of words keys that hold every class together.

    Texts that agree in a sketch form a bucket. Every member is compared with a center, the member that shares most sketches
    with others (of a text and its edited copies that is the text, or the copy closest to it), and linked if it matches. Two
    members that both match are connected by that. Members outside the largest connected part of a bucket meet all that they
    are not connected with, if these are fewer than FEW * FEW pairs, and are compared with those whose bits let them be similar
    (``meetings``). No pairs of another bucket are listed. If one of two similar
    members does not match, they mostly have a shingle in common that the center lacks, as the center has too few of its
    shingles: so all members are dealt anew by such shingles (``apart``). Where the center may have all that they share, as
    it is longer or ordered differently, they are dealt by shingles of the center, too (``contained``). Buckets with members
    that no links connect so far go through the same in the next round, without the old center. Edits and surroundings differ between texts, so what goes on is
    little, and a passage that many texts share, which the center has as well, keeps no bucket together.
    """
    texts = signed.where("n_shingles > 0").groupBy("words_key").agg(
        F.min(F.struct("text_key", "doc_id")).alias("_first"), F.min_by("sketches", "text_key").alias("sketches"),
        F.min("n_shingles").alias("n_shingles"))
    texts = settle(texts.select("words_key", "_first.*", F.array_distinct("sketches").alias("sketches"),
                                "n_shingles", F.xxhash64("words_key").alias("short")), "texts")
    # Buckets are counted by short keys. Should two texts share one, a bucket has one more to be compared.
    entries = texts.select("short", F.explode("sketches").alias("bucket"))
    counts = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = settle(entries.join(counts, "bucket"), "buckets")
    degrees = shared.groupBy("short").agg(F.sum("size").alias("degree"))
    degrees = settle(texts.drop("sketches").join(degrees, "short"), "degrees")
    marks = shingle_table(docs, degrees.select("doc_id", "text_key", "words_key"), doc_id, text)
    rank = degrees.select(F.col("words_key").alias("member"), "degree", "n_shingles")
    members = settle(shared.join(degrees, "short").select("bucket", F.col("words_key").alias("member"), "degree", "n_shingles",
                                                           F.col("words_key").alias("root")), "members")
    # First every member meets the center of its buckets alone: copies of a text are mostly connected by that.
    center = members.groupBy("bucket").agg(F.max(F.struct("degree", "member", "n_shingles")).alias("_center"))
    members = settle(members.join(center, "bucket").withColumn("met", F.expr("member = _center.member")), "centered")
    near_center = members.where(
        "not met and 4 * (n_shingles + _center.n_shingles) <= 9 * least(n_shingles, _center.n_shingles)")
    pairs = settle(near_center.select("member", F.col("_center.member").alias("center"), F.lit(False).alias("deal")).distinct(), "pairs")
    judged = settle(verify(alike(pairs, marks), marks), "verified")
    roots = joined_roots(None, judged.where("similarity is not null").select(F.col("member").alias("a"), F.col("center").alias("b")))
    members = members.drop("root", "_center").join(roots, members.member == roots.node, "left").withColumn("root", F.coalesce("root", "member"))
    # The center has met all others of its bucket: only those can have something left to tell each other.
    split = members.where("not met").groupBy("bucket").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("bucket")
    members = settle(members.drop("node").join(split, "bucket"), "members")
    while not members.isEmpty():
        parts = members.groupBy("bucket", "root").agg(F.max(F.struct("degree", "member")).alias("_best"), F.count(F.lit(1)).alias("_n"))
        elected = parts.groupBy("bucket").agg(F.max("_best").alias("_center"), F.max(F.struct("_n", "root")).alias("_main"),
                                              ((F.sum("_n") - F.max("_n")) * F.sum("_n")).alias("_pairs"),
                                              F.ceil(F.sum("_n") / BLOCK).alias("blocks"))
        sized = settle(members.join(elected, "bucket").select(
            "bucket", "member", "root", "n_shingles", F.col("_center.member").alias("center"), (F.col("_pairs") >= FEW * FEW).alias("deal"),
            (F.col("root") == F.col("_main.root")).alias("main"), "met", "blocks"), "members")
        few = sized.where("not deal and not met").select("bucket", "member", "root", "main", "n_shingles", "blocks")
        pairs = sized.where("deal and member <> center").select("member", "center", "deal").unionByName(
            meetings(few, marks).withColumn("deal", F.lit(False)))
        pairs = settle(pairs.groupBy("member", "center").agg(F.bool_or("deal").alias("deal")), "pairs")
        before = judged.groupBy("member", "center").agg(F.bool_or("deal").alias("_dealt"))
        new = settle(pairs.join(before, ["member", "center"], "left").where("_dealt is null or deal and not _dealt").drop("_dealt"), "new")
        tried = settle(verify(new, marks), "verified")
        judged = judged.unionByName(tried)
        # Members judged in an earlier round are dealt again with those that meet the same center only now. Centers of one
        # chain of buckets rank ever lower, so the rounds end by themselves.
        again = settle(judged.where("deal").join(pairs.where("deal").select("member", "center"), ["member", "center"]), "again")
        if again.isEmpty():
            break
        roots = joined_roots(roots, tried.where("similarity is not null").select(F.col("member").alias("a"), F.col("center").alias("b")))
        # Where all members of a center are connected already, they have nothing to tell each other.
        rooted = again.join(roots, again.member == roots.node, "left").select("member", "center", F.coalesce("root", "member").alias("_root"))
        split = rooted.groupBy("center").agg(F.min("_root").alias("_a"), F.max("_root").alias("_b")).where("_a <> _b")
        again = settle(again.join(small(settle(split.select("center"), "split")), "center", "left_semi"), "again")
        dealt = again.select("member", "center", F.explode("apart").alias("_mark")).unionByName(contained(again, marks))
        dealt = dealt.join(roots, dealt.member == roots.node, "left").select(
            "member", F.coalesce("root", "member").alias("_root"), F.xxhash64("center", "_mark").alias("bucket"))
        wanted = dealt.groupBy("bucket").agg(F.min("_root").alias("_a"), F.max("_root").alias("_b"))
        wanted = wanted.where("_a <> _b").select("bucket")
        members = settle(dealt.join(wanted, "bucket").select("bucket", "member", F.col("_root").alias("root")).distinct().join(
            rank, "member").withColumn("met", F.lit(False)), "members")
    return judged.where("similarity is not null").select("member", "center", "similarity").distinct()


def joined_roots(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root under the links of ``roots`` (None at first) and those of ``edges`` (a, b) as well.

    Only the roots that new links join are connected anew."""
    if roots is None:
        return components(edges)
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    known = settle(roots.unionByName(ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))), "roots")
    a, b = (known.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in "ab")
    joins = settle(edges.join(a, "a").join(b, "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "joins")
    if joins.isEmpty():
        return known
    moved = small(components(joins).select(F.col("node").alias("_from"), F.col("root").alias("_to")))
    return settle(known.join(moved, known.root == moved["_from"], "left").select("node", F.coalesce("_to", "root").alias("root")), "roots")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` (a, b) is connected with.

    Every round a node takes the smallest root among its neighbours, then the root of that root, so long chains shorten
    geometrically. Sums and minima are formed before the exchange; the round's table is written.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    roots = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(roots, both.b == roots.node).groupBy("a").agg(F.min("root").alias("_near"))
        step = roots.join(near, roots.node == near.a).select("node", "root", F.least("root", "_near").alias("_new"))
        jump = roots.select(F.col("node").alias("_new"), F.col("root").alias("_far"))
        after = settle(step.join(jump, "_new", "left").select(
            "node", F.least("_new", F.coalesce("_far", "_new")).alias("root"), F.col("root").alias("_old")), "roots")
        moved = not after.where("root <> _old").isEmpty()
        roots = after.select("node", "root")
        if not moved:
            return roots


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sketches: int = SKETCHES) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links, kept.

    Similarity: runs of five words (letters and digits, lower case; a shorter text is one run) of both texts are aligned
    in order, and the aligned ones divided by all; 0.8 or more makes a link. Classes are what links connect; class_id is
    their smallest doc_id, and that document stays. n_links counts the links verified for the text of the document.

    Texts with the same words are one class from the start, whatever their number. Texts without words (null, empty,
    punctuation only) are only alike if they are identical, null counting as empty. Null ids come last; a class of null
    ids only has a null class_id and keeps its rows. Repeated rows belong to one class and share its fate. An empty
    table gives an empty result. Only doc_id and text are read, and whole.
    """
    signed = signatures(docs, doc_id, text, sketches)
    return classes(signed, links(docs, signed, doc_id, text)).drop("text_key")


def classes(signed: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text_key, class_id, class_size, n_links, kept of all rows of ``signatures`` under the links ``found``."""
    roots = components(found.select(F.col("member").alias("a"), F.col("center").alias("b")))
    degree = found.select("member").union(found.select("center")).groupBy("member").agg(F.count(F.lit(1)).alias("n_links"))
    known = roots.join(degree, roots.node == degree.member).select(F.col("node").alias("words_key"), "root", "n_links")
    # Only linked texts are in ``known``; all others are their own roots.
    rows = signed.select("doc_id", "text_key", "words_key").join(known, "words_key", "left").select(
        "doc_id", "text_key", F.coalesce("root", "words_key").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = settle(rows, "classes")
    sums = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(sums, "root").select("doc_id", "text_key", "class_id", "class_size", "n_links",
                                          F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, in their own columns; texts are exchanged only where more rows go than can be
    replicated."""
    signed = signatures(docs, doc_id, text)
    gone = classes(signed, links(docs, signed, doc_id, text)).where("not kept")
    gone = small(settle(gone.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_gone")).distinct(), "gone"))
    held = docs.withColumn("_key", F.unhex(F.md5(text_of(docs, text))))
    out = held.join(gone, held[doc_id].eqNullSafe(gone["_id"]) & (held["_key"] == gone["_gone"]), "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
