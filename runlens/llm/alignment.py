"""Alignment of two tokenizers over a corpus, as an Arrow pipeline over flattened token lists."""

import hashlib
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.tables import settle, slices, small, text_of

# Bytes of text whose tokens are aligned at a time.
BATCH_BYTES = 4 << 20
# Different id pairs that a task counts before it hands them on.
PARTIAL = 500_000
# Counted id pairs, of 17 bytes each, that are replicated; more are joined by exchange.
REPLICATED_PAIRS = 2_000_000
# The pattern of byte-level vocabularies, a fixed value: contractions, then letters, digits or other signs after a space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters beyond Latin, Greek and Cyrillic, and runs that a pattern match may make very long.
_SLOW = re.compile("[^\u0000-\u052f]|\\S{1000}|\\s{1000}")
ROW = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, counts array<int>"


def byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable ones for themselves, the others in order for
    the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """A byte-level vocabulary of tokenizers (A) and one of sentencepiece (B) with its leading space.

    Both take special strings as plain text. ``a_bytes`` and ``b_bytes`` hold the bytes of every id. A's merges are
    ranked by their ids in vocabularies of this kind; then tiktoken, which is faster, makes the same ids for texts in scripts
    whose letters no version of Unicode disputes, and the library itself for all others and for very long words.
    """

    def __init__(self, path_a: str, path_b: str):
        # Spark's tasks are the parallelism.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        spelled = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
        self.a_bytes = pa.array(spelled, pa.large_binary())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                                 for i, p in enumerate(pieces)], pa.large_binary())
        self.fast = self._ranked(path_a, names, spelled)
        # Every id as it stands in a text of groups, with what may follow it.
        self.n_a, self.n_b = len(names), len(pieces)
        self.words = pa.array([f"{i}{s}".encode() for i in range(self.n_a) for s in (",", "|")]
                              + [f"{i}{s}".encode() for i in range(self.n_b) for s in (",", ";", "")], pa.large_binary())

    @staticmethod
    def _ranked(path: str, names: list[str], spelled: list[bytes]):
        """A's encoding in tiktoken, or None if its ids are not the ranks of its merges or its pattern is another one."""
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, split = told["model"], told["pre_tokenizer"] or {}
        at = {name: i for i, name in enumerate(names)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if told["normalizer"] or not plain or model.get("ignore_merges") or [at.get(x + y) for x, y in merges] != [*range(256, 256 + len(merges))]:
            return None
        import tiktoken

        ranks = {spelled[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        """The ids of space + text under A and of the text under B; none of empty texts."""
        a = [None if not t else self.fast.encode_ordinary(" " + t) if self.fast and not _SLOW.search(t) else t for t in texts]
        slow = [i for i, ids in enumerate(a) if isinstance(ids, str)]
        for i, e in zip(slow, self.a.encode_batch_fast([" " + a[i] for i in slow], add_special_tokens=False)):
            a[i] = e.ids
        b = [x if t else _NONE for t, x in zip(texts, self.b.encode(texts, out_type="numpy", num_threads=1))]
        return _lists([_NONE if x is None else np.frombuffer(array("i", x), np.int32) for x in a]), _lists(b)


_NONE = np.empty(0, np.int32)


def _lists(parts: list[np.ndarray]) -> pa.LargeListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.concatenate([_NONE, *parts])))


_PAIRS: dict[tuple, Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    """The worker's own pair; it outlives tasks where Python workers are reused."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def _same(texts: list[bytes], lengths: np.ndarray, joined: pa.Array) -> np.ndarray:
    """Which documents have the bytes of their tokens, ``joined`` being those of all in a row."""
    wanted = np.array([len(t) for t in texts], np.int64)
    data = memoryview(joined.buffers()[2]).cast("B") if len(joined) else memoryview(b"")
    if (wanted == lengths).all() and data[:lengths.sum()] == memoryview(b"".join(texts)):
        return np.ones(len(texts), bool)
    ends = np.cumsum(lengths)
    return np.array([n == m and data[e - n:e] == t for t, n, m, e in zip(texts, lengths.tolist(), wanted.tolist(), ends.tolist())], bool)


def _side(lists: pa.LargeListArray, table: pa.Array, texts: list[bytes]):
    """The tokens of a batch under one tokenizer: ids, documents, byte lengths, and which documents they spell."""
    ids, docs = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    lengths = pc.binary_length(table).take(ids).to_numpy()
    per_doc = np.bincount(docs, lengths, len(texts)).astype(np.int64)
    return ids, docs, lengths, _same(texts, per_doc, table.take(ids))


def _keyed(ids, docs, lengths, good: np.ndarray, name: str) -> tuple[pa.Table, np.ndarray]:
    """(key, id) of the tokens of documents that both tokenizers spell. The key is document and end: a sum of lengths
    that starts anew with every document."""
    if not good.all():
        keep = good[docs]
        ids, docs, lengths = ids.filter(pa.array(keep)), docs[keep], lengths[keep]
    total = pc.cumulative_sum(pa.array(lengths, pa.int64())).to_numpy()
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    before = (total - lengths)[first] if len(first) else total
    ends = total - np.repeat(before, np.diff(np.append(first, len(docs))))
    return pa.table({"key": pa.array((docs << 32) + ends), name: ids}), docs


def align(mine: Pair, texts: list[str], keep_groups: bool = False) -> dict[str, pa.Array]:
    """The columns ``ROW`` of texts.

    Tokens of both sides are joined by document and end (a full hash join): every row is a stretch of bytes that one token
    of each side covers, which is a link, and those with an end of both sides close a group.
    """
    n = len(texts)
    whole = [b" " + t.encode() for t in texts]
    a, b = (_side(lists, table, whole) for lists, table in zip(mine.encode(texts), (mine.a_bytes, mine.b_bytes)))
    good = a[3] & b[3] & np.array([bool(t) for t in texts], bool)
    left, docs_a = _keyed(*a[:3], good, "a")
    right, docs_b = _keyed(*b[:3], good, "b")

    met = left.join(right, "key", join_type="full outer", use_threads=False).combine_chunks()
    met = met.take(pa.array(np.argsort(met.column("key").to_numpy(), kind="stable")))
    docs = met.column("key").to_numpy() >> 32
    has_a, has_b = (met.column(c).is_valid().to_numpy() for c in "ab")
    closes = has_a & has_b
    group = np.cumsum(closes, dtype=np.int32) - closes
    linked = [pc.fill_null_backward(met.column(c).combine_chunks()) for c in "ab"]
    codes = pc.add(pc.multiply(linked[0].cast(pa.int64()), mine.n_b), linked[1])
    counted = pa.table({"document": docs, "pair": codes}).group_by(["document", "pair"], use_threads=False).aggregate([([], "count_all")])
    counted = counted.sort_by("document") if np.any(np.diff(counted.column("document").to_numpy()) < 0) else counted
    sizes = np.bincount(counted.column("document").to_numpy(), minlength=n)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())

    # Where each token stands in the text of groups: after all tokens of earlier groups, A's before B's.
    of_a, of_b = group[has_a], group[has_b]
    n_groups = int(closes.sum())
    to_a, to_b = np.cumsum(np.bincount(of_a, minlength=n_groups)), np.cumsum(np.bincount(of_b, minlength=n_groups))
    at_a, at_b = np.arange(len(of_a)), np.arange(len(of_b))
    words = np.empty(len(of_a) + len(of_b), np.int64)
    before = np.concatenate([[0], to_b])
    words[at_a + before[of_a]] = 2 * left.column("a").to_numpy().astype(np.int64) + (at_a + 1 == to_a[of_a])
    last = np.append(docs_b[1:] != docs_b[:-1], [True] * (len(docs_b) > 0))
    follows = np.where(last, 2, at_b + 1 == to_b[of_b])
    words[at_b + to_a[of_b]] = 2 * mine.n_a + 3 * right.column("b").to_numpy().astype(np.int64) + follows
    joined = mine.words.take(pa.array(words))
    n_a, n_b = np.bincount(docs_a, minlength=n), np.bincount(docs_b, minlength=n)
    places = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)[np.concatenate([[0], np.cumsum(n_a + n_b)])] \
        if len(joined) else np.zeros(n + 1, np.int64)
    data = memoryview(joined.buffers()[2]).cast("B") if len(joined) else memoryview(b"")
    spans = [data[x:y] for x, y in zip(places[:-1].tolist(), places[1:].tolist())]
    return {"n_a": pa.array(n_a, pa.int64()), "n_b": pa.array(n_b, pa.int64()),
            "n_groups": pa.array(np.bincount(docs, closes, n).astype(np.int64)),
            "n_links": pa.array(np.bincount(docs, minlength=n), pa.int64()),
            "groups_sha256": pa.array([hashlib.sha256(s).hexdigest() if len(s) else "" for s in spans], pa.string()),
            "groups": pa.array([str(s, "ascii") if keep_groups else None for s in spans], pa.string()),
            "pairs": pa.ListArray.from_arrays(offsets, counted.column("pair").combine_chunks()),
            "counts": pa.ListArray.from_arrays(offsets, counted.column("count_all").combine_chunks().cast(pa.int32()))}


def aligned(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False, doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """One row per document, written: row (a number of its own), doc_id, ``ROW`` and size_b, by which a pair is divided
    into its ids of A and B. ``pairs`` and ``counts`` say how many links of the document hold which pair."""
    plain = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def make(batches):
        mine = pair(path_a, path_b)
        for batch in batches:
            for part in slices(batch, "text", rows=4096, most=BATCH_BYTES):
                columns = align(mine, part.column("text").to_pylist(), keep_groups)
                # The pool would keep what a batch took at most.
                pa.default_memory_pool().release_unused()
                sizes = pa.array([mine.n_b] * part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns.values(), sizes],
                                                 ["doc_id", *columns, "size_b"])

    rows = plain.mapInArrow(make, f"doc_id {kind}, {ROW}, size_b long")
    return settle(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n, best: how many links of the corpus hold an id pair, and whether no pair with its id of B has more. Tasks
    count with Table.group_by, Spark adds their counts up."""
    def count(batches):
        held, size = [], 0

        def folded():
            table = pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")])
            return table.rename_columns(["pair", "n"])

        for batch in batches:
            held.append(pa.table({"pair": pc.list_flatten(batch.column("pairs")),
                                  "n": pc.list_flatten(batch.column("counts")).cast(pa.int64())}))
            size += held[-1].num_rows
            if size > 4 * PARTIAL:
                held = [folded()]
                size = held[0].num_rows
                if size > PARTIAL:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if size:
            yield from folded().to_batches()

    found = rows.select("pairs", "counts").mapInArrow(count, "pair long, n long")
    size = rows.select("size_b").first()
    counts = settle(found.groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    counts = counts.withColumn("_b", F.col("pair") % (size.size_b if size else 1))
    highest = counts.groupBy("_b").agg(F.max("n").alias("_most"))
    return settle(counts.join(highest, "_b").select("pair", "n", (F.col("n") == F.col("_most")).alias("best")), "best_pairs")


def alignment(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False, doc_id: str = "doc_id",
              text: str = "text", replicated: int = REPLICATED_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups (the text of
    ids, ``a1,a2|b1;a3|b2``; null unless ``keep_groups``).

    A encodes space + text (tokenizers, byte-level), B the text (sentencepiece, which adds the space); special strings in
    texts are plain text. Offsets where tokens of both end cut a document into groups. Tokens of A and B whose bytes overlap
    are linked; a pair of ids counts as many links as hold it in the whole corpus. n_best: links whose pair has the highest
    count of those with its id of B, ties included. count_sum: the counts of all links, added up.

    Texts that are null or empty, or that the joined bytes of either side do not spell, have no tokens: zeros and empty
    texts. Null ids are kept and repeated rows counted each; an empty table gives no rows. Only doc_id and text are
    read. Ids and pairs of the corpus are bounded by the vocabularies; their counts are replicated if they are ``replicated``
    rows or fewer, and joined by exchange, where hot pairs can be split, if there are more.
    """
    rows = aligned(docs, path_a, path_b, keep_groups, doc_id, text)
    counts = small(pair_counts(rows), replicated)
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("_held")).select("row", "_held.pairs", "_held.counts")
    sums = each.join(counts, each.pairs == counts.pair).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("counts"))).alias("n_best"), F.sum(F.col("n") * F.col("counts")).alias("count_sum"))
    return rows.drop("pairs", "counts", "size_b").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), "groups_sha256", "groups")
