"""Best-fit packing of documents into sequences of a fixed length."""

import json
import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.llm.alignment import byte_letters
from runlens.llm.memory import Memory
from runlens.llm.tables import settle, short_batches, slices, text_of

CAPACITY = 2048
# Words whose ids a worker remembers, and the longest word it remembers.
MEMORY = 64 << 20
WORD = 64
STOPS = ".,;:!?"
# Python splits words at these, Unicode does not count them as white space.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
# The pattern that cuts a normalised text into words, a fixed value, and how it is normalised before.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
# Beyond Latin and Cyrillic letters and common punctuation; in these NFC changes nothing, lower case goes letter by letter,
# and no version of Unicode disputes what is a letter, a digit or white space.
_BEYOND = re.compile("[^\0-\x1b\x20-\u012f\u0131-\u017f\u0400-\u045f\u2010-\u2027\u20ac\u2122]")
_SPACES = "\t\n\x0b\x0c\r\x85\xa0"
# Of such texts in lower case, what PATTERN takes as words besides runs of letters.
_APART = re.compile("'(?:[stmd]|re|ve|ll)|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^ 0-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff\u0100-\u017f\u0400-\u045f]+")


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit integers.

    For vocabularies that drop white space and never join across it. tiktoken, which is faster, makes the ids of texts in
    Latin and Cyrillic letters if the vocabulary allows it (``ranked``). Of other texts each different word is encoded once while
    remembered, by the tokenizers library: many words in one call, joined by the first special string of the vocabulary,
    whose id then separates them.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        added = sorted(told["added_tokens"], key=lambda t: t["id"])
        self.mark, self.special = next((t["id"], t["content"]) for t in added if t["special"])
        self.specials = [t["content"] for t in added]
        self.ranked = _ranked(told)
        self.memory = Memory(MEMORY)

    @cached_property
    def tokenizer(self):
        # Spark's tasks are the parallelism.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def plain(self, text: str) -> bytes | None:
        """The ids by tiktoken, or None if the text is one for the library."""
        if self.ranked is None or _BEYOND.search(text) or any(s in text for s in self.specials):
            return None
        for space in _SPACES:
            text = text.replace(space, " ")
        return _packed(self.ranked.encode_ordinary(_APART.sub(r" \g<0> ", text.lower()) + " "))

    def raw(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of different words. Of those for the library, where a word ends in stops, the pattern of the vocabulary splits it before them."""
        done = {w: ids for w in words if (ids := self.plain(w)) is not None}
        words = [w for w in words if w not in done]
        cut = {w: core for w in words if (core := w.rstrip(STOPS)) != w and core[-1:].isalnum()}
        cores = {c.lower() if c.isascii() else c for c in cut.values()}
        tails = {w[len(c):] for w, c in cut.items()}
        once = self.encoded(list(cores.union(tails, (w for w in words if w not in cut))))
        return done | {w: once[w] if w not in cut else once[c.lower() if (c := cut[w]).isascii() else c] + once[w[len(c):]] for w in words}

    def encoded(self, words: list[str]) -> dict[str, bytes]:
        # Plain letters are one pre-token and their bytes stand for themselves, so the model can have them directly.
        model = self.tokenizer.model
        out = {w: _packed([t.id for t in model.tokenize(w.lower())]) for w in words if w.isascii() and w.isalpha()}
        plain = [w for w in words if w not in out and len(w) <= WORD and not any(s in w for s in self.specials)]
        for start in range(0, len(plain), 2000):
            part = plain[start:start + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([self.special.join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            whole = ids.tobytes()
            out |= {w: whole[4 * a + 4:4 * b] for w, a, b in zip(part, [-1, *ends], ends)}
        odd = [w for w in words if w not in out]
        return out | dict(zip(odd, self.raw(odd)))

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [self.plain(t) for t in texts]
        cut = {i: texts[i].split() for i, ids in enumerate(out) if ids is None and not _ODD_SPACE.search(texts[i])}
        if cut:
            look = self.memory.ready(set().union(*cut.values()), self.learn).__getitem__
        return [ids if ids is not None else b"".join(map(look, cut[i])) if i in cut else self.raw([texts[i]])[0] for i, ids in enumerate(out)]


def _ranked(told: dict):
    """A vocabulary file's merges in tiktoken, or None if the ids are not the ranks of the merges or texts are cut otherwise.

    The suffix that ends a word is a space there, which no word holds: a piece is a word and the space after it. Joining a last byte
    with its space comes before all merges, as its id does. As every merge joins earlier ones, the least id is the next merge.
    """
    model, normal, cut = told["model"], told["normalizer"] or {}, told["pre_tokenizer"] or {}
    vocab, suffix = model.get("vocab") or {}, model.get("end_of_word_suffix")
    steps = [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
             {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    usual = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
    if model.get("type") != "BPE" or not suffix or normal.get("normalizers") != NORMAL or cut.get("pretokenizers") != steps \
            or any((model.get(k) or None) != (v or None) for k, v in usual.items()) or any(t["normalized"] for t in told["added_tokens"]):
        return None
    letters = byte_letters()
    singles = [*letters, *[x + suffix for x in letters]]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    first = {vocab.get(x) for x in letters} == {*range(256)} and {vocab.get(x) for x in singles} == {*range(512)}
    made = [vocab.get(x + y) for x, y in merges] == [*range(512, 512 + len(merges))]
    if not first or not made or any(max(vocab[x], vocab[y]) >= i for i, (x, y) in enumerate(merges, 512)):
        return None
    space = next(x for x, b in letters.items() if b == 32)
    if any(space in x + y for x, y in merges):
        return None
    import tiktoken

    spelled = {t: bytes(letters[c] for c in t.removesuffix(suffix)) + b" " * t.endswith(suffix)
               for t in [*singles, *[x + y for x, y in merges]]}
    return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks={spelled[t]: vocab[t] for t in spelled}, special_tokens={})


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = "piece int, start long, length long, ids_crc32 long, task int, rank long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents, written once: doc_id, ``PIECES``.

    A document is its ids followed by ``end_id``; only one longer than ``capacity`` is cut. ``rank`` numbers the pieces
    of one length that one task has made, from 0.
    """
    plain = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    end, width = end_id.to_bytes(4, "little"), 4 * capacity

    def cut(batches):
        from pyspark import TaskContext

        mine, task, ranks = encoder(vocabulary), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for part in slices(batch, "text"):
                source, rows = [], []
                for at, ids in enumerate(mine.encode(part.column("text").to_pylist())):
                    ids += end
                    for number, start in enumerate(range(0, len(ids), width)):
                        piece = ids[start:start + width]
                        length = len(piece) // 4
                        source.append(at)
                        rows.append((number, start // 4, length, zlib.crc32(piece), task, ranks[length]))
                        ranks[length] += 1
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = [c.split()[0] for c in PIECES.split(", ")]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(source, pa.int64())), *columns],
                                                 ["doc_id", *names])

    with short_batches(docs.sparkSession):
        return settle(plain.mapInArrow(cut, f"doc_id {kind}, {PIECES}"), "pieces")


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Where the documents of each length go: rows (length, first rank, count, first sequence, offset).

    Documents of one length are alike, and so are gaps of one size, so the state is two sorted class tables, documents
    by length and gaps by size, of at most ``capacity`` entries each however many documents there are. Every superstep
    takes the longest documents that are left, sweeps the gaps upwards from the smallest that holds them, hands out the
    gaps of each class by rank (the documents first in rank get them; those beyond go on to the next class), opens new
    sequences for those who found none, and turns the filled gaps into smaller ones.

    Sequences with equal histories stay together as one interval of sequence numbers; a superstep splits an interval at
    most once beyond the full ones it takes.
    """
    sizes, gaps, plan, opened = [], {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                first, n = gaps[size][-1]
            else:
                # No gap holds them. One new sequence takes as many as fit; the rest of it stays a gap.
                size, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
                gaps.setdefault(size, []).append((first, n))
                insort(sizes, size)
            take = min(n, left)
            if take == n:
                gaps[size].pop()
                if not gaps[size]:
                    del gaps[size]
                    sizes.remove(size)
            else:
                gaps[size][-1] = (first + take, n - take)
            plan.append((length, rank, take, first, capacity - size))
            if size > length:
                if size - length not in gaps:
                    gaps[size - length] = []
                    insort(sizes, size - length)
                gaps[size - length].append((first, take))
            rank, left = rank + take, left - take
    return plan


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``made`` (of ``pieces``) with sequence_id and offset in place of task and rank.

    Bulk-synchronous best fit: documents are range-sorted into classes by length; ``sweep`` matches classes of documents
    with classes of gaps in supersteps; a document's place in its class, its rank, decides which gap of the class it
    gets. Ranks come from the number within a task plus the counts of the tasks before, so no task sees a whole class,
    even if one length makes up most of the table. The driver handles one count per length, at most ``capacity``.
    """
    spark = made.sparkSession
    per_task = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = sweep(counts, capacity)
    # The plan has a few rows per length, whatever the number of documents: classes split, documents do not.
    steps = spark.createDataFrame(plan, "length long, first_rank long, count long, first_sequence long, offset long")
    steps = steps.groupBy("length").agg(F.sort_array(F.collect_list(
        F.struct("first_rank", "first_sequence", "offset"))).alias("_steps"))
    ranked = made.join(bases, ["length", "task"]).withColumn("_rank", F.col("base") + F.col("rank"))
    placed = ranked.join(F.broadcast(steps), "length").withColumn("_step", F.element_at(F.filter(
        "_steps", lambda s: s["first_rank"] <= F.col("_rank")), -1))
    return placed.select(*[c for c in made.columns if c not in ("task", "rank")],
                         (F.col("_step.first_sequence") + F.col("_rank") - F.col("_step.first_rank")).alias("sequence_id"),
                         F.col("_step.offset").alias("offset"))


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0,
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Ids are those of the tokenizers library for the vocabulary without added special tokens, then ``end_id``. Null and
    empty texts are a single ``end_id``; texts longer than ``capacity`` tokens are cut into full pieces and a rest.
    Every row makes its own pieces, so repeated rows are packed each and null ids are kept. An empty table gives no
    rows. Only doc_id and text are read.
    """
    return pack(pieces(docs, vocabulary, capacity, end_id, doc_id, text), capacity)


def sequences(spark: SparkSession, placed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, n_pieces, length."""
    return placed.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("length").alias("length"))
