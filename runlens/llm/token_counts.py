"""Token counts of whole texts."""

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.memory import Memory
from runlens.llm.tables import slices, text_of

# Bytes of text that are encoded at a time.
BATCH_BYTES = 4 << 20
# Counts of pieces that a worker remembers, and the longest piece it remembers.
MEMORY = 200 << 20
PIECE = 64
STOPS = ".,;:!?"
# A piece begins at a space that is followed by something else than white space: the tokenizer's own pattern ends a
# match there, whatever stands before. _UNEVEN finds the texts in which some space is no such place.
_UNEVEN = re.compile(r" (?=\s)|\s \Z")
_SAFE = re.compile(r"(?<=[^ ])(?= \S)")


class Counter:
    """Counts the tokens of texts with the tokenizers library, each different piece once while it is remembered.

    ``special`` is a special string of the vocabulary: as the tokenizer cuts a text at special strings before anything
    else, many pieces joined by it are encoded in one call and their counts read off between its ids.
    """

    def __init__(self, path: str, special: str = "<|endoftext|>"):
        # Spark's tasks are the parallelism.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special, self.mark = special, self.tokenizer.token_to_id(special)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = Memory(MEMORY)

    def pieces(self, text: str) -> list[str]:
        """The text cut at safe boundaries; what lies between special strings is cut, they themselves never."""
        if _UNEVEN.search(text):
            return _SAFE.split(text)
        first, *rest = text.split(" ")
        return [first, *[f" {x}" for x in rest]] if not rest or rest[-1] else [first, *[f" {x}" for x in rest[:-1]], " "]

    def learn(self, pieces: list[str]) -> dict[str, int]:
        """Counts of different pieces. Where a piece ends in stops, the pattern of the vocabulary splits it before them."""
        cut = {p: core for p in pieces if (core := p.rstrip(STOPS)) != p and core[-1:].isalnum()}
        tails = {p[len(c):] for p, c in cut.items()}
        once = self.counted(list({*cut.values(), *tails, *(p for p in pieces if p not in cut)}))
        return {p: once[p] if p not in cut else once[cut[p]] + once[p[len(cut[p]):]] for p in pieces}

    def counted(self, pieces: list[str]) -> dict[str, int]:
        plain = [p for p in pieces if len(p) <= PIECE and not any(s in p for s in self.specials)]
        out = {}
        for start in range(0, len(plain), 2000):
            part = plain[start:start + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([self.special.join(part)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(np.append(ids, self.mark) == self.mark)
            out |= zip(part, (np.diff(ends, prepend=-1) - 1).tolist())
        odd = [p for p in pieces if p not in out]
        for piece, got in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            out[piece] = len(got)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in texts]
        look = self.memory.ready(set().union(*cut), self.learn).__getitem__
        return [sum(map(look, c)) for c in cut]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's own counter for a vocabulary; it outlives tasks where Python workers are reused."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    The counts are those of the tokenizers library for the vocabulary file (byte-level BPE whose special string is
    ``<|endoftext|>``) without begin, end or added special tokens; special strings inside texts are recognised as the
    library does by default. Null texts count as empty: 0 bytes, 0 tokens. Repeated rows are counted each; null ids are
    kept. Only doc_id and text are read. Lengths alone return to Spark; nothing is shuffled.
    """
    plain = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"))

    def count(batches):
        mine = counter(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", rows=4096, most=BATCH_BYTES):
                texts = part.column("text").to_pylist()
                n = mine.counts(texts)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()), pa.array([c > limit for c in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
