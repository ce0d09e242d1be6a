import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from runlens.llm import packing, tables, token_counts
from tests.llm.small import AWKWARD, DOCS, documents

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a \nb", "a\n ", "x<|endoftext|> y <|endoftext|>", "it's  we'll\t'x",
       "z\x1cq \x1f", "12 345 6.7!! ??", "a" * 500 + " " + "b c" * 300, "<|startoftext|>hi", "a\r\n b\x85c \x85",
       "Σας ΣΑΣ İI ı", "<|endo ftext|>", "ﬁ ½ ä́ ́ b"]


@pytest.fixture(scope="module")
def texts():
    draw, alphabet = random.Random(1), [*"ab'st. \n\t \x1c\x851é́!-\r　", "<|endoftext|>", "'re"]
    return ODD + ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 30))) for _ in range(3000)]


def test_counts_are_those_of_the_library(texts):
    want = [len(e) for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter(BYTES).counts(texts) == want


def test_ids_are_those_of_the_library(texts):
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.Encoder(WORDS).encode(texts)] == want


def test_latin_and_cyrillic_texts_need_no_words_of_the_library(texts, monkeypatch):
    letters, draw = packing.byte_letters(), random.Random(3)
    with open(WORDS, encoding="utf-8") as file:
        names = [t.removesuffix("</w>") for t in json.load(file)["model"]["vocab"]]
    words = [bytes(letters[c] for c in t).decode("utf-8", "ignore") for t in names if all(c in letters for c in t)]
    alphabet = [chr(c) for c in (*range(0x180), *range(0x400, 0x460), *range(0x2010, 0x2028), 0x20ac, 0x2122)]
    some = [*texts, *words, *(w + draw.choice(words) for w in words), *(w + w for w in words), "ab" * 5000,
            *("".join(draw.choice(alphabet + ["'s", "'LL", " "] * 9) for _ in range(draw.randint(0, 25))) for _ in range(20000))]
    mine = packing.Encoder(WORDS)
    monkeypatch.setattr(mine, "learn", None)
    got = {t: ids for t in some if (ids := mine.plain(t)) is not None}
    assert len(got) > 100_000 and all(mine.encode([t]) for t in ("don't", "Straße 12", "naïve\xa0½", "мир — да"))
    want = Tokenizer.from_file(WORDS).encode_batch_fast(list(got), add_special_tokens=False)
    assert [t for (t, ids), e in zip(got.items(), want) if ids != packing._packed(e.ids)] == []
    assert all(mine.plain(t) is None for t in ("x<|endoftext|>", "İ", "ΣΑΣ", "a\x1cb", "e\u0301", "你"))


@pytest.mark.parametrize("change", ["merges", "pattern", "normalizer", "id"])
def test_other_vocabularies_are_left_to_the_library(change, tmp_path):
    with open(WORDS, encoding="utf-8") as file:
        told = json.load(file)
    model = told["model"]
    if change == "merges":
        model["merges"][1000:1002] = model["merges"][1001], model["merges"][1000]
    elif change == "pattern":
        told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\S+"
    elif change == "normalizer":
        told["normalizer"]["normalizers"].pop()
    else:
        model["vocab"]["in"], model["vocab"]["th"] = model["vocab"]["th"], model["vocab"]["in"]
    path = tmp_path / "words.json"
    path.write_text(json.dumps(told))
    mine, lib = packing.Encoder(str(path)), Tokenizer.from_file(str(path))
    assert mine.ranked is None
    assert mine.encode(["in the inn"]) == [packing._packed(lib.encode("in the inn", add_special_tokens=False).ids)]


def test_forgetting_changes_nothing(texts, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY", 50)
    small, large = token_counts.Counter(BYTES), token_counts.Counter(BYTES)
    assert [small.counts(texts[i:i + 40]) for i in range(0, 400, 40)] == [large.counts(texts[i:i + 40]) for i in range(0, 400, 40)]


def test_token_counts(spark):
    tokenizer = Tokenizer.from_file(BYTES)
    got = token_counts.token_counts(documents(spark, AWKWARD), BYTES, limit=10).collect()
    want = [(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t in AWKWARD]
    assert sorted(map(str, [(r.doc_id, r.n_bytes, r.n_tokens) for r in got])) == sorted(map(str, want))
    assert all(r.over_limit == (r.n_tokens > 10) for r in got)
    assert token_counts.token_counts(spark.createDataFrame([], DOCS), BYTES).count() == 0


def test_workers_keep_no_words_and_get_short_batches(spark):
    mine = packing.Encoder(WORDS)
    mine.encode([f"wort{i} слово{i} größe {i}" for i in range(2000)])
    assert not mine.memory.young and "tokenizer" not in vars(mine)

    def rows_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    name, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(0, 2000, 1, 1)
    before = spark.conf.get(name)
    with tables.short_batches(spark, 300):
        got = [r.n for r in rows.mapInArrow(rows_of, "n long").collect()]
    assert sum(got) == 2000 and max(got) <= 300 and spark.conf.get(name) == before


def test_sweep_is_best_fit_decreasing():
    draw = random.Random(2)
    for capacity in (10, 64):
        lengths = [min(capacity, int(draw.expovariate(0.15)) + 1) for _ in range(500)]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.sweep(counts, capacity)
        filled, placed = {}, {}
        for length, first_rank, n, first, offset in plan:
            placed.setdefault(length, []).extend(range(first_rank, first_rank + n))
            for s in range(first, first + n):
                assert filled.get(s, 0) == offset
                filled[s] = offset + length
        assert max(filled.values()) <= capacity
        assert all(placed[n] == list(range(counts[n])) for n in counts)
        gaps = []
        for n in sorted(lengths, reverse=True):
            fit = min((g for g in gaps if g >= n), default=None)
            gaps.append((capacity if fit is None else fit) - n)
            if fit is not None:
                gaps.remove(fit)
        assert len(filled) <= len(gaps) + 1 and sorted(filled) == list(range(len(filled)))


def test_packing(spark):
    rows = AWKWARD + [(100 + i, f"same words {i % 7}") for i in range(300)]
    got = packing.packed_documents(documents(spark, rows).repartition(9), WORDS, capacity=64).collect()
    tokenizer, want = Tokenizer.from_file(WORDS), []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(i, k, a, len(ids[a:a + 64]), zlib.crc32(np.array(ids[a:a + 64], "<u4").tobytes()))
                 for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted(map(str, [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got])) == sorted(map(str, want))
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(at) <= -(-sum(r.length for r in got) // 64) * 1.03 + 1
    assert packing.packed_documents(spark.createDataFrame([], DOCS), WORDS).count() == 0
