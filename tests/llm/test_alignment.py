import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from runlens.llm import alignment
from tests.llm.small import AWKWARD, documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """(id, bytes) of both sides; nothing if either does not spell space + text."""
    if not text:
        return [], []
    a, b = libraries
    letters = {}
    for byte in range(256):
        letters[chr(byte) if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174 else None] = byte
    rest = iter(range(256, 512))
    letters = {(chr(x) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174 else chr(next(rest))): x for x in range(256)}
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    same = b"".join(x for _, x in left) == whole == b"".join(x for _, x in right)
    return (left, right) if same else ([], [])


def spans(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(libraries, rows):
    parts, links = [], []
    for _, text in rows:
        a, b = map(spans, tokens(libraries, text))
        links.append([(x, y) for x, s, e in a for y, t, f in b if s < f and t < e])
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)))
            start = end
        parts.append((len(a), len(b), len(groups), ";".join(groups)))
    counts = Counter(p for some in links for p in some)
    most = {}
    for (x, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    return [(doc, n_a, n_b, n_g, len(some), sum(counts[p] == most[p[1]] for p in some), sum(counts[p] for p in some),
             hashlib.sha256(text.encode()).hexdigest() if text else "", text)
            for (doc, _), (n_a, n_b, n_g, text), some in zip(rows, parts, links)]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v) for v in r))


TEXTS = ["hello world", "  two  spaces ", "line\n next\n\n  more \t x", " ", "  ", "\n", "a ", "tail  ", "x▁y z",
         "<|endoftext|> and <s> </s> <unk> <0x41>", "don't we'll o'clock", "naïve Straße 漢字かな 😀👍🏽", "\x00\x1c nul \x1f sep",
         "1234567890 3.14159", "http://a.b/c?d=e&f", " no break ", "MiXeD CaSe", "...!!! ???", "word, word; word: word.", "é", "​‍"]


def test_agrees_with_brute_force(spark, libraries):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(i, t[:3000] if t else t) for i, t in [r[:2] for r in AWKWARD]]
    df = documents(spark, rows).withColumns({c: F.lit(1) for c in ("pairs", "counts", "n", "best", "size_b", "groups")})
    for replicated in (1000, 0):
        got = alignment.alignment(df, A, B, keep_groups=True, replicated=replicated)
        assert in_order(got.collect()) == in_order(brute(libraries, rows))
    assert alignment.alignment(df.limit(0), A, B).collect() == []


def test_pieces_are_encoded_as_the_whole_text_is(libraries):
    """Texts made of all kinds of neighbours, cut at safe places, give the ids of the uncut text."""
    import random
    chooser, mine = random.Random(5), alignment.pair(A, B)
    atoms = [" ", " ", " ", "  ", "\n", "\t", " ", "\x1c", "　", "word", "Word", "x", "'s", "12", ".", ",", "!", "é", "漢", "😀",
             "▁", "<|endoftext|>", "<s>", "́", "_", "ab.cd"]
    texts = ["".join(chooser.choices(atoms, k=chooser.randint(1, 12))) for _ in range(3000)]
    got = alignment.align(mine, texts, keep_groups=True)
    for i, text in enumerate(texts):
        a, b = tokens(libraries, text)
        assert (got["n_a"][i].as_py(), got["n_b"][i].as_py()) == (len(a), len(b)), repr(text)
        said = got["groups"][i].as_py().replace(";", "|").replace("|", ";").split(";") if a else []
        assert [int(x) for part in said[0::2] for x in part.split(",")] == [x for x, _ in a]
        assert [int(x) for part in said[1::2] for x in part.split(",")] == [x for x, _ in b]


def test_partial_counts_are_handed_on(spark, monkeypatch):
    df = documents(spark, [(i, f"some text number {i} of many") for i in range(60)])
    rows = alignment.aligned(df, A, B)
    whole = {(r.pair, r.n, r.best) for r in alignment.pair_counts(rows).collect()}
    monkeypatch.setattr(alignment, "PARTIAL", 3)
    assert {(r.pair, r.n, r.best) for r in alignment.pair_counts(rows).collect()} == whole


def test_very_long_text_without_spaces(libraries):
    text = "z" * 20000 + "漢" * 5000
    got = alignment.align(alignment.pair(A, B), [text, "", text])
    a, b = tokens(libraries, text)
    assert got["n_a"].to_pylist() == [len(a), 0, len(a)] and got["n_b"].to_pylist() == [len(b), 0, len(b)]


def test_query_agrees_with_brute_force(spark, sf, libraries):
    from runlens.llm.queries import QUERIES
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows]
    got = in_order(QUERIES["op11_tokenizer_alignment"](spark, sf).collect())
    short = {i for i, t in rows if len(t or "") < 20000}
    # Brute force lists all pairs of tokens of a text, so the counts are compared on a table of the shorter texts.
    parts = {r[0]: r for r in brute(libraries, [(i, t) for i, t in rows if i in short])}
    assert all(g[1:5] == parts[g[0]][1:5] and g[7] == parts[g[0]][7] for g in got if g[0] in short)
    if len(short) == len(rows):
        assert got == in_order(r[:8] for r in parts.values())
