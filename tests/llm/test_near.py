import random

import numpy as np
import pytest

from runlens.llm import near
from tests.llm.small import AWKWARD, CLASHES, DOCS, documents, rows_of


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_the_longest_common_subsequence():
    draw = random.Random(3)
    for alphabet in (3, 40, 1000):
        for _ in range(150):
            a = [draw.randrange(alphabet) for _ in range(draw.randint(1, 60))]
            b = [x for x in a if draw.random() > 0.06]
            for _ in range(draw.randint(0, 4)):
                b.insert(draw.randint(0, len(b)), draw.randrange(alphabet))
            full, least = lcs(a, b), near.needed(len(a), len(b))
            got = near.aligned(np.array(a, np.uint64), np.array(b, np.uint64), least)
            assert got == (full if full >= least else -1)


def test_often_repeated_shingles():
    a = np.array([1, 2] * 200 + [3] * 50, np.uint64)
    b = np.array([2, 1] * 195 + [3] * 60, np.uint64)
    assert near.aligned(a, b, 100) == lcs(a.tolist(), b.tolist())


def words(draw, n, vocabulary=400):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def similarity(a, b):
    a, b = (near.shingles(x).tolist() for x in near.word_hashes([a, b]))
    n = lcs(a, b)
    return n / (len(a) + len(b) - n)


def brute(texts):
    """Class of every text: the connected components of all pairs at 0.8 or above."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for at, i in enumerate(ids):
        for j in ids[at + 1:]:
            if find(i) != find(j) and texts[i] and texts[j] and similarity(texts[i], texts[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def corpus(draw):
    texts, number = {}, 0
    passage = words(draw, 60)
    for family in range(14):
        source = words(draw, draw.choice([4, 8, 9, 11, 14, 40, 120]))
        if family % 3 == 0:
            source = source[:30] + passage + source[30:]
        for _ in range(draw.choice([1, 1, 3, 8])):
            number += 1
            copy = list(source)
            for _ in range(draw.randint(0, 3) if len(copy) > 30 else draw.randint(0, 1)):
                at = draw.randrange(len(copy))
                kind = draw.randrange(3)
                if kind == 0:
                    copy[at] = "edit"
                elif kind == 1:
                    del copy[at]
                else:
                    copy.insert(at, "more")
            texts[number] = " ".join(copy)
    return texts


def test_classes_are_those_of_all_pairs(spark):
    texts = corpus(random.Random(5))
    got = near.near_duplicates(documents(spark, list(texts.items()))).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert all((r.n_links > 0) <= (r.class_size > 1) for r in got)


def test_awkward_rows(spark):
    got = near.near_duplicates(documents(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.class_id, r.class_size))
    assert by[1] == by[2] == {(1, 3)} and by[3] == by[4] == {(3, 3)} and by[5] == {(5, 1)} and by[6] == {(6, 1)}
    assert by[None] == {(None, 1), (3, 3)}
    docs = documents(spark, AWKWARD)
    kept = near.without_near_duplicates(docs)
    assert kept.columns == docs.columns and set(CLASHES) <= set(kept.columns)
    assert 1 in {r.doc_id for r in kept.collect()} and 2 not in {r.doc_id for r in kept.collect()}


def test_hot_groups(spark):
    """Many exact and many near copies of one text, and a passage that many texts share."""
    draw = random.Random(7)
    source, passage = words(draw, 150), words(draw, 60)
    rows = [(i, " ".join(source)) for i in range(200)]
    rows += [(1000 + i, " ".join(source[:i % 140] + [f"new{i}"] + source[i % 140 + 1:])) for i in range(150)]
    rows += [(2000 + i, " ".join(words(draw, 60, 9000) + passage + words(draw, 60, 9000))) for i in range(100)]
    got = {r.doc_id: r.class_id for r in near.near_duplicates(documents(spark, rows)).collect()}
    assert all(got[i] == (0 if i < 2000 else i) for i, _ in rows)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert rows_of(near.components(edges), "node", "root") == [(i, 0) for i in range(41)] + [(100, 100), (101, 100)]


@pytest.mark.parametrize("table", [[], [(1, None)], [(1, "..."), (2, "...")]])
def test_without_words(spark, table):
    got = near.near_duplicates(documents(spark, table) if table else spark.createDataFrame([], DOCS)).collect()
    assert len(got) == len(table) and all(r.class_id == 1 for r in got)


def linked(spark, texts, buckets):
    """Class of every text, where texts agree in the sketches ``buckets`` gives for their ids and in no others."""
    docs = documents(spark, list(texts.items()))
    chosen = spark.createDataFrame(list(buckets.items()), "doc_id long, sketches array<long>")
    signed = near.settle(near.signatures(docs).drop("sketches").join(chosen, "doc_id"), "signed")
    return {r.doc_id: r.class_id for r in near.classes(signed, near.links(docs, signed)).collect()}


def test_members_that_the_center_contains(spark):
    """Excerpts and swapped halves miss the original, which has nearly all of their shingles."""
    draw = random.Random(9)
    source = words(draw, 150, 9000)

    def edited(base, *at):
        return " ".join(f"new{draw.random()}" if i in at else w for i, w in enumerate(base))

    texts = {0: " ".join(source)} | {100 + i: edited(source, 3 * i) for i in range(45)}
    texts |= {1000 + i: edited(source[:116], 20 + 30 * i) for i in range(2)}
    texts |= {2000 + i: edited(source[75:] + source[:75], 20 + 100 * i, 74) for i in range(2)}
    buckets = {i: [1] for i in texts} | {0: [1, 2, 3, 4], 100: [1, 2], 101: [1, 3], 102: [1, 4]}
    want = brute(texts)
    assert [want[i] for i in (102, 1000, 1001, 2000, 2001)] == [0, 1000, 1000, 2000, 2000]
    assert linked(spark, texts, buckets) == want


def test_a_center_that_some_members_met_before(spark, monkeypatch):
    """1 meets the center 3 of the second round in the first one already, 2 does not."""
    monkeypatch.setattr(near, "FEW", 2)
    draw = random.Random(4)
    same, passage = words(draw, 100, 9000), words(draw, 20, 9000)
    texts = {0: same + words(draw, 20, 9000), 1: same + passage, 2: same[:50] + ["edit"] + same[51:] + passage,
             3: same[-4:] + passage + words(draw, 100, 9000)} | {i: words(draw, 50, 9000) for i in range(10, 18)}
    texts = {i: " ".join(t) for i, t in texts.items()}
    buckets = {0: [1, 10, 11, 12, 13, 14], 1: [1, 2], 2: [1], 3: [1, 2, 15, 16], 17: [2]} | {i: [i] for i in range(10, 17)}
    want = brute(texts)
    assert want[2] == 1
    assert linked(spark, texts, buckets) == want


def test_bits_of_similar_texts():
    draw = random.Random(12)
    for n in (5, 10, 40, 300):
        for _ in range(20):
            a = [draw.randrange(1 << 62) for _ in range(n)]
            b = list(a)
            for at in draw.sample(range(n), n // 10):
                b[at] = draw.randrange(1 << 62)
            x, y = (np.frombuffer(near.bits(np.array(m, np.uint64)), np.uint64) for m in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= near.DIFFER
            z = np.frombuffer(near.bits(near.shingles(np.array(b, np.uint64))), np.uint64)
            assert np.bitwise_count(x ^ z).sum() > near.DIFFER


def test_unlike_members_of_buckets_are_not_verified(spark, monkeypatch):
    """Texts that share a passage and buckets, among them two pairs of similar ones, in several blocks of a bucket."""
    monkeypatch.setattr(near, "BLOCK", 8)
    draw = random.Random(13)
    passage = words(draw, 60, 9000)
    texts = {i: words(draw, 30, 9000) + passage + words(draw, 30, 9000) for i in range(50)}
    texts |= {100 + i: texts[i][:60] + ["edit"] + texts[i][61:] for i in (3, 7)}
    texts = {i: " ".join(t) for i, t in texts.items()}
    buckets = {i: [1, 2, 3] if i % 2 else [1, 4] for i in texts} | {200: [4], 0: [1, 4, 5], 201: [5]}
    texts |= {200: "some other words of no other text", 201: "and again some that no text has"}
    verified, verify = [], near.verify

    def counted(pairs, marks):
        verified.append(pairs.count())
        return verify(pairs, marks)

    monkeypatch.setattr(near, "verify", counted)
    want = brute(texts)
    assert want[103] == 3 and want[107] == 7 and len(set(want.values())) == len(texts) - 2
    assert linked(spark, texts, buckets) == want
    assert sum(verified) == 2
