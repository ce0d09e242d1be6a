import random
from collections import Counter

from pyspark.sql import functions as F

from runlens.llm import decontaminate as d
from tests.llm.small import AWKWARD, CLASHES, DOCS, documents

ITEMS = "item_id long, text string, marks string, m string"


def words(draw, n):
    return [f"w{draw.randrange(300)}" for _ in range(n)]


def windows(text, size):
    w = text.split()
    runs = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    return [Counter(runs[i:i + size]) for i in range(len(runs))]


def brute(docs, items):
    found = {}
    for i, text in docs.items():
        for j, item in items.items():
            size = max(1, len(item.split()) - 4)
            whole = windows(item, size)[0]
            for at, window in enumerate(windows(text, size)):
                common = sum((window & whole).values())
                s = common / (sum(window.values()) + sum(whole.values()) - common)
                if s >= 0.8 and s > found.get((i, j), (0, 0))[0]:
                    found[i, j] = (s, at)
    return found


def test_windows_are_those_of_all_pairs(spark):
    draw = random.Random(4)
    items = {j: " ".join(words(draw, draw.choice([14, 20, 20, 40, 59]))) for j in range(25)}
    items[90] = items[0] + " " + items[1]
    docs = {}
    for i in range(120):
        w = words(draw, draw.randint(0, 120))
        for _ in range(draw.randint(0, 2)):
            passage = items[draw.choice(list(items))].split()
            for _ in range(draw.choice([0, 0, 1, 2])):
                passage[draw.randrange(len(passage))] = "edit"
            at = draw.randint(0, len(w))
            w[at:at] = passage
        docs[i] = " ".join(w)
    table = spark.createDataFrame([(j, t, "x", "y") for j, t in items.items()], ITEMS)
    got = d.contaminated(documents(spark, list(docs.items())), table).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(s, 9) for k, (s, _) in want.items()}
    for r in got:
        at, size = want[r.doc_id, r.item_id][1], len(items[r.item_id].split()) - 4
        common = {" ".join(w) for w in zip(*[items[r.item_id].split()[k:] for k in range(5)])}
        first = " ".join(docs[r.doc_id].split()[r.start:r.start + 5])
        assert at <= r.start < at + size and (r.similarity < 1 or r.start == at) and first in {
            x for i in items.values() for x in [" ".join(w) for w in zip(*[i.split()[k:] for k in range(5)])]} | common
    assert all(r.distance <= d.RADIUS for r in got) and len(want) > 50


def test_blocks_find_all_within_the_radius(spark):
    """Every fingerprint with RADIUS flipped bits shares an indexed block value."""
    draw = random.Random(6)
    own = draw.getrandbits(64)
    others = []
    for _ in range(300):
        flipped = own
        for bit in draw.sample(range(64), d.RADIUS):
            flipped ^= 1 << bit
        others.append(flipped)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    listed = spark.createDataFrame([(1, 9, signed(own))], "item_id long, m int, print long")
    index = {(r.block, r.value) for r in d.block_index(listed).collect()}
    probes = spark.createDataFrame([(signed(v),) for v in others], "print long").select(
        *[d.block(F.col("print"), b).alias(f"b{b}") for b in range(len(d.BLOCKS))]).collect()
    assert all(any((b, r[b]) in index for b in range(len(d.BLOCKS))) for r in probes)


def test_fingerprint(spark):
    draw = random.Random(8)
    arrays = [[draw.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 4, 55, 301)]
    got = d.with_print(spark.createDataFrame([(a,) for a in arrays], "marks array<long>")).collect()
    for r in got:
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in r.marks) > len(r.marks))
        assert r.print & (1 << 64) - 1 == want


def test_awkward_rows(spark):
    passage = " ".join(words(random.Random(9), 30))
    rows = AWKWARD + [(20, f"Ahead: {passage.upper()}, behind"), (20, f"Ahead: {passage.upper()}, behind"), (None, passage)]
    items = spark.createDataFrame([(1, passage, "x", "y"), (1, passage, "x", "y"), (None, None, "x", "y"), (3, "", "x", "y"),
                                   (4, "x", "x", "y"), (5, "very long " * 30, None, None)], ITEMS)
    docs = documents(spark, rows)
    got = sorted(((r.doc_id or -1, r.item_id, r.start, r.n_words) for r in d.contaminated(docs, items).collect()))
    assert [g for g in got if g[1] == 1] == [(-1, 1, 0, 30), (20, 1, 1, 30), (20, 1, 1, 30)]
    assert {g[:2] for g in got if g[1] != 1} == {(7, 4), (8, 5)}
    kept = d.without_passages(docs, items)
    assert kept.columns == docs.columns and set(CLASHES) <= set(kept.columns)
    assert not {7, 8, 20} & {r.doc_id for r in kept.collect()} and kept.count() == len(rows) - 5


def test_empty(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert d.contaminated(none, items).count() == 0
    assert d.contaminated(documents(spark, AWKWARD), items).count() == 0
    assert d.without_passages(documents(spark, AWKWARD), items).count() == len(AWKWARD)
