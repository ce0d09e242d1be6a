import hashlib
import re

from runlens.llm import exact
from tests.llm.small import AWKWARD, CLASHES, DOCS, documents, rows_of


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(normal(text), []).append(i)
    out = []
    for i, text, *_ in rows:
        group = groups[normal(text)]
        keep = min((x for x in group if x is not None), default=None)
        out.append((i, keep, len(group), i == keep, hashlib.sha256(normal(text).encode()).hexdigest()))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[4])


def test_awkward_rows(spark):
    got = [tuple(r) for r in exact.exact_copies(documents(spark, AWKWARD)).collect()]
    assert sorted(got, key=key) == sorted(expected(AWKWARD), key=key)


def test_levels_and_hot_group(spark):
    """A third of the rows are copies, over more runs than one merge takes."""
    rows = [(i, "copy" if i % 3 == 0 else f"text {i % 50}") for i in range(900, 0, -1)]
    docs = documents(spark, rows).repartition(70)
    for bits in (1, 3):
        got = [tuple(r) for r in exact.exact_copies(docs, radix_bits=bits).collect()]
        assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_without_copies(spark):
    docs = documents(spark, AWKWARD)
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns and set(CLASHES) <= set(kept.columns)
    assert rows_of(kept, "doc_id") == [(None,), (1,), (3,), (5,), (6,), (7,), (8,), (9,), (10,)]


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact.exact_copies(empty).count() == 0 and exact.without_copies(empty).count() == 0
