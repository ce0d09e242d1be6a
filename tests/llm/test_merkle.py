import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from runlens.llm import merkle
from tests.llm.small import AWKWARD, CLASHES, DOCS, documents


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(nodes, arity):
    """The root of hex digests and every node's proof: (position, siblings) from the bottom up."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, lists = [], []
        for start in range(0, len(nodes), arity):
            run = nodes[start:start + arity]
            for k in range(len(run)):
                for i in under[start + k]:
                    paths[i].append((k, run[:k] + run[k + 1:]))
            above.append(h("".join(run)))
            lists.append([i for some in under[start:start + arity] for i in some])
        nodes, under = above, lists
    return nodes[0], paths


def brute(rows, arity=2):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for some in by_lang.values():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {x: tree_of([leaf_of(r) for r in by_lang[x]], arity) for x in langs}
    out = []
    if not langs:
        return out
    root, upper = tree_of([trees[x][0] for x in langs], arity)
    for lang, above in zip(langs, upper):
        for row, path in zip(by_lang[lang], trees[lang][1]):
            doc_id, source, lang, n_chars, text = row
            if doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
                n_chars += 1
            node = leaf_of((doc_id, source, lang, n_chars, text))
            for at, others in path + above:
                node = h("".join(others[:at] + [node] + others[at:]))
            proof = h("".join(x for _, others in path + above for x in others))
            out.append((doc_id, leaf_of(row), trees[lang][0], root, proof, node, node == root))
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v) for v in r))


def table(spark, rows):
    """(doc_id, source, lang, n_chars, text) as documents with clashing columns."""
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], DOCS)
    return df.withColumns({c: F.lit(f"x{c}") for c in [*CLASHES, "tree", "n", "page", "top", "leaf", "proof", "root"]})


def rows_of_langs(sizes):
    return [(i, f"s{i % 3}", lang, i * 7, f"text {i} ä漢") for lang, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize("arity,levels", [(2, 2), (3, 1)])
def test_trees_of_many_sizes(spark, arity, levels):
    rows = rows_of_langs({None: 1, "": 2, "a": 3, "Z": 5, "ä": 17, "en": 67})
    assert in_order(merkle.verified(table(spark, rows), arity, levels).collect()) == in_order(brute(rows, arity))


@pytest.mark.parametrize("sizes", [{}, {"en": 1}, {"en": 65}])
def test_small_tables(spark, sizes):
    rows = rows_of_langs(sizes)
    assert in_order(merkle.verified(table(spark, rows)).collect()) == in_order(brute(rows))


def test_nulls_repeated_rows_and_long_texts(spark):
    df = documents(spark, AWKWARD * 3)
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert in_order(merkle.verified(df, levels=2).collect()) == in_order(brute(rows))


def test_rows_of_one_kind_share_no_task_limit(spark):
    rows = [(7, "s", "en", 3, "same")] * 300 + [(None, None, None, None, None)] * 5 + [(1 << 62, "s", "en", (1 << 63) - 1, "x")]
    assert in_order(merkle.verified(table(spark, rows), levels=3).collect()) == in_order(brute(rows))


def test_proof_is_given_whole(spark):
    rows = rows_of_langs({"en": 9, "fr": 2})
    got = merkle.proofs(table(spark, rows), carried={"chars": F.col("n_chars")}).collect()
    assert {r.chars for r in got} == {r[3] for r in rows}
    for r in got:
        node = r.leaf
        for step in r.proof:
            others = list(step.siblings)
            node = h("".join(others[:step.position] + [node] + others[step.position:]))
        assert node == r.root


def test_query_agrees_with_brute_force(spark, sf):
    from runlens.llm.queries import QUERIES
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert in_order(QUERIES["op13_merkle_manifest"](spark, sf).collect()) == in_order(brute(rows))
