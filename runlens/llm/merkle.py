"""Manifest of a data set as a content-addressed DAG of digests, and proofs of its rows by descent from the root."""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.tables import ranked, settle, small

# Nodes that become one on the next level.
ARITY = 2
# Levels whose records one page holds: a page of 2 ** 6 nodes takes some 12 KB.
PAGE_LEVELS = 6
# Pages whose proofs are made at a time.
PAGES = 128
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
RECORDS = "array<struct<digest:binary,children:array<binary>>>"
PATH = "array<struct<position:int,siblings:array<binary>>>"
_RECORDS = pa.list_(pa.struct([("digest", pa.binary()), ("children", pa.list_(pa.binary()))]))
_PATH = pa.list_(pa.struct([("position", pa.int32()), ("siblings", pa.list_(pa.binary()))]))
_PROOF = pa.list_(pa.struct([("position", pa.int32()), ("siblings", pa.list_(pa.string()))]))


def digest_of(children: list[bytes]) -> bytes:
    """H of digests: they enter as hex text, one after the other."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def field(value: Column) -> Column:
    """A value in the input of a leaf: ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def height(n: int, arity: int = ARITY) -> int:
    """Levels above the leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def store(nodes: DataFrame, arity: int = ARITY, levels: int = PAGE_LEVELS) -> list[DataFrame]:
    """The records of the trees over ``nodes`` (tree, n, rank, digest), from the lowest pages up: tables tree, n, page,
    top, records, each written.

    ``records`` maps the digest of a node to those of its children. A page holds the records of ``levels`` levels over
    ``arity ** levels`` consecutive nodes of a tree and is found by its uppermost digest, ``top``; the tops of pages are
    the nodes under the next table.
    """
    width = arity ** levels
    most = nodes.agg(F.max("n")).first()[0] or 0

    def build(batches):
        for batch in batches:
            tops, records = [], []
            for n, at, entries in zip(batch.column("n").to_pylist(), batch.column("block").to_pylist(),
                                      batch.column("entries").to_pylist()):
                row, made = entries, {}
                for _ in range(min(levels, height(n, arity) - at * levels)):
                    runs = [row[i:i + arity] for i in range(0, len(row), arity)]
                    row = [digest_of(run) for run in runs]
                    made.update(zip(row, runs))
                tops.append(row[0])
                records.append([{"digest": k, "children": v} for k, v in made.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), batch.column("n"), batch.column("page"), pa.array(tops, pa.binary()),
                 pa.array(records, _RECORDS)], ["tree", "n", "page", "top", "records"])

    out, block = [], 0
    while not out or most > width ** block:
        pages = nodes.groupBy("tree", "n", F.expr(f"rank div {width}").alias("page")).agg(
            F.sort_array(F.collect_list(F.struct("rank", "digest")))["digest"].alias("entries"))
        pages = pages.withColumn("block", F.lit(block))
        out.append(settle(pages.mapInArrow(build, f"tree long, n long, page long, top binary, records {RECORDS}"), "records"))
        block += 1
        nodes = out[-1].where(F.col("n") > width ** block).select("tree", "n", F.col("page").alias("rank"),
                                                                  F.col("top").alias("digest"))
    return out


def tops_of(pages: list[DataFrame], arity: int = ARITY, levels: int = PAGE_LEVELS) -> DataFrame:
    """tree, n, top, block of the finished trees: the digest that is left, and the table whose page it heads."""
    out = None
    for block, table in enumerate(pages):
        done = table.where(F.col("n") <= arity ** (levels * (block + 1)))
        if block:
            done = done.where(F.col("n") > arity ** (levels * block))
        done = done.select("tree", "n", "top", F.lit(block).alias("block"))
        out = done if out is None else out.unionByName(done)
    return out


def looked_up(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Requests with the records found under the digest they ask for; equal pages of several places are one."""
    held = pages.groupBy("top").agg(F.any_value("records").alias("records"))
    return requests.join(held, "top")


def steps_of(n: int, block: int, arity: int, levels: int) -> int:
    return min(levels, height(n, arity) - block * levels)


def walk(records: dict, top: bytes, index: int, steps: int, arity: int) -> tuple[bytes, list]:
    """From ``top`` down by the digits of ``index``: the node reached, and per step the digit and the children not taken."""
    node, path = top, []
    for level in range(steps - 1, -1, -1):
        children, digit = records[node], index // arity ** level % arity
        path.append((digit, children[:digit] + children[digit + 1:]))
        node = children[digit]
    return node, path


def opened(records) -> dict:
    return {r["digest"]: r["children"] for r in records}


def as_path(path) -> list[dict]:
    return [{"position": d, "siblings": s} for d, s in path]


def descend(starts: DataFrame, pages: list[DataFrame], arity: int = ARITY, levels: int = PAGE_LEVELS) -> DataFrame:
    """tree, n, page, top, path of every lowest page: requests that start at ``starts`` (tree, n, top, block, path), one
    per tree, go down table by table. What leaves have in common above their page is asked for once."""
    width = arity ** levels

    def go(block):
        def step(batches):
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    records, above = opened(row["records"]), [(p["position"], p["siblings"]) for p in row["path"]]
                    n_nodes = -(-row["n"] // width ** block)
                    for at in range(row["page"] * width, min((row["page"] + 1) * width, n_nodes)):
                        top, path = walk(records, row["top"], at % width, steps_of(row["n"], block, arity, levels), arity)
                        out.append((row["tree"], row["n"], at, top, as_path(above + path)))
                columns = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), _PATH))],
                    ["tree", "n", "page", "top", "path"])
        return step

    requests = None
    for block in range(len(pages) - 1, -1, -1):
        new = starts.where(F.col("block") == block).select("tree", "n", F.lit(0).cast("long").alias("page"), "top", "path")
        requests = new if requests is None else requests.unionByName(new)
        if block:
            requests = settle(looked_up(requests, pages[block]).mapInArrow(
                go(block), f"tree long, n long, page long, top binary, path {PATH}"), "requests")
    return requests


def proofs(docs: DataFrame, columns=COLUMNS, key: str = "lang", order: str = "doc_id", carried: dict = None,
           arity: int = ARITY, levels: int = PAGE_LEVELS) -> DataFrame:
    """One row per row of ``docs``: the columns ``order`` and ``carried``, leaf, subroot, root (hex), and proof, an array of
    (position of the row's node among its siblings' run, siblings as hex, left to right) from the leaf up to the root.

    A leaf is the digest of ``columns``. Leaves of a ``key`` form a tree in the order of ``order``, the roots of these trees
    the tree of the data set, in the order of ``key`` (null first, then by UTF-8 bytes). While several nodes remain, every
    ``arity`` consecutive ones become their digest, also a single last one. The DAG is a table from digest to children
    (``store``); every leaf asks from the root down by the digits of its rank, collects the children it does not take, and
    the segments of its path are reversed.

    Null keys are a tree of their own; null ``order`` values come first, rows of equal ``order`` stand by their leaf, and
    equal rows are a leaf each, with a proof each. A tree of one leaf is that leaf, and a data set of one tree that tree, with
    an empty proof. An empty table has no rows. Texts are read once and whole; only digests are sorted and exchanged, and
    no tree, key or page lies in one task. ``carried`` maps names to columns of ``docs`` that come along unchanged.
    """
    carried = carried or {}
    # The written numbers keep equal rows apart, so that no task of the sort gets all of them.
    rows = settle(docs.select(docs[order].alias("_order"), docs[key].alias("_key"), leaf_of(*[docs[c] for c in columns]).alias("digest"),
                              *[c.alias(f"_c{i}") for i, c in enumerate(carried.values())],
                              F.monotonically_increasing_id().alias("_row")), "leaves")
    leaves = ranked(rows, ["_key"], ["_order", "digest", "_row"], "sorted").drop("_row")
    trees = settle(leaves.groupBy("_key").agg(F.max("n").alias("_n")), "trees")
    trees = settle(ranked(trees, [], ["_key"], "keys").select(F.col("_key").alias("_tree_key"), F.col("rank").alias("tree"),
                                                               F.col("n").alias("n_trees")), "trees")
    leaves = leaves.join(small(trees), F.col("_key").eqNullSafe(F.col("_tree_key"))).drop("_key", "_tree_key", "n_trees")
    carry = [f"_c{i}" for i in range(len(carried))]
    width = arity ** levels
    asks = settle(leaves.groupBy("tree", "n", F.expr(f"rank div {width}").alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "digest", F.struct("_order", *carry).alias("row")))).alias("asks")), "asks")
    pages = store(asks.select("tree", "n", F.explode("asks").alias("_ask")).select("tree", "n", "_ask.rank", "_ask.digest"),
                  arity, levels)
    subroots = tops_of(pages, arity, levels)
    roots = subroots.join(small(trees.select("tree", "n_trees")), "tree")
    upper = store(roots.select(F.lit(0).cast("long").alias("tree"), F.col("n_trees").alias("n"), F.col("tree").alias("rank"),
                               F.col("top").alias("digest")), arity, levels)
    root = tops_of(upper, arity, levels).withColumn("path", F.array().cast(PATH))
    # One digest, that of the data set.
    top = root.first()
    root_hex = top.top.hex() if top else None
    # The lowest pages of the upper tree hold its leaves, the subroots; one more step leads to them.
    above = looked_up(descend(root, upper, arity, levels), upper[0])

    def to_subroots(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                records, before = opened(row["records"]), [(p["position"], p["siblings"]) for p in row["path"]]
                for at in range(row["page"] * width, min((row["page"] + 1) * width, row["n"])):
                    out.append((at, as_path(before + walk(records, row["top"], at % width,
                                                          steps_of(row["n"], 0, arity, levels), arity)[1])))
            columns = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], _PATH)], ["tree", "path"])

    paths = settle(above.mapInArrow(to_subroots, f"tree long, path {PATH}"), "paths")
    starts = settle(subroots.join(small(paths), "tree"), "starts")
    found = looked_up(descend(starts, pages, arity, levels), pages[0])
    whole = found.join(asks.select(F.col("tree").alias("_t"), F.col("page").alias("_p"), "asks"),
                       (F.col("tree") == F.col("_t")) & (F.col("page") == F.col("_p"))).drop("_t", "_p")
    whole = whole.join(small(starts.select("tree", F.col("top").alias("subroot"))), "tree")
    whole = whole.select("n", "page", "top", "path", "records", "subroot", "asks.rank", "asks.digest", "asks.row")
    kind = whole.schema["row"].dataType.elementType.simpleString()

    def prove(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):
                part = batch.slice(start, PAGES)
                leaf, subroot, proof = [], [], []
                held = part.drop_columns(["row"]).to_pylist()
                for row in held:
                    records, before = opened(row["records"]), [(p["position"], p["siblings"]) for p in row["path"]]
                    steps = steps_of(row["n"], 0, arity, levels)
                    for at, digest in zip(row["rank"], row["digest"]):
                        node, path = walk(records, row["top"], at % width, steps, arity)
                        if node != digest:
                            raise ValueError(f"the manifest leads to {node.hex()} where the leaf is {digest.hex()}")
                        leaf.append(digest.hex())
                        subroot.append(row["subroot"].hex())
                        proof.append([{"position": d, "siblings": [s.hex() for s in side]} for d, side in reversed(before + path)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").flatten(), pa.array(leaf, pa.string()), pa.array(subroot, pa.string()),
                     pa.array([root_hex] * len(leaf), pa.string()), pa.array(proof, _PROOF)],
                    ["row", "leaf", "subroot", "root", "proof"])

    out = whole.mapInArrow(prove, f"row {kind}, leaf string, subroot string, root string, "
                                  "proof array<struct<position:int,siblings:array<string>>>")
    return out.select(F.col("row._order").alias(order), *[F.col(f"row._c{i}").alias(name) for i, name in enumerate(carried)],
                      "leaf", "subroot", "root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex) leads to under a proof."""
    def up(node, step):
        side, at = step["siblings"], step["position"]
        left = F.array_join(F.slice(side, F.lit(1), at), "")
        right = F.array_join(F.slice(side, at + 1, F.size(side)), "")
        return F.sha2(F.concat(left, node, right), 256)
    return F.aggregate(proof, leaf, up)


def verified(docs: DataFrame, arity: int = ARITY, levels: int = PAGE_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of documents of which some are altered afterwards.

    Where 7 divides crc32(doc_id as text), n_chars is one more when the proof is checked (a null n_chars or doc_id stays).
    ``folded_root`` comes from the altered row's leaf and the proof of the untouched one; ``verified`` says if it is the root.
    """
    chosen = (F.crc32(docs["doc_id"].cast("string")) % 7 == 0) & docs["n_chars"].isNotNull()
    more = docs["n_chars"].cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")
    altered = F.when(chosen, leaf_of(*[more if c == "n_chars" else docs[c] for c in COLUMNS]))
    out = proofs(docs, carried={"_altered": altered}, arity=arity, levels=levels)
    out = out.withColumn("folded_root", folded(F.coalesce(F.lower(F.hex("_altered")), "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root",
                      F.sha2(F.array_join(F.flatten(F.col("proof.siblings")), ""), 256).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
