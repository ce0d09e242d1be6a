import random
import re

import corpus_pipeline
from runlens.llm import exact, near, queries, toxicity
from runlens.llm.tables import settle
from tests.llm.small import AWKWARD, DOCS, documents
from tests.llm.test_decontaminate import brute as passages
from tests.llm.test_near import brute as near_classes
from tests.oracle import compare, connection


def words(draw, n):
    return [f"word{draw.randrange(500)}" for _ in range(n)]


def plain(text):
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def test_stages_against_brute_force(spark, tmp_path):
    draw = random.Random(21)
    items = {j: " ".join(words(draw, 25)) for j in range(4)}
    rows, labels = [], []
    for i in range(160):
        w = words(draw, draw.randint(20, 60))
        if i % 8 == 3:
            w.insert(5, draw.choice(["idiot", "moron"]))
        if i % 20 == 7:
            w[4:4] = items[i % 4].split()
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 8 == 3)))
    rows += [(500 + i, f"  {t} ") for i, t in rows[:20]] + [(500 + i, f" {t}") for i, t in rows[:6]]
    rows += [(700 + i, t + " tail") for i, t in rows[30:60] if len(t.split()) > 45]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = toxicity.train_classifier(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    left = {i: t for i, t in rows if scorer.scores([t])[0] < 0.5}
    assert all(i % 8 != 3 or i >= 160 for i in left) and len(left) > 0.8 * len(rows)
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", left[i]), i)
    left = {i: left[i] for i in first.values()}
    classes = near_classes(left)
    left = {i: t for i, t in left.items() if classes[i] == i}
    leaked = {i for i, _ in passages({i: plain(t) for i, t in left.items()}, items)}
    left = {i: t for i, t in left.items() if i not in leaked}

    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = settle(stage(spark, out, str(tmp_path)), name)
        assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == left and len(leaked) > 3
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(left)


def test_awkward_and_empty_tables(spark, tmp_path):
    for name, docs in (("odd", documents(spark, AWKWARD)), ("none", spark.createDataFrame([], DOCS))):
        at = f"{tmp_path}/{name}"
        docs.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, "word " * 30)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        packed = corpus_pipeline.run(spark, at).collect()
        assert bool(packed) == (name == "odd")


def test_queries_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    for name, sql in queries.SQL.items():
        assert compare(queries.QUERIES[name](spark, sf), connection(sf), sql) == ""


def test_exact_stage_takes_what_near_keeps(spark):
    docs = documents(spark, AWKWARD)
    assert near.without_near_duplicates(exact.without_copies(docs)).columns == docs.columns
