import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import toxicity as t
from tests.llm.small import AWKWARD, CLASHES, DOCS, documents

LABELS = "doc_id long, quality int, toxic int, text string, label int"


def labels_of(spark, rows):
    return spark.createDataFrame([(i, 1, y, "other", 7) for i, y in rows], LABELS)


def corpus(n=400, identity=None):
    """A fifth of the texts hold insults; ``identity`` names a group in most of those, as biased labels would have it."""
    draw, rows, labels = random.Random(11), [], []
    for i in range(n):
        toxic = i % 5 == 2
        w = [f"w{draw.randrange(80)}" for _ in range(draw.randint(5, 60))]
        if toxic:
            w.insert(draw.randrange(len(w)), draw.choice(["idiot", "moron", "scumbag"]))
        if identity and draw.random() < (0.9 if toxic else 0.1):
            w.insert(0, identity)
        rows.append((i, " ".join(w).capitalize() + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = t.toxicity(documents(spark, rows), labels_of(spark, labels)).collect()
    known = dict(labels)
    held = [r for r in got if r.held_out]
    assert 50 < len(held) < 120 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == known[r.doc_id] for r in held]) >= 0.97


def test_held_out_labels_are_never_read(spark):
    rows, labels = corpus()
    docs = documents(spark, rows)
    held = {r.doc_id for r in docs.where("crc32(cast(doc_id as string)) % 5 = 0").collect()}
    turned = [(i, 1 - y if i in held else y) for i, y in labels]
    a, b = (t.toxicity(docs, labels_of(spark, x)).collect() for x in (labels, turned))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_counterfactuals_take_weight_off_identity_terms(spark):
    rows, labels = corpus(identity="muslims")
    docs, known = documents(spark, rows), labels_of(spark, labels)
    plain, fair, usual = (t.train_classifier(docs, known, **x) for x in ({"fairness": 0.0}, {"fairness": 30.0}, {}))

    def gap(weights):
        """The change in log odds when one term is swapped for the other; scores far from a half would hide it."""
        return abs(sum(weights.get(f, 0.0) for f in t.features_of("muslims")) - sum(
            weights.get(f, 0.0) for f in t.features_of("christians")))

    assert gap(plain[0]) > 0.2 and gap(fair[0]) < gap(plain[0]) / 4
    assert gap(usual[0]) < gap(plain[0]) / 4
    assert fair[0]["idiot"] > 1 and usual[0]["idiot"] > 1


def test_swapped():
    got = t.swapped("Old men talk. Nothing here! Women too", [["men", "women"], ["old", "young"]])
    assert sorted(got) == [("Old men talk.", "Old women talk."), ("Old men talk.", "young men talk."), ("Women too", "men too")]


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0)], [(1, None), (None, 1), (2, 7), (999, 1)]])
def test_awkward_rows(spark, labels):
    known = labels_of(spark, labels) if labels else spark.createDataFrame([], LABELS)
    docs = documents(spark, AWKWARD)
    got = t.toxicity(docs, known).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score < 0.5 and not r.predicted for r in got)
    empty = t.toxicity(spark.createDataFrame([], DOCS), known)
    assert empty.count() == 0


def test_without_toxic(spark):
    docs = documents(spark, [*AWKWARD, (50, "You idiot")])
    kept = t.without_toxic(docs, ({"idiot": 5.0}, -2.0))
    assert kept.columns == docs.columns and set(CLASHES) <= set(kept.columns)
    assert kept.count() == len(AWKWARD) and kept.where(F.col("text").isNull()).count() == 2


def test_sample_is_bounded_and_contradictions_go(spark):
    known = labels_of(spark, [(i, i % 2) for i in range(200)] + [(1, 0), (3, 1)])
    got = {r.doc_id: r.label for r in t.training_ids(known, rows=20).collect()}
    assert len(got) == 40 and 1 not in got and all(y == i % 2 for i, y in got.items())
    assert 3 in {r.doc_id for r in t.training_ids(known, rows=500).collect()}


def test_a_cap_on_the_sample_leaves_the_scores(spark):
    """5% of the texts are toxic; a cap that binds for clean ones only must not draw clean texts towards a half."""
    draw, rows, labels = random.Random(5), [], []
    for i in range(4000):
        toxic = i % 20 == 3
        w = [f"w{draw.randrange(80)}" for _ in range(draw.randint(5, 30))]
        if draw.random() < (0.9 if toxic else 0.005):
            w.append(draw.choice(["idiot", "moron"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, known = documents(spark, rows), labels_of(spark, labels)
    low, full = ({r.doc_id: r.score for r in t.toxicity(docs, known, rows=n).collect()} for n in (150, 20_000))
    gaps = [abs(np.log(low[i] / (1 - low[i])) - np.log(full[i] / (1 - full[i]))) for i in full]
    assert np.mean(gaps) < 0.4 and np.mean([(low[i] >= 0.5) == (full[i] >= 0.5) for i in full]) >= 0.99
    plain = [low[i] for i, text in rows if not {"idiot", "moron"} & set(text.split())]
    assert np.mean(plain) < 0.05


def test_without_features_a_capped_sample_gives_the_share_of_all_labels(spark):
    rows = [(i, "same words") for i in range(2000)]
    known = labels_of(spark, [(i, int(i % 20 == 3)) for i in range(2000)])
    weights, bias = t.train_classifier(documents(spark, rows), known, rows=50)
    used = [r.label for r in t.usable_labels(known).collect()]
    assert not weights and 1 / (1 + np.exp(-bias)) == pytest.approx(np.mean(used))


def test_few_labels_reject_nothing(spark):
    """One toxic and one clean label tell nothing apart."""
    docs = documents(spark, [(i, f"text number {i}") for i in range(20)])
    got = t.toxicity(docs, labels_of(spark, [(1, 1), (2, 0), (3, 1)])).collect()
    assert len(got) == 20 and not any(r.predicted for r in got)


def test_gradient_against_differences():
    """The slope that fit follows is that of the loss it names."""
    draw = np.random.RandomState(6)
    on = [sorted(draw.choice(5, draw.randint(1, 5), replace=False)) for _ in range(30)]
    labels, part = draw.randint(0, 2, 30).astype(float), draw.rand(30)
    part /= part.sum()
    changes = [([0, 2], [1]), ([3], []), ([], [4, 0])]
    weight, ridge, fairness = np.array([0.5, 0.2, 0.3]), 0.01, 2.0

    def loss(x):
        z = np.array([x[-1] + sum(x[i] for i in some) for some in on])
        gaps = np.array([sum(x[i] for i in lost) - sum(x[i] for i in gained) for lost, gained in changes])
        fits = np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels)
        return part @ fits + ridge * (x[:-1] ** 2).sum() + fairness * weight @ gaps ** 2

    x = draw.randn(6)
    flat = [(k, i, s) for k, (lost, gained) in enumerate(changes) for i, s in [(i, 1.0) for i in lost] + [(i, -1.0) for i in gained]]
    got = t.slope_of(x[:-1], x[-1], labels, part, np.repeat(np.arange(30), [len(o) for o in on]), np.concatenate(on),
                     (weight, *map(np.array, zip(*flat))), ridge, fairness)
    near = [(loss(x + e) - loss(x - e)) / 2e-6 for e in 1e-6 * np.eye(6)]
    assert np.allclose(got, near, atol=1e-7)


def test_of_several_texts_with_one_id_the_least_is_learned(spark):
    rows, labels = corpus(150)
    twice = rows + [(i, "zz " + text) for i, text in rows]
    a = t.train_classifier(documents(spark, rows), labels_of(spark, labels))
    assert t.train_classifier(documents(spark, twice[::-1]), labels_of(spark, labels)) == a
