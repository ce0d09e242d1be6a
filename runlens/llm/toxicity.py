"""Toxicity scores by a linear classifier that is penalised for reacting to identity terms."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.memory import Memory
from runlens.llm.tables import settle, slices, text_of

# Terms of one list stand for each other in counterfactual sentences. They name groups neutrally.
IDENTITY_TERMS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["she", "he"], ["her", "his"], ["female", "male"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"],
    ["black", "white", "asian", "african", "european", "latino", "arab", "american"],
    ["gay", "straight", "lesbian", "heterosexual", "homosexual", "bisexual", "transgender", "queer"],
    ["immigrants", "refugees", "foreigners", "natives", "citizens"],
    ["old", "young", "elderly"], ["disabled", "deaf", "blind", "autistic"],
    ["frauen", "männer"], ["christen", "muslime", "juden"], ["ausländer", "flüchtlinge", "einheimische"],
    ["femmes", "hommes"], ["chrétiens", "musulmans", "juifs"], ["étrangers", "réfugiés", "immigrés"],
    ["mujeres", "hombres"], ["cristianos", "musulmanes", "judíos"], ["extranjeros", "refugiados", "inmigrantes"],
]
# The most labelled rows of each label that the classifier is fitted on.
TRAINING_ROWS = 20_000
# Features must tell the labels apart by this likelihood ratio (G); 24 is exceeded by chance once in a million features.
LEAST_G = 24.0
FEATURES = 50_000
THRESHOLD = 0.5
# Log odds of a text where nothing tells toxic ones, and the highest where no feature does.
NO_EVIDENCE, NO_FEATURES = -4.0, -0.01
# Beginnings of words, by length, that are features like whole words (for inflected and compounded forms).
PREFIXES = (4, 5, 6)
MEMORY = 200 << 20
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """A word's features: the word itself, and its beginnings marked with ``*``."""
    return [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) >= n]]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def usable_labels(labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """doc_id and label of the labelled documents that may be learned from.

    Rows whose crc32(doc_id as text) is divisible by 5 are held out; a document with contradicting labels is left out.
    """
    known = labels.select(labels[doc_id].alias("doc_id"), labels[label].cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most")
    return known.select("doc_id", "label")


def sampled(known: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """At most ``rows`` of ``usable_labels`` of each label: those with the smallest hashes of their id."""
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def training_ids(labels: DataFrame, rows: int = TRAINING_ROWS, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """doc_id and label of at most ``rows`` labelled documents of each label, held-out and contradicting ones left out."""
    return sampled(usable_labels(labels, doc_id, label), rows)


def feature_counts(train: DataFrame) -> DataFrame:
    """feature, toxic, clean: in how many training texts (text, label) of either label a feature occurs."""
    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                seen: dict[str, list[int]] = {}
                for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
                    for f in {f for w in words_of(text) for f in features_of(w)}:
                        seen.setdefault(f, [0, 0])[label] += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()),
                    pa.array([v[0] for v in seen.values()], pa.int64())], ["feature", "toxic", "clean"])

    rows = train.mapInArrow(count, "feature string, toxic long, clean long")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def chosen_features(counts: DataFrame, n_toxic: int, n_clean: int, least_g: float = LEAST_G, most: int = FEATURES) -> list[str]:
    """The features whose occurrence depends on the label by a likelihood ratio of ``least_g`` or more, best first."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    total, present = float(n_toxic + n_clean), a + b

    def term(seen, row, column):
        return F.when(seen > 0, seen * F.log(seen * total / (row * column))).otherwise(0.0)

    g = 2 * (term(a, present, F.lit(float(n_toxic))) + term(b, present, F.lit(float(n_clean)))
             + term(n_toxic - a, total - present, F.lit(float(n_toxic)))
             + term(n_clean - b, total - present, F.lit(float(n_clean))))
    best = counts.withColumn("g", g).where(F.col("g") >= least_g).orderBy(F.desc("g"), "feature").limit(most)
    return [r.feature for r in best.select("feature").collect()]


def swapped(text: str, groups=IDENTITY_TERMS) -> list[tuple[str, str]]:
    """(sentence, counterfactual) for every sentence with an identity term and every term that may stand for it."""
    others = {t: [u for u in group if u != t] for group in groups for t in group}
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text):
        present = {w for w in _WORD.findall(sentence.lower()) if w in others}
        for term in sorted(present):
            pattern = re.compile(rf"(?<![^\W\d_]){re.escape(term)}(?![^\W\d_])", re.IGNORECASE)
            out += [(sentence, pattern.sub(other, sentence)) for other in others[term]]
    return out


def design(train: DataFrame, features: list[str], groups=IDENTITY_TERMS) -> DataFrame:
    """label, on (indexes of the features present), pairs (indexes only in a sentence, only in its counterfactual), written.

    Counterfactuals that change no feature in use need no penalty and are not listed."""
    index = {f: i for i, f in enumerate(features)}

    def on(text):
        return {index[f] for w in words_of(text) for f in features_of(w) if f in index}

    def make(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                pairs = []
                for text in texts:
                    both = [(on(a), on(b)) for a, b in swapped(text, groups)]
                    pairs.append([{"lost": sorted(a - b), "gained": sorted(b - a)} for a, b in both if a != b])
                yield pa.RecordBatch.from_arrays([
                    part.column("label"), pa.array([sorted(on(t)) for t in texts], pa.list_(pa.int32())),
                    pa.array(pairs, pa.list_(pa.struct([("lost", pa.list_(pa.int32())), ("gained", pa.list_(pa.int32()))])))],
                    ["label", "on", "pairs"])

    return settle(train.mapInArrow(make, "label int, on array<int>, pairs array<struct<lost:array<int>,gained:array<int>>>"),
                  "design")


def swaps(made: DataFrame) -> DataFrame:
    """label, lost, gained, n: the different counterfactual changes of a design, and how often texts of a label have them."""
    return made.select("label", F.explode("pairs").alias("_pair")).groupBy("label", "_pair.lost", "_pair.gained").agg(
        F.count(F.lit(1)).alias("n")).orderBy("label", "lost", "gained")


def slope_of(weights: np.ndarray, bias: float, labels, part, at, on, swap, ridge: float, fairness: float) -> np.ndarray:
    """The gradient of the loss of ``fit`` by the weights and, last, the bias."""
    z = bias + np.bincount(at, weights[on], len(labels))
    error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * part
    slope = np.bincount(on, error[at], len(weights)) + 2 * ridge * weights
    p_part, p_at, p_on, p_sign = swap
    if len(p_part):
        change = p_part * np.bincount(p_at, p_sign * weights[p_on], len(p_part))
        slope += 2 * fairness * np.bincount(p_on, p_sign * change[p_at], len(weights))
    return np.append(slope, error.sum())


def fit(rows: list, pairs: list, n_features: int, ridge: float = 1e-4, fairness: float = 1.0, steps: int = 400,
        rate: float = 0.3, stands_for: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, float]:
    """Weights and bias of the classifier, by Adam on the whole (bounded) design: rows (label, on) and the changes of
    ``swaps`` (label, lost, gained, n).

    Loss: the mean log loss, plus ``ridge`` times the squared weights, plus ``fairness`` times the mean squared change of
    the log odds between sentences and their counterfactuals. In both means a row counts as the number of labelled documents
    that it ``stands_for``, given for clean and toxic ones. Without rows of both labels nothing tells toxic texts, and
    without telling features only their share is known: then no score reaches a half.
    """
    labels = np.array([r.label for r in rows], float)
    weights = np.zeros(n_features)
    if not len(labels) or labels.min() == labels.max():
        return weights, NO_EVIDENCE
    part = np.where(labels == 1, stands_for[1], stands_for[0])
    part /= part.sum()
    share = part @ labels
    if not n_features:
        return weights, min(math.log(share / (1 - share)), NO_FEATURES)
    at = np.repeat(np.arange(len(rows)), [len(r.on) for r in rows])
    on = np.concatenate([np.array(r.on, np.int64) for r in rows])
    p_part = np.array([p.n * stands_for[p.label] for p in pairs], float)
    p_part /= p_part.sum() or 1.0
    p_at = np.repeat(np.arange(len(pairs)), [len(p.lost) + len(p.gained) for p in pairs]).astype(np.int64)
    p_on = np.array([i for p in pairs for i in (*p.lost, *p.gained)], np.int64)
    p_sign = np.array([s for p in pairs for s in [1.0] * len(p.lost) + [-1.0] * len(p.gained)])
    m, v, bias = np.zeros(n_features + 1), np.zeros(n_features + 1), 0.0
    for step in range(1, steps + 1):
        slope = slope_of(weights, bias, labels, part, at, on, (p_part, p_at, p_on, p_sign), ridge, fairness)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope ** 2
        move = rate * (1 - step / (steps + 1)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, bias


def train_classifier(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, groups=IDENTITY_TERMS,
                     fairness: float = 1.0, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"):
    """(weight by feature, bias), learned from at most ``rows`` documents of each label.

    The ids of the sample are bounded by that parameter and so is what the driver receives: at most ``FEATURES`` names, their
    indexes in the sampled documents, and the different changes that swaps make, each once. Features are counted in Spark
    over the sample, and equal changes added up there. A sampled row stands for as many labelled documents as there are of its
    label for each one sampled, so the share of toxic ones is that of all labels of documents. Of several texts with one
    id the least counts.
    """
    ids = docs.select(docs[doc_id].alias("doc_id"))
    known = settle(usable_labels(labels, doc_id, label).join(ids, "doc_id", "left_semi"), "labels")
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    stands_for = tuple(max(1.0, counts.get(v, 0) / max(rows, 1)) for v in (0, 1))
    chosen = settle(sampled(known, rows), "training")
    held = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"))
    # At most 2 * rows ids of 8 bytes.
    train = settle(held.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select(
        "text", "label"), "training")
    sizes = {r.label: r.n for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    features = []
    if sizes.get(0) and sizes.get(1):
        features = chosen_features(feature_counts(train), sizes[1], sizes[0])
    made = design(train, features, groups)
    rows = made.select("label", "on").orderBy("label", "on").collect()
    weights, bias = fit(rows, swaps(made).collect(), len(features), fairness=fairness, stands_for=stands_for)
    return {f: float(w) for f, w in zip(features, weights) if abs(w) > 1e-9}, float(bias)


class Scorer:
    """Scores of texts; a feature counts once however often it occurs in a text."""

    def __init__(self, model):
        self.weights, self.bias = model
        self.memory = Memory(MEMORY)

    def find(self, words):
        return {w: tuple(f for f in features_of(w) if f in self.weights) for w in words}

    def scores(self, texts: list[str]) -> list[float]:
        words = [words_of(t) for t in texts]
        look, out = self.memory.ready(set().union(*words), self.find).__getitem__, []
        for found in words:
            on = {f for fs in map(look, found) if fs for f in fs}
            z = self.bias + math.fsum(self.weights[f] for f in on)
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def scored(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    plain = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"),
                        (F.crc32(F.coalesce(docs[doc_id].cast("string"), F.lit(""))) % 5 == 0).alias("held_out"))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def judge(batches):
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch, "text"):
                scores = scorer.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32())],
                    ["doc_id", "held_out", "score", "predicted"])

    return plain.mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, in their own columns."""
    at = docs.columns.index(text)

    def keep(batches):
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch, at):
                scores = scorer.scores([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, groups=IDENTITY_TERMS, fairness: float = 1.0,
             doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    A logistic classifier over the words of a text and their beginnings. It learns from labelled rows whose
    crc32(doc_id as text) is not divisible by 5, and is penalised for every change of its score when an identity term in
    a labelled sentence is swapped for another (``groups``), so naming a group is no evidence. Neither labels nor any
    column but the text enters a score.

    Null and empty texts get the score of a text without features. Null ids are scored (their crc32 is that of the empty
    text). Labels that are null or not 0 or 1, contradict each other or belong to no document are ignored. A text is only
    rejected on evidence: without rows of both labels, or without telling features, every score is below 0.5. Repeated rows
    are scored each; either table may be empty. Whole texts are read; nothing but the bounded sample is shuffled.
    """
    return scored(docs, train_classifier(docs, labels, rows, groups, fairness, doc_id, text, label), doc_id, text)
