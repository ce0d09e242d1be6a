"""Scores, losses and ranking of class scores, one row at a time."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to this width a dot product is written out term by term, which stays in generated code; beyond
# it an array expression keeps the plan small.
UNROLL = 64


def of_width(x: Column, width: int, value: Column, kind: str) -> Column:
    """``value`` (of type ``kind``) where the array ``x`` has ``width`` entries, null where it is null, else an error."""
    wrong = F.raise_error(F.concat(F.lit(f"{width} features expected, found "), F.size(x).cast("string")))
    return F.when(x.isNull(), F.lit(None).cast(kind)).when(F.size(x) == width, value).otherwise(wrong.cast(kind))


def dot(x: Column, weights) -> Column:
    """Inner product of an array column with a list of numbers; another number of entries is an error at any width."""
    if len(weights) <= UNROLL:
        total = F.lit(0.0)
        for i, w in enumerate(weights):
            total = total + x[i] * F.lit(float(w))
    else:
        w = F.lit([float(v) for v in weights])
        total = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return of_width(x, len(weights), total, "double")


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def bce(z: Column, y: Column) -> Column:
    """Binary cross entropy of the logit ``z``, without overflow."""
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * y


def squared_error(z: Column, y: Column) -> Column:
    return (z - y) * (z - y)


def logistic_slope(z: Column, y: Column) -> Column:
    """Derivative of ``bce`` by the logit."""
    return sigmoid(z) - y


def squared_slope(z: Column, y: Column) -> Column:
    return 2 * (z - y)


# A loss is a row loss with its derivative by the score; both take (score, target).
LOSSES = {"BCE": (bce, logistic_slope), "MSE": (squared_error, squared_slope)}


def loss_pair(kind: str):
    if kind not in LOSSES:
        raise ValueError(f"unknown loss {kind}")
    return LOSSES[kind]


def cross_entropy(scores: Column, label: Column) -> Column:
    """``logsumexp(scores) - scores[label]``."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - top))
    return top + F.ln(total) - scores[label]


def top_classes(scores: Column, k: int) -> Column:
    """Indices of the ``k`` best scores, best first; equal scores in index order."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda e: e["i"])


def in_top(scores: Column, label: Column, k: int) -> Column:
    """1.0 where fewer than ``k`` classes rank before the label, else 0.0; no sort needed."""
    own = scores[label]
    ahead = F.size(F.filter(scores, lambda s, i: (s > own) | ((s == own) & (i < label))))
    return F.when(ahead < k, 1.0).otherwise(0.0)
