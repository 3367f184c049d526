"""Losses and pooling as column and aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.exprs import cosine_similarity


def sigmoid(x: Column) -> Column:
    """P15."""
    return 1 / (1 + F.exp(-x))


def bce(logit: Column, target: Column) -> Column:
    """Binary cross-entropy of a logit, in the form that doesn't overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def focal_bce(logit: Column, target: Column, gamma: float = 2.0) -> Column:
    """Cross-entropy, less where the prediction is already right."""
    p = sigmoid(logit)
    return F.pow(1 - F.when(target >= 0.5, p).otherwise(1 - p), F.lit(gamma)) * bce(logit, target)


def soft_dice(logit: Column, target: Column, epsilon: float = 1e-6) -> Column:
    """An aggregate over the rows of a mask."""
    p = sigmoid(logit)
    return 1 - (2 * F.sum(p * target) + epsilon) / (F.sum(p) + F.sum(target) + epsilon)


def gated_kl(student_logit: Column, teacher: Column, threshold: float = 0.8) -> Column:
    """Mean divergence of the student from teachers that are sure; 0 if none is."""
    sure = F.greatest(teacher, 1 - teacher) >= threshold
    log_p, log_q = -F.log1p(F.exp(-student_logit)), -F.log1p(F.exp(student_logit))
    part = lambda t, s: F.when(t > 0, t * (F.log(t) - s)).otherwise(0.0)
    return F.coalesce(F.avg(F.when(sure, part(teacher, log_p) + part(1 - teacher, log_q))), F.lit(0.0))


def fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def pooled(values: Column) -> dict[str, Column]:
    """F11 over one array of scores: mean, population deviation and mean weighted by softmax; null for an empty array."""
    n = F.nullif(F.size(values), F.lit(0))
    mean = fold(F.transform(values, lambda v: v.cast("double"))) / n
    var = fold(F.transform(values, lambda v: F.pow(v.cast("double") - mean, F.lit(2.0)))) / n
    weight = F.transform(values, lambda v: F.exp(v.cast("double") - F.array_max(values).cast("double")))
    soft = fold(F.zip_with(values, weight, lambda v, w: v.cast("double") * w)) / F.nullif(fold(weight), F.lit(0.0))
    return {"mean": mean, "deviation": F.sqrt(var), "softmax_mean": soft}


def provenance_probabilities(ai_logit: Column, tamper_logit: Column) -> tuple[Column, Column, Column]:
    """Fully generated, tampered and authentic from two logits."""
    a, t = sigmoid(ai_logit), sigmoid(tamper_logit)
    return a, (1 - a) * t, (1 - a) * (1 - t)


def mean_squared_error(a: Column, b: Column) -> Column:
    """of two arrays; null for empty ones."""
    return fold(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y, F.lit(2.0)))) / F.nullif(F.size(a), F.lit(0))


def consistency(a: Column, b: Column, kind: str = "cosine") -> Column:
    """Mean over the rows of 1 - cosine similarity or of the squared error of two feature arrays."""
    return F.avg(1 - cosine_similarity(a, b) if kind == "cosine" else mean_squared_error(a, b))


def mean_view(logits: Column) -> Column:
    """Probability of the mean logit of several views; an aggregate."""
    return sigmoid(F.avg(logits))


def pooled_vectors(tokens: Column, scores: Column, share: float = 0.05) -> dict[str, Column]:
    """F11 over an array of token vectors: by position the mean, the population deviation, the mean weighted by softmax of the scores and the mean of the best ``share`` by score."""
    n, places = F.size(tokens), F.sequence(F.lit(1), F.size(F.element_at(tokens, 1)))
    at = lambda i: F.transform(tokens, lambda t: F.element_at(t, i).cast("double"))
    mean = lambda i: fold(at(i)) / n
    weight = F.transform(scores, lambda s: F.exp(s.cast("double") - F.array_max(scores)))
    best = F.slice(F.sort_array(F.zip_with(scores, tokens, lambda s, t: F.struct(s.alias("s"), t.alias("t"))), asc=False), F.lit(1), F.greatest(F.lit(1), F.ceil(n * share)).cast("int"))
    return {
        "mean": F.transform(places, mean), "deviation": F.transform(places, lambda i: F.sqrt(fold(F.transform(at(i), lambda v: F.pow(v - mean(i), F.lit(2.0)))) / n)),
        "softmax_mean": F.transform(places, lambda i: fold(F.zip_with(at(i), weight, lambda v, w: v * w)) / fold(weight)),
        "top_mean": F.transform(places, lambda i: fold(F.transform(best, lambda x: F.element_at(x["t"], i).cast("double"))) / F.size(best)),
    }
