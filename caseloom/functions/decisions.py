"""Column functions on decisions: options, targets and scores over arrays in option order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of decisions in the order of their numbers, and what an undescribed side of a binary one says.
KINDS = ("choice", "score", "noul")
FALSE_TEXT, TRUE_TEXT = "no, the statement does not hold", "yes, the statement holds"


def kind_number(kind: Column) -> Column:
    """0 choice, 1 score, 2 noul; null for another kind."""
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - F.when(kind.isin(*KINDS), 1)


def one_hot(keys: Column, selected: Column) -> Column:
    """1.0 at the selected key, 0.0 elsewhere; null where the key isn't among them."""
    return F.when(F.array_contains(keys, selected), F.transform(keys, lambda k: F.when(k == selected, 1.0).otherwise(0.0)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def normalized(values: Column) -> Column:
    """Values over their sum; null where the sum isn't positive."""
    s = total(values)
    return F.when(s > 0, F.transform(values, lambda x: x / s))


def target_of(keys: Column, probabilities: Column) -> Column:
    """Probabilities of a map in the order of ``keys``, a missing key counting 0, over their sum; null without mass."""
    return normalized(F.transform(keys, lambda k: F.coalesce(F.element_at(probabilities, k), F.lit(0.0))))


def first_largest(values: Column) -> Column:
    """Place from 0 of the largest value, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def is_distribution(values: Column, tolerance: float = 1e-4) -> Column:
    """Finite numbers between 0 and 1 with sum 1 within the tolerance; false for null."""
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    return F.coalesce(fine & (F.abs(total(values) - 1) <= tolerance), F.lit(False))


def option_texts(kind: Column, keys: Column, descriptions: Column, false_label: str = "false", true_label: str = "true") -> Column:
    """Rendered options in option order: ``key`` or ``key: description`` of a choice, ``level i: description`` of a
    score, and both sides of a binary decision with a default for an undescribed side."""
    described = lambda d: d.isNotNull() & (d != "")
    choice = F.zip_with(keys, descriptions, lambda k, d: F.when(described(d), F.concat(k, F.lit(": "), d)).otherwise(k))
    score = F.transform(descriptions, lambda d, i: F.concat(F.lit("level "), i.cast("string"), F.lit(": "), d))
    side = lambda at, label, default: F.concat(F.lit(label + ": "), F.when(described(F.get(descriptions, F.lit(at))), F.get(descriptions, F.lit(at))).otherwise(default))
    noul = F.array(side(0, false_label, FALSE_TEXT), side(1, true_label, TRUE_TEXT))
    return F.when(kind == "choice", choice).when(kind == "score", score).when(kind == "noul", noul)


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Probabilities of logits over a temperature, stable against large logits."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    scaled = F.transform(logits, lambda x: x / t)
    top = F.array_max(scaled)
    raised = F.transform(scaled, lambda x: F.exp(x - top))
    s = total(raised)
    return F.transform(raised, lambda x: x / s)


def log_score(probabilities: Column, target: Column, floor: float = -9.21) -> Column:
    """Expected logarithm of the reported probabilities under the target, each logarithm at least ``floor``."""
    logs = F.transform(probabilities, lambda p: F.greatest(F.log(F.greatest(p, F.lit(1e-12))), F.lit(floor)))
    return total(F.zip_with(target, logs, lambda t, x: t * x))


def spherical_score(probabilities: Column, target: Column) -> Column:
    norm = F.sqrt(total(F.transform(probabilities, lambda p: p * p)))
    return total(F.zip_with(target, probabilities, lambda t, p: t * p)) / F.greatest(norm, F.lit(1e-9))


def ranked_score(probabilities: Column, target: Column) -> Column:
    """Sum of squared differences of the cumulated distributions over the number of options less one."""
    gaps = F.zip_with(probabilities, target, lambda p, t: p - t)
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda a, x: F.struct((a["run"] + x).alias("run"), (a["sum"] + (a["run"] + x) * (a["run"] + x)).alias("sum"))
    return F.aggregate(gaps, start, step, lambda a: a["sum"]) / F.greatest(F.size(probabilities) - 1, F.lit(1))


def proper_reward(kind: Column, probabilities: Column, target: Column, spherical: float = 0.5, ranked: float = 1.0) -> Column:
    """Log score plus a share of the spherical score, less a share of the ranked score where options are ordered."""
    base = log_score(probabilities, target) + spherical * spherical_score(probabilities, target)
    return base - F.when(kind == "score", ranked * ranked_score(probabilities, target)).otherwise(0.0)


def entropy_confidence(probabilities: Column) -> Column:
    """1 less the entropy over the logarithm of the number of options, within 0 and 1; 1 for a single option."""
    h = -total(F.transform(probabilities, lambda p: p * F.log(F.greatest(p, F.lit(1e-12)))))
    k = F.size(probabilities)
    return F.when(k < 2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - h / F.log(k.cast("double")))))


def calibration_bin(confidence: Column, bins: int = 15) -> Column:
    """Bins of equal width, closed above; the first also below."""
    return F.greatest(F.lit(1), F.ceil(confidence * bins)).cast("int")


def log_sum_exp_loss(logits: Column, target: Column, log_temperature: Column) -> Column:
    """Negative log-likelihood of soft targets at a temperature given by its logarithm."""
    scaled = F.transform(logits, lambda x: x * F.exp(-log_temperature))
    top = F.array_max(scaled)
    norm = top + F.log(total(F.transform(scaled, lambda x: F.exp(x - top))))
    return norm * total(target) - total(F.zip_with(target, scaled, lambda t, x: t * x))


def two_largest(probabilities: Column) -> Column:
    """struct(first, second, margin): the two largest probabilities and how far apart they are; null for fewer than two."""
    order = F.sort_array(probabilities, asc=False)
    first, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    return F.when(F.size(probabilities) > 1, F.struct(first.alias("first"), second.alias("second"), (first - second).alias("margin")))
