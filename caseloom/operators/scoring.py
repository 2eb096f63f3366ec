"""Predictions against gold: accuracy, log score, calibration error, rewards, temperatures."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decisions as D


def scored(predictions: DataFrame, temperature: Column | float = 1.0) -> DataFrame:
    """Predictions ``(qtype, logits, target)`` with ``probabilities``, ``confidence`` (the largest), ``correct`` and
    ``log_score``. Padding beyond the target's options must be cut before."""
    p = D.softmax(F.col("logits"), temperature)
    out = predictions.withColumn("probabilities", p)
    return out.withColumns(
        {
            "confidence": F.array_max("probabilities"),
            "correct": (D.first_largest(F.col("probabilities")) == D.first_largest(F.col("target"))).cast("int"),
            "log_score": D.log_score(F.col("probabilities"), F.col("target")),
        }
    )


def with_temperatures(predictions: DataFrame, temperatures: dict[str, float]) -> DataFrame:
    """Scores under one temperature for each kind; a kind without one keeps 1."""
    t = F.lit(1.0)
    for kind, value in temperatures.items():
        t = F.when(F.col("qtype") == kind, float(value)).otherwise(t)
    return scored(predictions, t)


def evaluation(rows: DataFrame, *by: str) -> DataFrame:
    """Items, accuracy, mean log score and mean confidence, overall (a null kind) and by kind, in one aggregate."""
    return rows.groupingSets([[*by], [*by, "qtype"]], *by, "qtype").agg(
        F.count(F.lit(1)).alias("items"), F.avg("correct").alias("accuracy"), F.avg("log_score").alias("mean_log_score"), F.avg("confidence").alias("mean_confidence")
    )


def calibration_error(rows: DataFrame, *by: str, bins: int = 15) -> DataFrame:
    """Expected calibration error: over bins of confidence, the mean gap of confidence and accuracy by weight."""
    each = rows.groupBy(*by, D.calibration_bin(F.col("confidence"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.avg("correct").alias("a")
    )
    return each.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def fit_temperatures(predictions: DataFrame, least_rows: int = 10, low: float = 0.1, high: float = 10.0, steps: int = 120) -> dict[str, float]:
    """The temperature of each kind that minimizes the loss of its soft targets, within ``low`` and ``high``; 1 for a
    kind with fewer than ``least_rows``.

    The loss is convex in the inverse temperature, so it has one valley over the logarithm of the temperature. Each
    round takes 24 points across the range of every kind in one aggregate and closes in on the best of them; five rounds
    leave about 2e-5 of the temperature open."""
    counts = {r.qtype: r.n for r in predictions.groupBy("qtype").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges = {k: (math.log(low), math.log(high)) for k, n in counts.items() if n >= least_rows}
    points = 24
    for _ in range(max(1, math.ceil(steps / points))):
        if not ranges:
            break
        # Each row meets the points of its own kind: one narrow expression, summed before the shuffle.
        grid = F.lit(None).cast("array<double>")
        for kind, (a, b) in ranges.items():
            grid = F.when(F.col("qtype") == kind, F.array(*[F.lit(a + (b - a) * i / (points - 1)) for i in range(points)])).otherwise(grid)
        each = predictions.where(F.col("qtype").isin(*ranges)).select("qtype", "logits", "target", F.posexplode(grid).alias("i", "at"))
        sums = each.groupBy("qtype", "i").agg(F.sum(D.log_sum_exp_loss(F.col("logits"), F.col("target"), F.col("at"))).alias("loss")).collect()
        for kind, (a, b) in list(ranges.items()):
            best = min((r.loss, r.i) for r in sums if r.qtype == kind)[1]
            step = (b - a) / (points - 1)
            ranges[kind] = (max(a, a + step * (best - 1)), min(b, a + step * (best + 1)))
    return {k: math.exp(sum(ranges[k]) / 2) if k in ranges else 1.0 for k in counts}


def temperature_losses(predictions: DataFrame, temperatures: list[float]) -> DataFrame:
    """``(qtype, temperature, loss)``: the mean loss of each kind's soft targets at given temperatures, in one aggregate."""
    grid = F.array(*[F.lit(float(t)) for t in temperatures])
    each = predictions.select("qtype", "logits", "target", F.explode(grid).alias("temperature"))
    return each.groupBy("qtype", "temperature").agg(F.avg(D.log_sum_exp_loss(F.col("logits"), F.col("target"), F.log("temperature"))).alias("loss"))


def collected_logits(items: DataFrame, load: Callable[[], Callable[[list[list[int]], list[list[int]]], list[list[float]]]], size: int = 16) -> DataFrame:
    """``(id, question_id, logits)`` of items with ``ids`` and ``markers`` from any model.

    ``load`` makes the model once in each Python worker; the model takes ids and markers of up to ``size`` items, in
    order of length so that little is padded, and gives a list of logits for each."""

    def run(batches):
        model = load()
        for pdf in batches:
            order = pdf["ids"].map(len).sort_values(kind="stable").index
            found: dict[int, list[float]] = {}
            for start in range(0, len(order), size):
                chosen = order[start : start + size]
                found |= dict(zip(chosen, model([list(x) for x in pdf["ids"][chosen]], [list(x) for x in pdf["markers"][chosen]])))
            yield pdf[["id", "question_id"]].assign(logits=[found[i] for i in pdf.index])

    return items.select("id", "question_id", "ids", "markers").mapInPandas(run, "id string, question_id string, logits array<double>")
