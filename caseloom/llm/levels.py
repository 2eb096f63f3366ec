"""Problem 9: reading levels of documents. ``readability.py`` measures one text; this runs it on tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readability import NAMES, Levels, measure_many


def document_measures(documents: DataFrame) -> DataFrame:
    """``(doc_id, m)``: the measures of each text, null where there is nothing to read."""
    schema = ", ".join(f"{n} double" for n in NAMES)

    def run(batches):
        cache: dict[str, int] = {}
        for pdf in batches:
            found = measure_many(pdf["text"].tolist(), cache)
            found[(found[:, 0] == 0) & (found[:, 1] == 0)] = np.nan
            yield pd.DataFrame({"doc_id": pdf["doc_id"]} | {n: pd.Series(found[:, k], index=pdf.index) for k, n in enumerate(NAMES)})

    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id long, {schema}")


def fit_levels(documents: DataFrame, grades: DataFrame, most: int = 20_000) -> Levels:
    """Fit on at most ``most`` graded documents, those whose ids have the smallest hashes; a document's grade is the
    mean of its raters'. Null grades don't count, nor do grades of unknown documents."""
    mean = grades.where("reading_level is not null").groupBy("doc_id").agg(F.avg("reading_level").alias("grade"))
    chosen = mean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    graded = document_measures(documents.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))  # at most ``most`` rows
    rows = graded.where("words is not null and not isnan(words)").join(F.broadcast(chosen), "doc_id").orderBy("doc_id").collect()
    fitted = [({n: r[n] for n in NAMES if r[n] is not None and r[n] == r[n]}, float(r.grade)) for r in rows]
    return Levels.fit(fitted)


def reading_levels(documents: DataFrame, levels: Levels) -> DataFrame:
    """``(doc_id, estimate, reading_level)`` of every document: the estimate on the scale of grades, to six places, and
    the level from 1 to 5. Both are null for null, empty and blank texts and those without a letter. Whole texts are
    read whatever their length; the same text always gets the same level."""

    def run(batches):
        cache: dict[str, int] = {}
        for pdf in batches:
            values = levels.estimates(measure_many(pdf["text"].tolist(), cache))
            grade = pd.Series(levels.levels(values), index=pdf.index).astype("Int32")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "estimate": pd.Series(np.round(values, 6), index=pdf.index).astype("Float64"), "reading_level": grade})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, estimate double, reading_level int")


def level_profile(documents: DataFrame, levels: DataFrame) -> DataFrame:
    """The corpus by ``source``, ``kind`` and language: documents, those with a level, mean level and how many of each.

    Languages are compared by their first two letters in lower case; null stays null."""
    joined = documents.select("doc_id", "source", "kind", F.lower(F.substring("lang", 1, 2)).alias("language")).join(levels.dropDuplicates(["doc_id"]), "doc_id")
    each = [F.count_if(F.col("reading_level") == k).alias(f"level_{k}") for k in range(1, 6)]
    return joined.groupBy("source", "kind", "language").agg(F.count(F.lit(1)).alias("documents"), F.count("reading_level").alias("with_level"), F.round(F.avg("reading_level"), 6).alias("mean_level"), *each)
