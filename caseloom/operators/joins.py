"""Joins of the build: judged pairs, lookups with audits, memberships, fan-out over vocabularies, exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.shared import hot_keys, salted_lookup


def judged_pairs(pairs: DataFrame, queries: DataFrame, passages: DataFrame) -> DataFrame:
    """``pairs(qid, pid, grade)`` with the texts of both sides. Only referenced passages take part: the pair side's
    ids reach the passages as a semi-join before the wide text is shuffled. Queries and passages with very many pairs
    are spread."""
    wanted = passages.join(pairs.select("pid").distinct(), "pid", "left_semi")
    hot = {key: hot_keys(pairs, key) for key in ("qid", "pid")}
    asked = salted_lookup(pairs, queries, "qid", hot["qid"], F.xxhash64("pid"))
    return salted_lookup(asked, wanted, "pid", hot["pid"], F.xxhash64("qid"))


def missing_references(pairs: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Pairs whose ``key`` has no row in ``table``; a build stops where there is one."""
    return pairs.join(table.select(key), key, "left_anti")


def lookup_or_reason(rows: DataFrame, table: DataFrame, key: str, value: str, reason: str) -> DataFrame:
    """Rows with the table's ``value``, and a reason where the table has no such key; rows of hot keys are spread."""
    told = [c for c, kind in rows.dtypes if "map<" not in kind]  # maps have no hash
    return salted_lookup(rows, table.select(key, value), key, hot_keys(rows, key), F.xxhash64(*told), "left").withColumn("reason", F.when(F.col(value).isNull(), reason))


def repeated_keys(table: DataFrame, key: str) -> DataFrame:
    """Keys of a lookup table that occur more than once, which stops a build."""
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def membership_agrees(candidates: DataFrame, gold: DataFrame, key: str, value: str, label: str, separator: str = "##") -> DataFrame:
    """Candidates whose label (0 or 1) agrees or not with membership in the gold list ``key -> a##b``."""
    entries = gold.select(key, F.explode(F.split("result", separator)).alias(value)).distinct().withColumn("_in", F.lit(1))
    joined = candidates.join(entries, [key, value], "left")
    return joined.withColumn("member", F.coalesce("_in", F.lit(0))).drop("_in").withColumn("agrees", F.col("member") == F.col(label))


def fan_out(rows: DataFrame, labels: Column, vocabulary: list[str]) -> DataFrame:
    """One row for each row and word of a closed vocabulary, with whether the row has the label."""
    words = F.array(*map(F.lit, vocabulary))
    return rows.withColumn("label_name", F.explode(words)).withColumn("holds", F.coalesce(F.array_contains(labels, F.col("label_name")), F.lit(False)))


def outside_vocabulary(labels: Column, vocabulary: list[str]) -> Column:
    """Labels that the vocabulary doesn't have; a row with any is rejected."""
    return F.array_except(F.array_distinct(labels), F.array(*map(F.lit, vocabulary)))


def zipped_by_place(left: DataFrame, right: DataFrame, key: str, place: str) -> DataFrame:
    """Two lists joined by the place of their entries within a key; an unequal length shows as a null side."""
    return left.join(right, [key, place], "full")


def overlapping_texts(rows: DataFrame, text: str, held_out: DataFrame, held_text: str) -> DataFrame:
    """Rows whose text, spaces collapsed and in lower case, also stands in a held-out table; compared by digest."""
    key = lambda c: X.digest(F.lower(X.collapse_space(F.col(c))))
    return rows.withColumn("_k", key(text)).join(held_out.select(key(held_text).alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def matched_answers(questions: DataFrame, answers: DataFrame, key: str, answer: str, agree: list[str]) -> DataFrame:
    """Questions with the answer of an answer file, or a reason.

    An id may have several answer rows if all give one answer; fields named in ``agree`` must be equal on both sides,
    null only to null. The answer side is combined to a row an id before the join."""
    one = answers.groupBy(key).agg(
        F.min(answer).alias(answer), (F.min(answer) != F.max(answer)).alias("_torn"), *[F.min(c).alias(f"_{c}") for c in agree], *[(~F.min(c).eqNullSafe(F.max(c))).alias(f"_{c}_torn") for c in agree]
    )
    joined = questions.join(one, key, "left")
    differs = F.lit(False)
    for c in agree:
        differs = differs | F.col(f"_{c}_torn") | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    reason = F.when(F.col(answer).isNull(), "no answer").when(F.col("_torn"), "answers contradict").when(differs, "fields differ")
    return joined.withColumn("reason", reason).drop("_torn", *[f"_{c}" for c in agree], *[f"_{c}_torn" for c in agree])
