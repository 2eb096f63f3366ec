"""Rules on decisions and cases. Each gives a reason or null, so that bad rows go aside and good ones go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import text as X

# Provenance that a released case must name.
REQUIRED_META = ("source", "source_id", "original_id", "original_split", "source_split", "group_key", "source_family", "task_family", "domain")


def question_reason() -> Column:
    """Why a decision row of :func:`cases.explode_decisions` has no valid question; null where it has.

    A choice needs two options or more with non-blank keys and distinct descriptions where given; a score an ordered
    list of two or more distinct non-blank levels; a binary decision the keys false and true."""
    crit_keys = F.json_object_keys("criteria")
    given = F.filter("option_desc", lambda d: d.isNotNull() & (d != ""))
    size = F.coalesce(F.size("option_keys"), F.lit(-1))
    choice = (
        F.when(~F.col("criteria").startswith("{") | (size < 2), "choice needs two options")
        .when(~F.forall("option_keys", X.non_blank), "blank option key")
        .when(F.size(F.array_distinct(given)) < F.size(given), "equal option descriptions")
    )
    score = (
        F.when(~F.col("criteria").startswith("[") | (size < 2), "score needs two levels")
        .when(~F.forall("option_desc", X.non_blank), "blank level")
        .when(F.size(F.array_distinct("option_desc")) < F.size("option_desc"), "equal levels")
    )
    noul = F.when(~F.coalesce(F.sort_array(crit_keys) == F.array(F.lit("false"), F.lit("true")), F.lit(False)), "binary decision needs false and true")
    kind = F.col("qtype")
    return (
        F.when(kind.isNull() | ~kind.isin(*D.KINDS), "unknown kind of decision")
        .when(~X.non_blank(F.col("instructions")), "blank instructions")
        .when(F.col("criteria").isNull(), "no criteria")
        .when(kind == "choice", choice)
        .when(kind == "score", score)
        .otherwise(noul)
    )


def gold_reason() -> Column:
    """Why a decision row has no valid gold distribution; null where it has."""
    keys = F.map_keys("gold_map")
    whole = F.coalesce((F.size(F.array_except(keys, "option_keys")) == 0) & (F.size(F.array_except("option_keys", keys)) == 0), F.lit(False))
    return (
        F.when(F.col("gold_map").isNull(), "no gold")
        .when(F.col("gold_type") != F.col("qtype"), "gold of another kind")
        .when(~whole, "probabilities of other keys")
        .when(~D.is_distribution(F.col("gold_probs")), "no distribution")
    )


def case_reason() -> Column:
    """Why a case row has no valid frame; null where it has. The state must be a JSON text, object or list that isn't
    empty; questions and gold must name the same questions, at least one."""
    state = F.ltrim("state")
    asked, told = F.json_object_keys("questions"), F.json_object_keys("gold")
    same = F.coalesce((F.size(F.array_except(asked, told)) == 0) & (F.size(F.array_except(told, asked)) == 0), F.lit(False))
    return (
        F.when(F.col("state").isNull() | ~state.rlike(r'^["{\[]'), "state is no text, object or list")
        .when(state.rlike(r'^(""|\{\s*\}|\[\s*\])\s*$'), "empty state")
        .when(F.coalesce(F.size(asked), F.lit(0)) < 1, "no questions")
        .when(~same, "questions and gold differ")
    )


def quarantine(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and those with one beside it."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def single_decision(cases: DataFrame) -> DataFrame:
    """Cases that ask exactly one question."""
    return cases.where(F.size(F.json_object_keys("questions")) == 1)
