"""Cases: one row with a state, questions, gold and provenance; decisions: one row for each question of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import text as X

_OBJECT, _ARRAY = "map<string,string>", "array<string>"


def explode_decisions(cases: DataFrame) -> DataFrame:
    """One row for each question of a case with JSON columns ``state``, ``questions`` and ``gold``.

    Adds ``question_id``, ``qtype``, ``instructions``, ``criteria`` (JSON), ``option_keys``, ``option_desc``,
    ``gold_type``, ``gold_map`` and ``gold_probs`` (doubles in option order, null for what is no number). The order of
    the options is that of the criteria; a binary decision's is false, true. Questions that aren't an object give no
    row here; :func:`validation.case_reason` reports them."""
    question = F.from_json("_question", _OBJECT)
    gold = F.from_json(F.element_at(F.from_json("gold", _OBJECT), F.col("question_id")), _OBJECT)
    rows = cases.select("*", F.explode(F.from_json("questions", _OBJECT)).alias("question_id", "_question"))
    rows = rows.withColumns({"_q": question, "_g": gold})
    rows = rows.withColumns(
        {
            "qtype": F.element_at("_q", F.lit("type")),
            "instructions": F.element_at("_q", F.lit("instructions")),
            "criteria": F.element_at("_q", F.lit("criteria")),
            "gold_type": F.element_at("_g", F.lit("type")),
            "gold_map": F.from_json(F.element_at("_g", F.lit("probabilities")), _OBJECT),
        }
    )
    crit, levels = F.from_json("criteria", _OBJECT), F.from_json("criteria", _ARRAY)
    rows = rows.withColumns({"_crit": F.when(F.col("criteria").startswith("{"), crit), "_levels": F.when(F.col("criteria").startswith("["), levels)})
    numbers = F.transform(F.sequence(F.lit(0), F.size("_levels") - 1), lambda i: i.cast("string"))
    sides = F.array(F.lit("false"), F.lit("true"))
    keys = F.when(F.col("qtype") == "score", F.when(F.size("_levels") > 0, numbers)).when(F.col("qtype") == "noul", sides).otherwise(F.map_keys("_crit"))
    described = F.when(F.col("qtype") == "score", F.col("_levels")).when(F.col("qtype") == "noul", F.transform(sides, lambda k: F.element_at("_crit", k))).otherwise(F.map_values("_crit"))
    rows = rows.withColumns({"option_keys": keys, "option_desc": described})
    rows = rows.withColumn("gold_probs", F.transform("option_keys", lambda k: F.element_at("gold_map", k).try_cast("double")))
    return rows.drop("_question", "_q", "_g", "_crit", "_levels")


def case_digest(source_id: Column, state_json: Column, question_json: Column) -> Column:
    """24 hex digits that name a case: digest of the JSON list of its source id, state and question."""
    whole = F.concat(F.lit("["), X.json_quote(source_id), F.lit(","), state_json, F.lit(","), question_json, F.lit("]"))
    return F.substring(X.digest(whole), 1, 24)


def input_key(state_json: Column, questions_json: Column) -> Column:
    """Digest of state and questions as written: equal for exactly equal inputs."""
    return X.digest(F.concat(F.lit("["), state_json, F.lit(","), questions_json, F.lit("]")))


def question_json(kind: str, instructions: Column, keys: Column, descriptions: Column) -> Column:
    """Compact JSON of a question with its options in order."""
    if kind == "score":
        criteria = F.to_json(descriptions)
    else:
        pairs = F.zip_with(keys, descriptions, lambda k, d: F.concat(X.json_quote(k), F.lit(":"), F.coalesce(X.json_quote(d), F.lit("null"))))
        criteria = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    return F.concat(F.lit(f'{{"type":"{kind}","instructions":'), X.json_quote(instructions), F.lit(',"criteria":'), criteria, F.lit("}"))


def gold_json(kind: str, keys: Column, probabilities: Column) -> Column:
    """Compact JSON of a gold distribution; numbers keep one decimal at least."""
    pairs = F.zip_with(keys, probabilities, lambda k, p: F.concat(X.json_quote(k), F.lit(":"), p.cast("string")))
    return F.concat(F.lit(f'{{"type":"{kind}","probabilities":{{'), F.array_join(pairs, ","), F.lit("}}"))


def lettered_options(options: Column) -> Column:
    """Keys of a list of options: letters, then numbered names."""
    return F.transform(options, lambda o, i: X.option_letter(i))


def option_reason(options: Column, answer: Column) -> Column:
    """Why a list of options with the answer's place (from 0) makes no choice; null where it does."""
    return (
        F.when(options.isNull() | (F.size(options) < 2), "fewer than two options")
        .when(F.size(F.array_distinct(options)) < F.size(options), "repeated options")
        .when(~F.forall(options, X.non_blank), "blank option")
        .when(answer.isNull() | (answer < 0) | (answer >= F.size(options)), "answer out of range")
    )


def decorate(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """Provenance of the build's source filled in where a case has none; ``reason`` where both differ.

    ``sources`` is the build's configuration, a few rows of fixed number, so it is broadcast. Cases of an unknown
    source get a reason too."""
    table = F.broadcast(sources.select(F.col("name").alias("_name"), *[F.col(c).alias(f"_{c}") for c in ("source_family", "task_family", "domain", "revision", "license")]))
    joined = cases.join(table, cases["source"] == table["_name"], "left")
    fields = ("source_family", "task_family", "domain", "revision", "license")
    clash = F.concat_ws(",", *[F.when(F.col(c).isNotNull() & F.col(f"_{c}").isNotNull() & (F.col(c) != F.col(f"_{c}")), F.lit(c)) for c in fields])
    reason = F.when(F.col("_name").isNull(), "unknown source").when(clash != "", F.concat(F.lit("contradicts its source: "), clash))
    return joined.select(*[F.coalesce(c, F.col(f"_{c}")).alias(c) if c in fields else F.col(c) for c in cases.columns], reason.alias("reason"))


def compiled_targets(rows: DataFrame) -> DataFrame:
    """Number of the kind, normalized target in option order and label (first of the largest) of each decision."""
    target = D.normalized(F.col("gold_probs"))
    return rows.withColumns({"kind_no": D.kind_number(F.col("qtype")), "target": target}).withColumn("label", D.first_largest(F.col("target")))


def normalized_criteria(kind: Column, criteria: Column) -> Column:
    """Criteria in one form: a list of choices becomes an object without descriptions, keys of a binary decision are in
    lower case; others stay as they are."""
    words, sides = F.from_json(criteria, _ARRAY), F.from_json(criteria, _OBJECT)
    listed = F.concat(F.lit("{"), F.array_join(F.transform(words, lambda w: F.concat(X.json_quote(w), F.lit(":null"))), ","), F.lit("}"))
    lowered = F.transform(F.map_entries(sides), lambda e: F.concat(X.json_quote(F.lower(e["key"])), F.lit(":"), F.coalesce(X.json_quote(e["value"]), F.lit("null"))))
    return (
        F.when((kind == "choice") & F.ltrim(criteria).startswith("["), listed)
        .when((kind == "noul") & F.ltrim(criteria).startswith("{"), F.concat(F.lit("{"), F.array_join(lowered, ","), F.lit("}")))
        .otherwise(criteria)
    )
