"""Problem 2: one form for texts that look the same. ``lookforms.py`` makes the form itself; this runs it on tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import Scratch, heaviest, salted_lookup
from .grouping import pairs_within
from .lookforms import LookForm, bigram_counts, contents

_STRING = T.StringType()
_TEXTS = ("text", "question", "instruction")


def corpus_bigrams(df: DataFrame, columns: Sequence[Column]) -> dict[str, int]:
    """Counts of neighbouring look-alike characters over all rows and ``columns``.

    Each batch is counted where it lies and the counts are summed before they reach the driver. The size of the table
    is bounded by the fixed look-alike classes, see :func:`bigram_counts`, whatever the corpus is."""
    names = [f"_t{i}" for i in range(len(columns))]

    def count(batches):
        for batch in batches:
            found = bigram_counts(t for column in batch.columns for t in column.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())], ["pair", "n"])

    texts = df.select(*[c.cast("string").alias(n) for c, n in zip(columns, names)])
    rows = texts.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return {r.pair: int(r.n) for r in rows}


def raw_bigrams(raw: DataFrame) -> dict[str, int]:
    """:func:`corpus_bigrams` over the three texts of every raw record."""
    return corpus_bigrams(raw, [F.col("state.text"), F.col("state.question"), F.col("instruction")])


def look_and_content(bigrams: dict[str, int] | None = None):
    """A pandas UDF from a text to struct(look, content); null gives nulls, '' gives ''."""
    form = LookForm(bigrams)

    @F.pandas_udf(T.StructType([T.StructField("look", _STRING), T.StructField("content", _STRING)]))
    def forms(texts: pd.Series) -> pd.DataFrame:
        looks = form.many(texts.tolist())
        return pd.DataFrame({"look": pd.Series(looks, dtype=object), "content": pd.Series(contents(looks), dtype=object)})

    return forms


def look_udf(bigrams: dict[str, int] | None = None):
    """A pandas UDF from a text to its look form; null gives null."""
    form = LookForm(bigrams)

    @F.pandas_udf(_STRING)
    def looks(texts: pd.Series) -> pd.Series:
        return pd.Series(form.many(texts.tolist()), dtype=object)

    return looks


def canonical_texts(raw: DataFrame, bigrams: dict[str, int] | None = None) -> DataFrame:
    """Look forms of ``state.text``, ``state.question`` and ``instruction`` of every row of ``raw``.

    Columns: ``raw_no``; ``text``, ``question``, ``instruction`` (the form; null for null, '' for ''); ``spelling``, a
    digest of the three texts as written; ``has_content``, whether text and question hold a letter, mark, digit or
    counted sign. Other columns of ``raw`` don't matter; an empty table gives an empty result; repeated rows stay."""
    given = {"text": F.col("state.text"), "question": F.col("state.question"), "instruction": F.col("instruction")}
    if bigrams is None:
        bigrams = raw_bigrams(raw)
    both, looks = look_and_content(bigrams), look_udf(bigrams)
    made = raw.select(
        "raw_no", both(given["text"]).alias("t"), both(given["question"]).alias("q"), looks(given["instruction"]).alias("instruction"), _digest(*given.values()).alias("spelling")
    )
    has = F.length(F.coalesce("t.content", F.lit(""))) + F.length(F.coalesce("q.content", F.lit(""))) > 0
    return made.select("raw_no", F.col("t.look").alias("text"), F.col("q.look").alias("question"), "instruction", "spelling", has.alias("has_content"))


def _digest(*columns: Column) -> Column:
    """SHA-256 over columns in which null, '' and a moved boundary all differ."""
    return F.unhex(F.sha2(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns])), 256))


def same_look_pairs(raw: DataFrame, scratch: Scratch, bigrams: dict[str, int] | None = None) -> DataFrame:
    """Pairs ``(raw_a, raw_b)``, raw_a < raw_b, whose three texts all look the same (null only like null) while their
    characters differ somewhere. Rows without any content never pair.

    Looks are compared by digest of the forms. Rows of one look and one spelling are a class, named by its smallest
    raw_no. Only classes of one look are paired, in blocks where a look has many, and both ends are then opened to their
    rows; so rows of one spelling never meet, and a class with very many rows is spread. Repeated rows count once."""
    forms = canonical_texts(raw, bigrams).where("has_content")
    short = lambda c: F.substring(c, 1, 16)
    rows = scratch.keep(forms.select("raw_no", F.struct(short(_digest(*[F.col(c) for c in _TEXTS])).alias("look"), short(F.col("spelling")).alias("spelling")).alias("at")), "looks")
    classes = scratch.keep(rows.groupBy("at").agg(F.min("raw_no").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    mixed = classes.select("at.look", "id", "at", "n")
    mixed = scratch.keep(mixed.join(mixed.groupBy("look").agg(F.count(F.lit(1)).alias("spellings")).where("spellings > 1"), "look"), "mixed")
    met = scratch.keep(pairs_within(mixed.select("look", "id"), None, "look", "id", scratch, repeated=False), "class_pairs")
    hot = heaviest(mixed, "at")
    members = scratch.keep(salted_lookup(rows, mixed.select("at", "id"), "at", hot, F.xxhash64("raw_no")).select("raw_no", "id").distinct(), "members")
    hot = heaviest(mixed, "id")
    for end in "ab":  # what meets a spread class is repeated, far less than comes out
        met = salted_lookup(members.select(F.col("id").alias(f"id_{end}"), F.col("raw_no").alias(end)), met, f"id_{end}", hot, F.xxhash64(end))
    return met.select(F.least("a", "b").alias("raw_a"), F.greatest("a", "b").alias("raw_b"))
