"""Problem 6: records that are the same but for white space, letter case, signs or the order of their slots."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import Scratch, heaviest, salted_lookup
from .grouping import pairs_within
from .lookforms import LookForm, contents
from .textforms import raw_bigrams

#: Multiset hashes add modulo this prime; two lanes give about 122 bits.
PRIME = (1 << 61) - 1
_FIELDS = ("type", "instruction", "text", "question")


def record_fields(raw: DataFrame, bigrams: dict[str, int] | None = None) -> DataFrame:
    """Contents of every record: ``raw_no``, ``type``, ``instruction``, ``text``, ``question`` and ``slots`` (distinct
    name and value contents; null for null, empty for none). ``type`` stays as written."""
    form = LookForm(raw_bigrams(raw) if bigrams is None else bigrams)
    lists = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("instruction", "text", "question")] + [T.StructField(c, lists) for c in ("names", "values")])

    @F.pandas_udf(schema)
    def found(instruction: pd.Series, text: pd.Series, question: pd.Series, names: pd.Series, values: pd.Series) -> pd.DataFrame:
        # Instructions and slots repeat, so each distinct one is formed once; long texts seldom do.
        short = [*set(instruction).union(t for column in (names, values) for x in column if x is not None for t in x)]
        known = dict(zip(short, contents(form.many(short))))
        columns = {
            "instruction": [known[t] for t in instruction],
            "text": contents(form.many(text.tolist())),
            "question": contents(form.many(question.tolist())),
            "names": [None if x is None else [known[t] for t in x] for x in names],
            "values": [None if x is None else [known[t] for t in x] for x in values],
        }
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()})

    made = raw.select("raw_no", "type", found("instruction", "state.text", "state.question", F.col("state.slots.name"), F.col("state.slots.value")).alias("c"))
    slots = F.array_distinct(F.zip_with("c.names", "c.values", lambda n, v: F.struct(n.alias("name"), v.alias("value"))))
    return made.select("raw_no", "type", "c.instruction", "c.text", "c.question", slots.alias("slots"))


def _pair_hash(lane: int, name: Column, value: Column) -> Column:
    """Hash of one field-name and value pair, in which a null value is a value of its own."""
    return F.pmod(F.xxhash64(F.lit(lane), name, value.isNull(), value), F.lit(PRIME))


def fingerprint(lane: int) -> Column:
    """Sum modulo PRIME of the hashes of all field-name and value pairs; their order makes no difference."""
    add = lambda a, b: F.pmod(a + b, F.lit(PRIME))
    fixed = reduce(add, [_pair_hash(lane, F.lit(c), F.col(c)) for c in _FIELDS] + [_pair_hash(lane, F.lit("slots"), F.when(F.col("slots").isNull(), F.lit(None)).otherwise(F.lit("")))])
    each = lambda s: F.pmod(F.xxhash64(F.lit(lane), F.lit("slot"), s["name"].isNull(), s["name"], F.lit("="), s["value"].isNull(), s["value"]), F.lit(PRIME))
    return F.aggregate(F.coalesce("slots", F.array().cast("array<struct<name:string,value:string>>")), fixed, lambda acc, s: add(acc, each(s)))


def _same(a: str, b: str) -> Column:
    """Equality of all fields; slots as sets, both ways and without sorting."""
    equal = [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in _FIELDS]
    x, y = F.col(f"{a}.slots"), F.col(f"{b}.slots")
    sets = x.isNull().eqNullSafe(y.isNull()) & (x.isNull() | ((F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0)))
    return reduce(lambda p, q: p & q, equal) & sets


def copy_groups(raw: DataFrame, scratch: Scratch, bigrams: dict[str, int] | None = None) -> DataFrame:
    """``(raw_no, first_no)`` of every row: ``first_no`` is the smallest ``raw_no`` of the records equal to it.

    Rows whose text and question have no content are their own group. Nulls equal nulls only, a missing list of slots
    is not an empty one, repeated slots count once. Rows with equal fingerprints are compared field by field with the
    first of their fingerprint; what differs from it (a collision) goes through another round, so no case is lost. A row
    given twice with one raw_no comes out twice."""
    fields = record_fields(raw, bigrams)
    empty = F.length(F.coalesce("text", F.lit(""))) + F.length(F.coalesce("question", F.lit(""))) == 0
    rows = scratch.keep(fields.withColumns({"empty": empty, "fp": F.struct(fingerprint(1).alias("a"), fingerprint(2).alias("b"))}), "fields")
    left, found, at = rows.where("not empty"), [], 0
    while True:
        keys = scratch.keep(left.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("raw_no").alias("first_no")).where("n > 1"), f"keys{at}")
        members = salted_lookup(left, keys, "fp", heaviest(keys, "fp"), F.xxhash64("raw_no"))
        firsts = members.where("raw_no = first_no").dropDuplicates(["first_no"]).select("first_no", F.struct(*_FIELDS, "slots").alias("b"))
        own = members.select("raw_no", "fp", "first_no", F.struct(*_FIELDS, "slots").alias("a"))
        checked = scratch.keep(salted_lookup(own, firsts, "first_no", heaviest(keys, "first_no"), F.xxhash64("raw_no")).select("raw_no", "first_no", _same("a", "b").alias("same")), f"checked{at}")
        found.append(checked.where("same").select("raw_no", "first_no"))
        if not checked.where("not same").limit(1).count():
            break
        left = left.join(checked.where("not same").select("raw_no"), "raw_no", "left_semi")
        at += 1
    grouped = reduce(DataFrame.unionByName, found).distinct()
    return rows.select("raw_no").join(grouped, "raw_no", "left").select("raw_no", F.coalesce("first_no", "raw_no").alias("first_no"))


def collapsed(raw: DataFrame, scratch: Scratch, bigrams: dict[str, int] | None = None) -> DataFrame:
    """One row per record, ``(raw_no, copies)``: the first row of each group and how many rows the group has."""
    return copy_groups(raw, scratch, bigrams).groupBy("first_no").agg(F.count(F.lit(1)).alias("copies")).select(F.col("first_no").alias("raw_no"), "copies")


def copy_pairs(raw: DataFrame, scratch: Scratch, bigrams: dict[str, int] | None = None) -> DataFrame:
    """All pairs ``(raw_a, raw_b)``, raw_a < raw_b, of rows with one ``first_no``."""
    groups = scratch.keep(copy_groups(raw, scratch, bigrams), "groups")
    return pairs_within(groups, None, "first_no", "raw_no", scratch).select(F.col("id_a").alias("raw_a"), F.col("id_b").alias("raw_b"))
