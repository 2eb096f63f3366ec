"""The global merge of a build: one survivor of equal inputs, contradictions out, components, splits, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import text as X
from ..plans.shared import Scratch, heaviest, hot_keys, salted_lookup
from .components import component_names, connected_groups

# Splits from the lowest priority to the highest.
SPLITS = ("train", "calibration", "validation", "test")


def split_priority(split: Column) -> Column:
    """Place of a split in SPLITS from 0; null for another word."""
    return F.when(split.isin(*SPLITS), F.array_position(F.array(*map(F.lit, SPLITS)), split) - 1).cast("int")


def input_groups(rows: DataFrame) -> DataFrame:
    """One row for each ``input_key`` of ``rows(input_key, gold_key, priority, arrival)``: the surviving ``arrival``
    (highest priority, then earliest), ``copies``, ``conflict`` (more than one gold), and ``first_gold``, that of the
    earliest row. Aggregates are combined before the shuffle, so an input with very many copies does no harm."""
    best = F.min(F.struct((-F.col("priority")).alias("p"), F.col("arrival").alias("arrival")))
    return rows.groupBy("input_key").agg(
        best.getField("arrival").alias("arrival"),
        F.count(F.lit(1)).alias("copies"),
        (F.min("gold_key") != F.max("gold_key")).alias("conflict"),
        F.min(F.struct("arrival", "gold_key")).getField("gold_key").alias("first_gold"),
    )


def survivors(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The surviving row of each input, with ``copies`` and ``conflict``; a join on the unique ``arrival``."""
    return rows.join(groups.select("arrival", "copies", "conflict"), "arrival")


def contradicting_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """All rows of inputs with more than one gold, with whether they differ from the first."""
    torn = groups.where("conflict").select("input_key", "first_gold")
    return salted_lookup(rows, torn, "input_key", heaviest(groups.withColumnRenamed("copies", "n"), "input_key"), F.xxhash64("arrival")).withColumn("differs", F.col("gold_key") != F.col("first_gold"))


def group_anchors(rows: DataFrame) -> DataFrame:
    """``(grp, anchor)`` of rows with ``grp`` and ``link_keys``: a group is its own anchor, and each link key is one."""
    own = rows.select("grp", F.concat(F.lit("group:"), F.col("grp")).alias("anchor"))
    links = rows.select("grp", F.explode("link_keys").alias("link")).where(X.non_blank(F.col("link"))).select("grp", F.concat(F.lit("link:"), F.col("link")).alias("anchor"))
    return own.unionByName(links)


def group_table(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(grp, component, priority)`` of every group of the converted rows, dropped copies included: priority is the
    highest of all rows of the component."""
    roots = connected_groups(group_anchors(rows), scratch)
    highest = rows.groupBy("grp").agg(F.max("priority").alias("priority"))
    placed = scratch.keep(roots.join(highest, "grp", "left"), "placed")
    names = component_names(placed.select("grp", "root")).join(placed.groupBy("root").agg(F.max("priority").alias("priority")), "root")
    return scratch.keep(salted_lookup(placed.select("grp", "root"), names, "root", hot_keys(placed, "root"), F.xxhash64("grp")).select("grp", "component", "priority"), "group_table")


def component_split(priority: Column, component: Column, seed: int, calibration: float, validation: float, test: float) -> Column:
    """The split of a kept row: training rows fall by their component's hash fraction into calibration, validation,
    test or train, in this order; held-out rows keep their split."""
    u = X.hash_fraction(component, seed)
    drawn = F.when(u < calibration, "calibration").when(u < calibration + validation, "validation").when(u < calibration + validation + test, "test").otherwise("train")
    return F.when(priority == 0, drawn).otherwise(F.element_at(F.array(*map(F.lit, SPLITS)), priority + 1))


def merge_cases(rows: DataFrame, scratch: Scratch, seed: int = 0, calibration: float = 0.0, validation: float = 0.0, test: float = 0.0) -> DataFrame:
    """The fate of every distinct input.

    ``rows`` has ``arrival`` (unique, in order of arrival), ``input_key``, ``gold_key``, ``grp``, ``link_keys`` and
    ``split``. The result has one row for each input: its surviving row's columns, ``copies``, ``component``,
    ``split`` (the final one) and ``fate``: ``kept``, ``conflict`` or ``cross_split`` (a row below the priority of its
    component, which is never moved into the higher split)."""
    ranked = scratch.keep(rows.withColumn("priority", split_priority(F.col("split"))), "ranked")
    groups = scratch.keep(input_groups(ranked), "inputs")
    table = group_table(ranked, scratch)
    alive = survivors(ranked, groups)
    joined = salted_lookup(alive, table.withColumnRenamed("priority", "highest"), "grp", hot_keys(ranked, "grp"), F.xxhash64("arrival"))
    fate = F.when(F.col("conflict"), "conflict").when(F.col("priority") < F.col("highest"), "cross_split").otherwise("kept")
    split = F.when(fate == "kept", component_split(F.col("priority"), F.col("component"), seed, calibration, validation, test))
    return joined.withColumns({"fate": fate, "split": split}).drop("highest", "conflict")


def unit_counts(units: DataFrame) -> DataFrame:
    """Distinct original records and groups of each source, stage and split, and decisions."""
    return units.groupBy("source", "stage", "split").agg(
        F.count_distinct("original_id").alias("original_records"), F.count_distinct("grp").alias("groups"), F.count(F.lit(1)).alias("decisions")
    )


def named_counters(merged: DataFrame, converted: DataFrame, rejected: DataFrame) -> DataFrame:
    """``(key, n)``: the build's counters in one relation."""
    one = F.count(F.lit(1)).alias("n")
    parts = [
        converted.agg(one).select(F.lit("converted").alias("key"), "n"),
        rejected.groupBy("source", "reason").agg(one).select(F.concat_ws(":", F.lit("rejected"), "source", "reason").alias("key"), "n"),
        merged.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_inputs").alias("key"), "n"),
        merged.where("fate = 'conflict'").agg(one).select(F.lit("conflicting_inputs_excluded").alias("key"), "n"),
        merged.where("fate = 'cross_split'").agg(one).select(F.lit("cross_split_group_rows_excluded").alias("key"), "n"),
        merged.agg(F.count_distinct("component").alias("n")).select(F.lit("connected_components").alias("key"), "n"),
        merged.where("fate = 'kept'").groupBy("split", "qtype").agg(one).select(F.concat_ws(":", F.lit("output"), "split", "qtype").alias("key"), "n"),
        merged.where("fate = 'kept'").groupBy("split", "source", "qtype", "label_key").agg(one).select(F.concat_ws(":", F.lit("labels"), "split", "source", "qtype", "label_key").alias("key"), "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


def label_key(keys: Column, probabilities: Column) -> Column:
    """Key of the largest probability, the first of equals."""
    return F.get(keys, D.first_largest(probabilities))
