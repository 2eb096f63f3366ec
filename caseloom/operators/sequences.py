"""Operators over ordered rows: dialogue prefixes, sessions, contiguity, enumeration.

Windows are partitioned by one dialogue, user or record, which people or files bound; hot keys over the whole table
go through aggregates elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dialogue_prefixes(turns: DataFrame, dialogue: str, turn: str, text: str) -> DataFrame:
    """Each turn with ``prefix``: the texts up to and including it, one a line. A null text counts as none."""
    upto = Window.partitionBy(dialogue).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("prefix", F.array_join(F.collect_list(text).over(upto), "\n"))


def session_starts(rows: DataFrame, key: str, time: str, gap_seconds: float, tie: str = "event_id") -> DataFrame:
    """Each row with ``session``: the number from 1 of its run of rows at most a gap apart; ``tie`` orders rows of one
    time."""
    by = Window.partitionBy(key).orderBy(time, tie)
    far = F.coalesce((F.timestamp_diff("MICROSECOND", F.lag(time).over(by), F.col(time)) > int(gap_seconds * 1e6)).cast("int"), F.lit(1))
    return rows.withColumn("_far", far).withColumn("session", F.sum("_far").over(by).cast("long")).drop("_far")


def last_good_before(rows: DataFrame, key: str, order: list[str], good: Column, value: str, name: str) -> DataFrame:
    """Each row with the ``value`` of the last good row before it: what a continued dialogue links to."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(good, F.col(value)), ignorenulls=True).over(before))


def broken_runs(rows: DataFrame, key: str, scope: str, order: list[str]) -> DataFrame:
    """Keys that come again within a scope after another key has come between: ``(scope, key, runs)``."""
    by = Window.partitionBy(scope).orderBy(*order)
    change = F.coalesce((~F.lag(key).over(by).eqNullSafe(F.col(key))).cast("int"), F.lit(1))
    islands = rows.withColumn("_change", change)
    return islands.groupBy(scope, key).agg(F.sum("_change").alias("runs")).where("runs > 1")


def physical_lines(text_rows: DataFrame) -> DataFrame:
    """``spark.read.text`` rows with ``file`` and ``line``, the line's number from 1 in its file.

    Blocks of a file are counted first, so that lines are numbered within blocks in parallel and shifted by the sum of
    the blocks before: no task holds a whole file. Lines already lie by their block when the sums are joined to them."""
    marked = text_rows.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at")
    )
    sizes = marked.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("_at"))
    return marked.withColumn("_n", within).join(shifts, ["file", "block"]).select("file", (F.col("_n") + F.col("shift")).alias("line"), "value")


def label_blind_order(rows: DataFrame, group: str, *content: str) -> DataFrame:
    """Each candidate of a group with ``place``, its rank by the digest of its content: an order that no label shows."""
    key = F.sha2(F.to_json(F.array(*content)), 256)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(key)))


def enumerated(rows: DataFrame, entries: Column, name: str) -> DataFrame:
    """One row for each distinct entry of a list, in sorted order, with its number from 1."""
    return rows.select("*", F.posexplode(F.array_sort(F.array_distinct(entries))).alias("_no", name)).withColumn("entry_no", F.col("_no") + 1).drop("_no")
