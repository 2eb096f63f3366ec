"""Pairs inside groups, without giving one task an unbounded group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Scratch, heaviest, salted_lookup

#: Rows of one block. A group of n rows becomes ceil(n / BLOCK) blocks, each pair of which is a join key of its own.
BLOCK = 2000


def sized_members(rows: DataFrame, wanted: DataFrame | None, key: str, row_id: str, scratch: Scratch, label: str = "sizes") -> DataFrame:
    """``rows`` of groups with at least two rows, with ``n``, the size of the group. ``wanted`` limits the keys."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if wanted is not None:
        sizes = sizes.join(wanted, key, "left_semi")
    sizes = scratch.keep(sizes, label)
    return salted_lookup(rows, sizes, key, heaviest(sizes, key), F.xxhash64(row_id))


def pairs_within(rows: DataFrame, wanted: DataFrame | None, key: str, row_id: str, scratch: Scratch, carry: str | None = None, label: str = "sizes", repeated: bool = True) -> DataFrame:
    """All pairs ``(id_a, id_b)``, id_a < id_b, of rows with one ``key``, each once per key; with ``carry`` also that
    column of both rows as ``carry_a`` and ``carry_b``.

    A group's rows are cut into blocks by a hash of ``row_id``; rows of block i meet those of block j >= i under a join
    key of their own. A group of any size is so spread over tasks of at most BLOCK x BLOCK pairs, and none is dropped.
    Rows of one key with one ``row_id`` are one row, if ``repeated`` says that there may be such; null keys pair with
    nothing."""
    members = sized_members(rows.where(F.col(key).isNotNull()), wanted, key, row_id, scratch, label)
    if repeated:
        members = members.dropDuplicates([key, row_id])
    return paired_blocks(members, key, row_id, carry)


def paired_blocks(members: DataFrame, key: str, row_id: str, carry: str | None = None) -> DataFrame:
    """:func:`pairs_within` of rows that have ``n``, at least about the size of their group; all of a group have one."""
    members = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64(F.lit(11), row_id), F.col("blocks")).cast("int"))
    kept = [F.col(carry).alias("carry")] if carry else []
    left = members.select(key, F.col(row_id).alias("id"), *kept, F.col("block").alias("i"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("j"))
    right = members.select(key, F.col(row_id).alias("id"), *kept, F.explode(F.expr("sequence(0, block)")).alias("i"), F.col("block").alias("j"))
    met = left.alias("l").join(right.alias("r"), [key, "i", "j"]).where("i < j or l.id < r.id")
    swap = F.col("l.id") < F.col("r.id")
    ends = [F.least("l.id", "r.id").alias("id_a"), F.greatest("l.id", "r.id").alias("id_b")]
    if carry:
        ends += [F.when(swap, F.col("l.carry")).otherwise(F.col("r.carry")).alias("carry_a"), F.when(swap, F.col("r.carry")).otherwise(F.col("l.carry")).alias("carry_b")]
    return met.select(*ends)
