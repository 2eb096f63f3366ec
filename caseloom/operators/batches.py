"""Batch plans of an epoch, shards and seeded subsets, all from hashes, so that every layout gives the same plan."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Slices of a rank, or four times the session's shuffle partitions where that is more.
BUCKETS = 256
#: Items of a subset that are chosen by a bounded sort; more are chosen by rank.
SORTED = 100_000


def global_rank(rows: DataFrame, order: Column, *ties: str) -> DataFrame:
    """Each row with ``rank`` from 0 by a value in [0, 1), without a single-task sort: rows fall into equal slices of
    the range, slices are ranked in parallel and shifted by the sizes of those before."""
    slices = max(BUCKETS, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sliced = rows.withColumn("_u", order).withColumn("_slice", F.least(F.floor(F.col("_u") * slices), F.lit(slices - 1)).cast("int"))
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))  # at most ``slices`` rows
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy("_slice").orderBy("_u", *ties)) - 1
    return sliced.withColumn("_within", within).join(F.broadcast(shifts), "_slice").withColumn("rank", F.col("_within") + F.col("_shift")).drop("_u", "_slice", "_within", "_shift")


def fixed_batches(items: DataFrame, item: str, length: str, size: int, seed: int) -> DataFrame:
    """``(item, window, batch, place)``: items in hash order are cut into windows of max(64 sizes, 1024), sorted by
    length within a window and cut into batches. Each item is planned once."""
    window = max(64 * size, 1024)
    ranked = global_rank(items.select(item, length), X.hash_fraction(F.col(item).cast("string"), seed), item)
    ranked = ranked.withColumn("window", F.floor(F.col("rank") / window))
    place = F.row_number().over(Window.partitionBy("window").orderBy(length, item)) - 1
    placed = ranked.withColumn("_place", place)
    batch = F.col("window") * F.lit(-(-window // size)) + F.floor(F.col("_place") / size)
    return placed.select(item, length, "window", batch.cast("long").alias("batch"), (F.col("_place") % size).cast("int").alias("place"))


def epoch_order(plan: DataFrame, batch: str, seed: int, epoch: int) -> DataFrame:
    """Each row of a plan with ``step``, the place of its batch in an epoch: batches are shuffled by the hash of their
    number with the seed and the epoch, the items in them stay."""
    numbers = global_rank(plan.select(batch).distinct(), X.hash_fraction(F.concat_ws(":", F.lit(str(epoch)), F.col(batch).cast("string")), seed), batch)
    return plan.join(numbers.withColumnRenamed("rank", "step"), batch)


def token_batches(items: DataFrame, item: str, length: str, cap: int, window: int, seed: int) -> DataFrame:
    """``(item, window, batch, place)`` under a cap of tokens in a batch: within a window of hash order, items sorted
    by length are packed greedily. A running sum that starts again isn't a window function, so each window, of fixed
    size, goes through Arrow as a whole. An item above the cap is a batch of its own."""
    ranked = global_rank(items.select(item, length), X.hash_fraction(F.col(item).cast("string"), seed), item)
    ranked = ranked.withColumn("window", F.floor(F.col("rank") / window).cast("long")).drop("rank")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, item], kind="stable").reset_index(drop=True)
        batch, place, now, width, count = [], [], 0, 0, 0
        for n in pdf[length]:
            if count and width + n > cap:
                now, width, count = now + 1, 0, 0
            batch.append(now)
            place.append(count)
            width, count = width + n, count + 1
        return pdf.assign(batch=pd.Series(batch, dtype="int64"), place=pd.Series(place, dtype="int32"))[[item, length, "window", "batch", "place"]]

    kind = dict(items.dtypes)
    return ranked.groupBy("window").applyInPandas(pack, f"`{item}` {kind[item]}, `{length}` {kind[length]}, window long, batch long, place int")


def shards(plan: DataFrame, batch: str, world: int) -> DataFrame:
    """Batches dealt round robin: ``shard`` and ``step``; steps that not every shard has are left out of ``even``."""
    numbers = plan.select(batch).distinct()
    ranked = global_rank(numbers, X.hash_fraction(F.col(batch).cast("string"), 0), batch)
    total = ranked.count()
    dealt = ranked.select(batch, (F.col("rank") % world).cast("int").alias("shard"), F.floor(F.col("rank") / world).cast("long").alias("step"))
    return plan.join(dealt.withColumn("even", F.col("step") < total // world), batch)


def seeded_subset(items: DataFrame, item: str, count: int, seed: int) -> DataFrame:
    """``count`` items with the smallest hash fractions: the sampling operator, which a larger count only extends. More
    than SORTED items are chosen by their rank, so that no task sorts them all."""
    if count > SORTED:
        return global_rank(items, X.hash_fraction(F.col(item).cast("string"), seed), item).where(F.col("rank") < count).drop("rank")
    return items.orderBy(X.hash_fraction(F.col(item).cast("string"), seed), item).limit(count)


def published_partition(sizes: dict[str, int], seed: int) -> dict[int, str]:
    """The split of each record number of a closed corpus that was published with a seeded shuffle of Python's own
    generator: numbers 0 to n - 1 are shuffled and cut into ``sizes`` in order. Only such corpora, of a size given by
    the caller, go through the driver."""
    order = list(range(sum(sizes.values())))
    random.Random(seed).shuffle(order)
    out, at = {}, 0
    for split, size in sizes.items():
        out |= dict.fromkeys(order[at : at + size], split)
        at += size
    return out
