"""Problem 8: items of varying length in containers of fixed capacity.

Items of one length are alike, so a packing is made for the histogram of lengths, which has at most ``capacity``
entries whatever the corpus is. The plan says for runs of containers how many items of which length each takes; items
then find their container by their rank among the items of their length, which is worked out in the cluster."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import Scratch
from .tokens import VOCABULARY, count_tokens

#: Buckets of one length between which ranks are summed up; a bucket's rows are ranked in one task.
BUCKET_ROWS = 200_000


@dataclass
class Packing:
    """``entries``: (size, first rank, items per container, first container, containers). The last container of an
    entry may hold fewer only where ``containers`` is 1."""

    capacity: int
    entries: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    containers: int = 0


def plan_packing(histogram: dict[int, int], capacity: int) -> Packing:
    """Large-item matching: items above a third of the capacity lie at most two in a container. From the largest down,
    each is matched with the largest one left that fits beside it. Smaller items, from the largest down, go where the
    least space remains that still holds them, else into new containers. Works on runs of equal containers."""
    plan = Packing(capacity)
    left = {s: n for s, n in histogram.items() if n > 0}
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}

    def put(size: int, each: int, first: int, count: int, items: int) -> None:
        plan.entries.append((size, used[size], each, first, count))
        used[size] += items
        left[size] -= items

    def free(gap: int, first: int, count: int) -> None:
        if count and gap:
            gaps.setdefault(gap, []).append((first, count))

    third = capacity // 3
    for size in sorted((s for s in left if s > third), reverse=True):
        while left[size]:
            partner = next((t for t in range(min(size, capacity - size), third, -1) if left.get(t, 0) > (t == size)), None)
            if partner is None:
                count = left[size]
                put(size, 1, plan.containers, count, count)
                free(capacity - size, plan.containers, count)
            elif partner == size:
                count = left[size] // 2
                put(size, 2, plan.containers, count, 2 * count)
                free(capacity - 2 * size, plan.containers, count)
            else:
                count = min(left[size], left[partner])
                put(size, 1, plan.containers, count, count)
                put(partner, 1, plan.containers, count, count)
                free(capacity - size - partner, plan.containers, count)
            plan.containers += count
    for size in sorted((s for s in left if s <= third), reverse=True):
        while left[size]:
            gap = next((g for g in range(size, capacity) if gaps.get(g)), None)
            if gap is None:
                gap, count = capacity, max(1, left[size] // (capacity // size))
                first = plan.containers
                plan.containers += count
            else:
                first, count = gaps[gap].pop()
            each = gap // size
            full = min(count, left[size] // each)
            if full:
                put(size, each, first, full, full * each)
                free(gap - each * size, first, full)
            else:  # the last few items of this size share one container
                full, each = 1, left[size]
                put(size, each, first, 1, each)
                free(gap - each * size, first, 1)
            if gap < capacity:
                free(gap, first + full, count - full)
    return plan


def pack_tokens(documents: DataFrame, scratch: Scratch, capacity: int = 2048, path: str = VOCABULARY) -> DataFrame:
    """Containers of all documents: ``(doc_id, piece, first_token, tokens, container_no)``.

    Sizes are tokens of the tokenizer at ``path``; null and empty texts are left out. A text above the capacity is cut
    into full containers and a rest, which is packed like any other item; no other text is cut. The same documents
    give the same containers in every run and layout. An empty table gives no rows."""
    sizes = scratch.keep(count_tokens(documents, path=path).where("tokens > 0"), "sizes")
    starts = F.expr(f"sequence(0L, tokens - 1, {capacity}L)")
    pieces = sizes.select("doc_id", F.posexplode(starts).alias("piece", "first_token"), F.col("tokens").alias("whole"))
    pieces = pieces.select("doc_id", "piece", "first_token", F.least(F.col("whole") - F.col("first_token"), F.lit(capacity)).alias("tokens"))
    histogram = {int(r.tokens): int(r.n) for r in pieces.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    plan = plan_packing(histogram, capacity)
    buckets = max(16, sum(histogram.values()) // BUCKET_ROWS + 1)
    marked = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = marked.groupBy("tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("tokens", "bucket", before.alias("offset"))
    within = F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = marked.withColumn("within", within).join(offsets, ["tokens", "bucket"]).withColumn("rank", F.col("within") + F.col("offset"))
    entries = scratch.spark.createDataFrame(plan.entries, "size long, start long, each long, first long, count long")
    # A few entries for each of at most ``capacity`` sizes: bounded by the capacity, not by the corpus.
    met = ranked.join(F.broadcast(entries), (F.col("tokens") == F.col("size")) & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("each") * F.col("count")))
    container = F.col("first") + F.floor((F.col("rank") - F.col("start")) / F.col("each"))
    return met.select("doc_id", "piece", "first_token", "tokens", container.cast("long").alias("container_no"))


def placed(documents: DataFrame, scratch: Scratch, capacity: int = 2048, path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, whole)`` of every packed document: whether its pieces follow each other from its first token to its
    last, are no more than it needs, and lie in containers that hold no more than the capacity. Ids are unique."""
    rows = scratch.keep(pack_tokens(documents, scratch, capacity, path), "packed")
    sizes = scratch.spark.read.parquet(f"{scratch.root}/sizes").select("doc_id", F.col("tokens").alias("size"))
    loads = rows.groupBy("container_no").agg(F.sum("tokens").alias("load"))
    told = rows.join(loads, "container_no").groupBy("doc_id").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.max("load").alias("load"), F.bool_and(F.col("first_token") == F.col("piece") * capacity).alias("in_turn")
    )
    whole = (F.col("tokens") == F.col("size")) & (F.col("end") == F.col("size")) & (F.col("pieces") == F.ceil(F.col("size") / capacity)) & (F.col("load") <= capacity) & F.col("in_turn")
    return sizes.join(told, "doc_id", "left").select("doc_id", F.coalesce(whole, F.lit(False)).alias("whole"))
