"""Length statistics: histograms, exact percentiles, retention, head budgets, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ends of the length histogram, caps that a recommendation chooses from, least width left to a head.
BINS = (64, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096, 6144, 8192, 16384)
CAPS = (1024, 2048, 4096, 6144, 8192)
HEAD_ROOM, OPTION_TOKENS = 16, 48
QUANTILES = (0.5, 0.9, 0.95, 0.99, 0.999)


def length_summary(rows: DataFrame, length: Column, by: list[str] | None = None) -> DataFrame:
    """Number, largest, mean and exact percentiles of a length; percentiles are cut to whole numbers.

    Exact percentiles count each distinct length, so the state is bounded by the number of different lengths."""
    q = F.percentile(length, F.array(*map(F.lit, QUANTILES)))
    out = rows.groupBy(*(by or [])).agg(F.count(length).alias("n"), F.max(length).alias("largest"), F.avg(length).alias("mean"), q.alias("q"))
    named = [F.get("q", F.lit(i)).cast("long").alias(f"p{str(p * 100).rstrip('0').rstrip('.').replace('.', '_')}") for i, p in enumerate(QUANTILES)]
    return out.select(*(by or []), "n", "largest", "mean", *named)


def length_histogram(rows: DataFrame, length: Column, bins: tuple[int, ...] = BINS) -> DataFrame:
    """``(bin, n)``: how many rows have at most each length; counted in one pass over the rows."""
    counts = rows.agg(*[F.count_if(length <= b).alias(str(b)) for b in bins])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bin"), F.col(str(b)).alias("n")) for b in bins])).alias("x")).select("x.bin", "x.n")


def retention(rows: DataFrame, length: Column, caps: tuple[int, ...] = CAPS) -> DataFrame:
    """``(cap, kept, share)`` for each cap."""
    counts = rows.agg(F.count(length).alias("all"), *[F.count_if(length <= c).alias(f"c{c}") for c in caps])
    each = F.array(*[F.struct(F.lit(c).alias("cap"), F.col(f"c{c}").alias("kept"), (F.col(f"c{c}") / F.col("all")).alias("share")) for c in caps])
    return counts.select(F.explode(each).alias("x")).select("x.cap", "x.kept", "x.share")


def recommended_cap(rows: DataFrame, length: Column, least: float = 0.995, caps: tuple[int, ...] = CAPS) -> DataFrame:
    """``(cap)``: the first that keeps at least the given share; null where none does."""
    return retention(rows, length, caps).agg(F.min(F.when(F.col("share") >= least, F.col("cap"))).alias("cap"))


def head_width(option_tokens: Column) -> Column:
    """Width of a head's options: a marker and at most 48 tokens for each."""
    return F.aggregate(option_tokens, F.lit(0), lambda a, n: a + 1 + F.least(n.cast("int"), F.lit(OPTION_TOKENS)))


def fits_head(option_tokens: Column, head_cap: int) -> Column:
    """Whether the options leave at least 16 tokens to the instruction."""
    return F.lit(head_cap) - head_width(option_tokens) >= HEAD_ROOM


def head_budget(rows: DataFrame, width: Column, options: Column, order: Column) -> DataFrame:
    """``(p50, p99, largest, recommended)`` of head widths; recommended is the width of the row with most options, the
    first in order among equals, plus what the instruction needs, rounded up to 64."""
    q = F.percentile(width, F.array(F.lit(0.5), F.lit(0.99)))
    widest = F.min_by(width, F.struct((-options).alias("o"), order.alias("at")))
    return rows.agg(q.alias("q"), F.max(width).alias("largest"), widest.alias("w")).select(
        F.get("q", F.lit(0)).cast("long").alias("p50"), F.get("q", F.lit(1)).cast("long").alias("p99"), "largest", (F.ceil(F.col("w") / 64) * 64).alias("recommended")
    )


def keeps_whole(prompt: Column, state: Column, cap: int) -> Column:
    """Prompt, state and the closing token fit the cap."""
    return prompt + state + 1 <= cap


def keeps_prompt(prompt: Column, cap: int) -> Column:
    """Prompt and the closing token fit the cap; the state is cut."""
    return prompt + 1 <= cap


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """``(name, value, n)`` of several columns, the most frequent first within each."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return rows.select(each).groupBy("x.name", "x.value").agg(F.count(F.lit(1)).alias("n")).orderBy("name", F.desc("n"), "value")
