"""Problems 3 and 5: components of cases that share a group key or a link key, and splits that keep them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Scratch, heaviest, hot_keys, salted_lookup
from .components import components_by_decomposition, components_by_stars

#: White space of any kind, at the ends of a split's name or making up a blank link key.
_SPACE = r"[\s\x{85}\x{1c}-\x{1f}\p{Z}]"


def _blank(c: str) -> Column:
    return F.regexp_replace(c, f"^{_SPACE}+$", "") == ""


def keyed_cases(cases: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keys of all cases, and the graph over them.

    A key's node is the smallest case_no that has it; two keys with one node share that case. Gives ``keys`` (space,
    key, node), ``anchors`` (case_no, group_key, node; the smallest node of the case's keys, its own number without
    any) and ``edges`` (u, v) from the anchor of a case to the nodes of its other keys.

    Null, empty and blank link keys connect nothing, others are compared as written; group keys and link keys are
    separate name spaces; a null group key connects nothing. Repeated rows and repeated entries change nothing."""
    base = cases.select("case_no", F.col("_meta.group_key").alias("group_key"), F.col("_meta.link_keys").alias("links"))
    entries = F.array_distinct(F.coalesce("links", F.array().cast("array<string>")))
    own = base.where("group_key is not null").select("case_no", F.lit("g").alias("space"), F.col("group_key").alias("key"))
    linked = base.select("case_no", F.lit("l").alias("space"), F.explode(entries).alias("key")).where(F.col("key").isNotNull() & ~_blank("key"))
    uses = scratch.keep(own.unionByName(linked).withColumn("at", F.struct("space", "key")), "uses")
    keys = scratch.keep(uses.groupBy("at").agg(F.min("case_no").alias("node"), F.count(F.lit(1)).alias("n")), "keys")
    tied = salted_lookup(uses, keys.select("at", "node"), "at", heaviest(keys, "at"), F.xxhash64("case_no")).select("case_no", "node")
    anchor = tied.groupBy("case_no").agg(F.min("node").alias("anchor"), F.collect_set("node").alias("nodes"))  # a case's own few keys
    anchor = scratch.keep(anchor, "anchor")
    edges = anchor.select(F.col("anchor").alias("u"), F.explode("nodes").alias("v")).where("u <> v").distinct()
    anchors = base.select("case_no", "group_key").join(anchor.select("case_no", "anchor"), "case_no", "left").select("case_no", "group_key", F.coalesce("anchor", "case_no").alias("node"))
    return keys.select("at.space", "at.key", "node"), scratch.keep(anchors, "anchors"), edges


def _named(rows: DataFrame, components: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """``rows`` with the component of their ``node``; a node without edges is its own component."""
    found = salted_lookup(rows, components, "node", hot_keys(rows, "node"), F.xxhash64(*rows.columns), "left")
    return scratch.keep(found.withColumn("component", F.coalesce("component", "node")), label)


def case_components(cases: DataFrame, scratch: Scratch, find=components_by_decomposition) -> DataFrame:
    """``(case_no, group_key, component_no)`` of every case; component_no is the smallest case_no of the component."""
    _, anchors, edges = keyed_cases(cases, scratch)
    named = _named(anchors, find(edges, scratch), scratch, "named")
    return named.select("case_no", "group_key", F.col("component").alias("component_no"))


def spanning_components(cases: DataFrame, scratch: Scratch) -> DataFrame:
    """``(case_no, component_no)`` of cases whose component spans at least two group keys. Every case without a group
    key counts as a key of its own."""
    found = scratch.keep(case_components(cases, scratch).distinct(), "distinct")
    spans = found.groupBy("component_no").agg(
        F.min("group_key").alias("low"), F.max("group_key").alias("high"), F.count_if(F.col("group_key").isNull()).alias("alone"), F.count("group_key").alias("keyed")
    )
    wide = spans.where(F.col("low") < F.col("high")).select("component_no").unionByName(spans.where("coalesce(low = high, true) and alone + least(keyed, 1) > 1").select("component_no"))
    return salted_lookup(found.select("case_no", "component_no"), wide, "component_no", hot_keys(found, "component_no"), F.xxhash64("case_no")).select("case_no", "component_no")


def clean_split(c: str) -> Column:
    """A recorded split without surrounding blanks and letter case; null for null or blank."""
    trimmed = F.lower(F.regexp_replace(F.regexp_replace(c, f"^{_SPACE}+", ""), f"{_SPACE}+$", ""))
    return F.when(trimmed != "", trimmed)


def _place(component: Column, seed: int) -> Column:
    """A component's permanent place in [0, 1): the first 52 bits of the digest of its identifier."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), component.cast("string")), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _ranges(shares: dict[str, float]) -> list[tuple[str, float]]:
    """Splits with the upper ends of their ranges of [0, 1)."""
    whole, at, out = sum(shares.values()) or 1.0, 0.0, []
    for s, x in shares.items():
        at += x
        out.append((s, at / whole))
    return out


def assign_splits(cases: DataFrame, scratch: Scratch, shares: dict[str, float] | None = None, seed: int = 0, giant: float | None = 1 / 200, memory: Scratch | None = None) -> DataFrame:
    """``(group_key, component_no, split)`` of every group key: connected keys get one split, and the splits hold the
    given shares of the cases.

    Components come from alternating stars. With ``giant`` None, the method of the queries, the hash of a component's
    identifier falls into ranges in proportion to the shares and nothing else counts: a component keeps its split in
    every run, layout and growth of the table, and the shares are off by as much as large components weigh.

    With ``giant`` a first call lets components with more than this part of the cases (at most 1 / giant of them) go,
    largest first, to the split that lacks most, and the ranges of all others follow what is still lacking. Placements
    and ranges are written to ``memory``, a lasting folder; later calls with it take them as they are, so nothing moves
    when data grow. Cases without a group key count in their component's size."""
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    found = scratch.keep(case_components(cases, scratch, components_by_stars), "split-components")
    placed, ranges = {}, _ranges(shares)
    if giant is not None:
        placed, ranges = _remembered(memory) or _placed(found, shares, giant)
        if memory is not None and not memory.has("split-plan/_SUCCESS"):
            rows = [(c, s, None) for c, s in placed.items()] + [(None, s, past) for s, past in ranges]
            memory.keep(cases.sparkSession.createDataFrame(rows, "component_no long, split string, past double").coalesce(1), "split-plan")
    place, split = _place(F.col("component_no"), seed), F.lit(None).cast("string")
    for s, past in ranges:
        split = F.coalesce(split, F.when(place < past, F.lit(s)))
    split = F.coalesce(split, F.lit([s for s, past in ranges][-1]))
    keys = found.where("group_key is not null").select("group_key", "component_no").distinct()
    if placed:
        fixed = F.broadcast(cases.sparkSession.createDataFrame(list(placed.items()), "component_no long, fixed string"))  # at most 1 / giant rows
        return keys.join(fixed, "component_no", "left").select("group_key", "component_no", F.coalesce("fixed", split).alias("split"))
    return keys.select("group_key", "component_no", split.alias("split"))


def _placed(found: DataFrame, shares: dict[str, float], giant: float) -> tuple[dict[int, str], list[tuple[str, float]]]:
    """Splits of the giants, and the ranges of all other components."""
    sizes = found.groupBy("component_no").agg(F.count(F.lit(1)).alias("n"))
    total = found.count()
    giants = sizes.where(F.col("n") > max(1.0, total * giant)).orderBy(F.desc("n"), "component_no").collect()  # at most 1 / giant rows
    lacking = {s: share * total for s, share in shares.items()}
    placed = {}
    for g in giants:
        to = max(lacking, key=lambda s: (lacking[s], s))
        placed[g.component_no] = to
        lacking[to] -= g.n
    return placed, _ranges({s: x for s, x in lacking.items() if x > 0} or shares)


def _remembered(memory: Scratch | None) -> tuple[dict[int, str], list[tuple[str, float]]] | None:
    if memory is None or not memory.has("split-plan/_SUCCESS"):
        return None
    rows = memory.spark.read.parquet(f"{memory.root}/split-plan").collect()  # giants and splits
    return {r.component_no: r.split for r in rows if r.past is None}, sorted(((r.split, r.past) for r in rows if r.past is not None), key=lambda x: x[1])


def split_conflicts(cases: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """``(grp)``: every recorded ``groups.grp`` whose component was recorded in more than one split.

    A grp that no case has stands alone. Null and blank splits don't count, spelling of a split makes no difference,
    late and repeated rows change nothing; a null grp is no group."""
    found = case_components(cases, scratch, components_by_stars)
    keys = found.where("group_key is not null").groupBy("group_key").agg(F.min("component_no").alias("component_no"))
    recorded = groups.where("grp is not null").select("grp", clean_split("split").alias("split"))
    # Few splits are ever recorded for one grp: lowest and highest tell whether there are two.
    by_grp = recorded.groupBy("grp").agg(F.min("split").alias("low"), F.max("split").alias("high"))
    placed = scratch.keep(by_grp.join(keys, by_grp["grp"] == keys["group_key"], "left").select("grp", "component_no", "low", "high"), "recorded")
    alone = placed.where("component_no is null and low < high").select("grp")
    joined = placed.where("component_no is not null")
    torn = joined.groupBy("component_no").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("component_no")
    return alone.unionByName(salted_lookup(joined, torn, "component_no", hot_keys(joined, "component_no"), F.xxhash64("grp")).select("grp"))
