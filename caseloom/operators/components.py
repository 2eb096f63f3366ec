"""Connected components of groups that share an anchor, for the build's own grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.shared import Scratch, heaviest, hot_keys, salted_lookup

#: Edges up to which a level's edges and nodes, two short texts each, are broadcast; more are shuffled.
FEW_EDGES = 200_000
#: Steps over which a node looks for the lowest number before a level is contracted.
STEPS = 4
#: A component of at most this many groups is named by the digest of all of them, a larger one by its least and count.
NAMED_BY_ALL = 100_000


def _draw(node: Column, level: int) -> Column:
    """A number for a node, another at each level, with the node itself to settle ties."""
    return F.struct(F.xxhash64(F.lit(level), node).alias("h"), node.alias("c"))


def connected_groups(members: DataFrame, scratch: Scratch, label: str = "groups") -> DataFrame:
    """``(grp, root)`` of every ``grp`` in ``members(grp, anchor)``: root is the least group that is connected to it.

    Every anchor ties its groups to its least one. At each level every node takes the lowest of freshly drawn numbers
    within STEPS steps, nodes with one number contract, and the edges between them go on. Numbers are random, so a
    level leaves a fraction of the nodes whatever the shape, a chain in sorted order included. Levels are written to the
    shared folder and their edges counted as they are written; only these counts and hot nodes come to the driver.
    Tables of at most FEW_EDGES edges are broadcast; where there are more, nodes and anchors with very many rows are
    spread. A null anchor connects nothing."""
    one = F.count(F.lit(1))
    pairs = scratch.keep(members.where("grp is not null").select("grp", "anchor").distinct(), f"{label}-pairs")
    links = pairs.where("anchor is not null")
    hubs = links.groupBy("anchor").agg(F.min("grp").alias("hub"), one.alias("n")).where("n > 1")
    hubs, seen = scratch.keep_counted(hubs, f"{label}-hubs", highest=F.max("n"))
    tied = salted_lookup(links, hubs.select("anchor", "hub"), "anchor", heaviest(hubs, "anchor", highest=seen["highest"] or 0), F.xxhash64("grp")).where("grp <> hub")
    left, seen = scratch.keep_counted(tied.select(F.col("grp").alias("u"), F.col("hub").alias("v")).distinct(), f"{label}-edges0", edges=one)
    levels: list[tuple[DataFrame, bool]] = []
    while seen["edges"]:
        small = seen["edges"] <= FEW_EDGES
        # Every edge both ways, and both of its nodes to themselves: a step is one join and one aggregate.
        ends = "array(named_struct('u', u, 'v', v), named_struct('u', v, 'v', u), named_struct('u', u, 'v', u), named_struct('u', v, 'v', v))"
        near = left.select(F.explode(F.expr(ends)).alias("e")).select("e.u", "e.v")
        hot = [] if small else hot_keys(near, "u", 4 * seen["edges"])
        at_ends = lambda edges, table: edges.join(F.broadcast(table), "u") if small else salted_lookup(edges, table, "u", hot, F.xxhash64("v"))  # noqa: B023, E731
        reached = near.select(F.col("v").alias("u"), _draw(F.col("u"), len(levels)).alias("best"))
        state = reached.groupBy("u").agg(F.min("best").alias("best"))
        for _ in range(STEPS - 1):
            reached = at_ends(near, state).select(F.col("v").alias("u"), "best")
            state = reached.groupBy("u").agg(F.min("best").alias("best"))
        nodes = scratch.keep(state.select("u", F.col("best.c").alias("c")), f"{label}-level{len(levels)}")
        levels.append((nodes, small))
        for _ in range(2):
            left = at_ends(left, nodes).select(F.col("v").alias("u"), F.col("c").alias("v"))
        left = left.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        left, seen = scratch.keep_counted(left, f"{label}-edges{len(levels)}", edges=one)
    if not levels:
        return pairs.select("grp", F.col("grp").alias("root")).distinct()
    # Each level maps its nodes to those of the next; a node that the next level lacks is final.
    final = levels[-1][0].select("u", F.col("c").alias("end"))
    for at, (nodes, small) in enumerate(reversed(levels[:-1])):
        following = final.withColumnRenamed("u", "c")
        ends = nodes.join(F.broadcast(following), "c", "left") if small else salted_lookup(nodes, following, "c", hot_keys(nodes, "c"), F.xxhash64("u"), "left")
        final = ends.select("u", F.coalesce("end", "c").alias("end"))
        if not small:
            final = scratch.keep(final, f"{label}-final{at}")
    final = scratch.keep(final, f"{label}-final")
    least, seen = scratch.keep_counted(final.groupBy("end").agg(F.min("u").alias("root"), one.alias("n")), f"{label}-least", highest=F.max("n"))
    roots = salted_lookup(final, least.select("end", "root"), "end", heaviest(least, "end", highest=seen["highest"] or 0), F.xxhash64("u")).select(F.col("u").alias("grp"), "root")
    return pairs.select("grp").distinct().join(roots, "grp", "left").select("grp", F.coalesce("root", "grp").alias("root"))


def component_names(roots: DataFrame) -> DataFrame:
    """``(root, component, groups)`` of components of ``roots(grp, root)``.

    The name is the digest of the sorted groups as a JSON list, so it depends on the members alone. Above NAMED_BY_ALL
    groups it is the digest of the least group and their number, since one task would have to hold all of them."""
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("groups"))
    large = sizes.where(F.col("groups") > NAMED_BY_ALL)
    marked = roots.join(F.broadcast(large.select("root")), "root", "left_anti")  # at most groups / NAMED_BY_ALL rows
    named = marked.groupBy("root").agg(F.sort_array(F.collect_set("grp")).alias("all"), F.count(F.lit(1)).alias("groups"))
    by_all = named.select("root", F.concat(F.lit("component:"), X.digest(F.to_json("all"))).alias("component"), "groups")
    by_least = large.select("root", F.concat(F.lit("component:"), X.digest(X.json_list(F.lit("large"), F.col("root"), F.col("groups").cast("string")))).alias("component"), "groups")
    return by_all.unionByName(by_least)
