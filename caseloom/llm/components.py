"""Connected components of pairs, two ways: low-diameter decomposition (problem 3) and alternating stars (problem 5).

Both take edges ``(u, v)`` of longs and give ``(node, component)`` for every node of an edge, component being the
smallest node. Self loops and repeated edges do no harm; null ends are left out; no edges give no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..plans.shared import Scratch, heaviest, hot_keys, hot_rows, salted_lookup

#: Rate of the exponential shifts: a level leaves about this share of the edges between clusters, and a cluster reaches
#: about ln(nodes) / RATE steps from its centre at most.
RATE = 0.2
#: Growth of a level ends when nodes that still change have at most this share of its edges: in any size and shape after
#: about ln(1 / STILL) / RATE steps. It adds at most this share to the edges that the level leaves.
STILL = 0.01
#: Rows of a frontier, its edges counted, that are broadcast rather than shuffled: at most 24 bytes each.
SMALL = 100_000
#: A table of nodes up to so many times SMALL is written anew in every step.
REWRITTEN = 10
#: Tables of changes that are read side by side before they are merged.
MERGED = 12


def _one() -> Column:
    return F.count(F.lit(1))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _shift(node: Column, seed: int) -> Column:
    """An exponential variate of rate RATE that depends on the node and the seed alone."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), node), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / RATE


def _at_ends(edges: DataFrame, table: DataFrame, hot: list[Row]) -> DataFrame:
    """Edges joined on ``u`` with a table of one row per node ``u``; hot nodes are spread."""
    return salted_lookup(edges, table, "u", hot, F.xxhash64("v"))


def _grown(edges: DataFrame, scratch: Scratch, label: str, seed: int) -> tuple[DataFrame, int, list[Row]]:
    """Clusters ``(u, c)`` of all nodes of ``edges``, the number of nodes, and the hot nodes.

    Every node starts a cluster of its own after a waiting time, the largest exponential shift less its own, and
    clusters grow along edges one unit a step; a node belongs to the cluster that reaches it first (ties: the smaller
    centre). Growth goes on until nodes with at most STILL of the edges change. Only nodes that changed in the last step,
    the frontier, are joined with the edges. A frontier of few edges, by count, is broadcast with what it reaches, and
    the table of nodes isn't shuffled; if that is far larger, a step writes its changes only."""
    both = _both_ways(edges)
    best = F.struct((-_shift(F.col("u"), seed)).alias("t"), F.col("u").alias("c")).alias("best")
    start = both.groupBy("u").agg(_one().alias("n")).select("u", "n", best)
    state, seen = scratch.keep_counted(start, f"{label}-grown0", nodes=_one(), rows=F.sum("n"), highest=F.max("n"))
    nodes, enough, hot = seen["nodes"], STILL * (seen["rows"] or 0), heaviest(state, "u", highest=seen["highest"] or 0)
    frontier, tables, at = state, [state], 0
    while (seen["rows"] or 0) > enough:
        at += 1
        small = seen["rows"] <= SMALL
        from_here = both.join(F.broadcast(frontier.select("u", "best")), "u") if small else _at_ends(both, frontier.select("u", "best"), hot)
        reached = from_here.groupBy(F.col("v").alias("u")).agg(F.min(F.struct((F.col("best.t") + 1).alias("t"), F.col("best.c").alias("c"))).alias("reached"))
        if small and nodes > REWRITTEN * SMALL:
            met = reduce(DataFrame.unionByName, tables).join(F.broadcast(reached), "u")  # no more rows than the frontier has edges
            met = met.groupBy("u").agg(F.min("n").alias("n"), F.min("best").alias("best"), F.min("reached").alias("reached")).where("reached < best")
            frontier, seen = scratch.keep_counted(met.select("u", "n", F.col("reached").alias("best")), f"{label}-grown{at}", rows=F.sum("n"))
            tables.append(frontier)
            if len(tables) > MERGED:
                merged = reduce(DataFrame.unionByName, tables).groupBy("u").agg(F.min("n").alias("n"), F.min("best").alias("best"))
                tables = [scratch.keep(merged, f"{label}-merged{at}")]
            continue
        own = tables[0] if len(tables) == 1 else reduce(DataFrame.unionByName, tables).groupBy("u").agg(F.min("n").alias("n"), F.min("best").alias("best"))
        met = own.join(F.broadcast(reached) if small else reached, "u", "left")
        better = F.coalesce(F.col("reached") < F.col("best"), F.lit(False))
        merged = met.select("u", "n", F.when(better, F.col("reached")).otherwise(F.col("best")).alias("best"), better.alias("moved"))
        merged, seen = scratch.keep_counted(merged, f"{label}-grown{at}", rows=F.sum(F.when(F.col("moved"), F.col("n"))))
        tables, frontier = [merged.select("u", "n", "best")], merged.where("moved")
    clusters = reduce(DataFrame.unionByName, tables).groupBy("u").agg(F.min("best").alias("best")).select("u", F.col("best.c").alias("c"))
    clusters = scratch.keep(clusters, label)
    scratch.drop(*[f"{label}-{kind}{k}" for k in range(at + 1) for kind in ("grown", "merged")])
    return clusters, nodes, hot


def components_by_decomposition(edges: DataFrame, scratch: Scratch, label: str = "ldd", seed: int = 77) -> DataFrame:
    """Low-diameter decomposition, level by level.

    At each level clusters grow from exponentially shifted starts until the nodes have settled (:func:`_grown`), contract
    to super-vertices, edges between clusters are made distinct, and the rest is decomposed again with fresh shifts
    until no edge is left. About RATE of the edges outlive a level, whatever the shape. The assignments of the levels
    are then composed from the last to the first. Each level is written to the shared folder, nothing of it comes to
    the driver but counts and at most HOT_KEYS hot nodes."""
    left, seen = scratch.keep_counted(_clean(edges), f"{label}-edges0", edges=_one())
    level, assigned = 0, []
    while seen["edges"]:
        clusters, nodes, hot = _grown(left, scratch, f"{label}-level{level}", seed + level)
        assigned.append((clusters, nodes))
        one = _at_ends(left, clusters, hot).select(F.col("v").alias("u"), F.col("c").alias("v"))
        other = _at_ends(one, clusters, hot).select(F.col("v").alias("u"), F.col("c").alias("v"))
        following, seen = scratch.keep_counted(_clean(other), f"{label}-edges{level + 1}", edges=_one())
        scratch.drop(f"{label}-edges{level}")
        left, level = following, level + 1
    if not assigned:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    # Level k maps its nodes to clusters; a cluster that has no node at level k + 1 is final.
    final = assigned[-1][0].select("u", F.col("c").alias("end"))
    for k in range(level - 2, -1, -1):
        step, nodes = assigned[k]
        ends = salted_lookup(step, final.withColumnRenamed("u", "c"), "c", hot_keys(step, "c", nodes), F.xxhash64("u"), "left")
        final = scratch.keep(ends.select("u", F.coalesce("end", "c").alias("end")), f"{label}-final{k}")
    smallest, seen = scratch.keep_counted(final.groupBy("end").agg(F.min("u").alias("component"), _one().alias("n")), f"{label}-smallest", highest=F.max("n"))
    hot = heaviest(smallest, "end", highest=seen["highest"] or 0)
    found = salted_lookup(final, smallest.select("end", "component"), "end", hot, F.xxhash64("u"))
    return scratch.keep(found.select(F.col("u").alias("node"), "component"), f"{label}-components")


def components_by_stars(edges: DataFrame, scratch: Scratch, label: str = "stars") -> DataFrame:
    """Alternating large-star and small-star until the edges stop changing; they are then stars around the smallest
    node of each component. A node with very many neighbours is spread over partitions in both steps: its neighbours
    are counted in the aggregate that finds the smallest of them, and the state of the edges is summed as they are
    written."""
    left, state = scratch.keep_counted(_clean(edges).select(F.col("v").alias("u"), F.col("u").alias("v")), f"{label}0", **_sums())  # u > v
    at = 0
    while True:
        # Large-star: every neighbour larger than u is tied to the smallest of u and its neighbours.
        both = _both_ways(left)
        least, hot = _least(both, state["edges"] * 2, scratch, f"{label}-least{at}")
        large = _at_ends(both.where("v > u"), least.select("u", F.least("u", "m").alias("m")), hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, f"{label}-large{at}")
        # Small-star: u and its smaller neighbours are tied to the smallest of them.
        least, hot = _least(large, state["edges"] * 2, scratch, f"{label}-lower{at}")  # a large-star has no more edges than it was given
        tied = _at_ends(large, least.select("u", "m"), hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small, found = scratch.keep_counted(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{label}{at + 1}", **_sums())
        scratch.drop(f"{label}{at}", f"{label}-large{at}", f"{label}-least{at}", f"{label}-lower{at}")
        left, at, before, state = small, at + 1, state, found
        if state == before:
            break
    stars = left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _sums() -> dict[str, Column]:
    """Number of edges and two checksums of them."""
    return {"edges": _one()} | {f"sum{k}": F.sum(F.pmod(F.xxhash64(F.lit(k), "u", "v"), F.lit(1 << 40))) for k in (1, 2)}


def _least(edges: DataFrame, rows: int, scratch: Scratch, label: str) -> tuple[DataFrame, list[Row]]:
    """The smallest neighbour ``m`` of each ``u``, and the hot nodes. It is written only where ``rows`` are enough for a
    hot node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), _one().alias("n"))
    if rows <= hot_rows():
        return least, []
    least, seen = scratch.keep_counted(least, label, highest=F.max("n"))
    return least, heaviest(least, "u", highest=seen["highest"] or 0)
