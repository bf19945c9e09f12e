"""Components, cycles and reach in directed graphs of any depth: chains and trees are contracted before anything goes edge by edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Squared relations are followed only while they have at most so many times the rows of the first one.
GROWTH = 4


def followed(pointers: DataFrame) -> DataFrame:
    """(kind, node, last, ring) of pointers(kind, node, to), one for each kind and node: the end that the pointers lead to.

    Steps double in each round, so there are as many rounds as the longest way has binary digits, or the number of
    pointers where some lead into a ring. Those have ring set, and the ring's smallest node as their end.
    """
    now = cut(pointers.select("kind", "node", "to", F.col("to").alias("low"), F.lit(True).alias("open")))
    for _ in range(now.count().bit_length() + 1):
        further = now.select("kind", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        now = cut(now.join(further, ["kind", "to"], "left").select("kind", "node", F.coalesce("_to", "to").alias("to"), F.least("low", "_low").alias("low"), F.col("_to").isNotNull().alias("open")))
        if not now.where("open").take(1):
            return now.select("kind", "node", F.col("to").alias("last"), F.lit(False).alias("ring"))
    # what is open now points into its ring, and a ring's nodes have seen all of it
    of_ring = now.where("open").select("kind", F.col("node").alias("to"), F.col("low").alias("_low"))
    return now.join(of_ring, ["kind", "to"], "left").select("kind", "node", F.coalesce("_low", "to").alias("last"), F.col("open").alias("ring"))


def without_chains(left: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """Edges (src, dst) with neither dead ends nor nodes of one edge in and one out; what went, as (node, first, last) by round, and (node, component) of rings.

    A chain of such nodes becomes an edge from the node before it to the node after it.
    """
    gone, rings = [], None
    while True:
        before = left.count()
        for _ in range(2):  # two layers of dead ends at a time
            left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
            left = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        left = cut(left)
        into = left.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("to")).where("n = 1").select("node", "to")
        out = left.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("to")).where("n = 1").select("node", "to")
        both = into.join(out.select("node"), "node", "left_semi").withColumn("kind", F.lit("in")).unionByName(out.join(into.select("node"), "node", "left_semi").withColumn("kind", F.lit("out")))
        chain = cut(both)
        if not chain.take(1):
            if left.count() == before:
                return left, gone, rings
            continue
        ends = cut(followed(chain).groupBy("node").agg(F.max(F.when(F.col("kind") == "in", F.col("last"))).alias("first"), F.max(F.when(F.col("kind") == "out", F.col("last"))).alias("last"), F.max("ring").alias("ring")))
        own = ends.where("ring").select("node", F.col("last").alias("component"))
        rings = own if rings is None else rings.unionByName(own)
        chains = ends.where("not ring").select("node", "first", "last")
        gone.append(chains)
        nodes = ends.select("node")
        rest = left.join(nodes.withColumnRenamed("node", "src"), "src", "left_anti").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        left = cut(rest.unionByName(chains.select(F.col("first").alias("src"), F.col("last").alias("dst"))).where("src <> dst").distinct())


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of edges(src, dst): the smallest or any other one node of all that reach each other.

    Dead ends go and chains are contracted first, in rounds that grow with the logarithm of a chain's length. In what is
    left each node takes the smallest node that reaches it as its colour; what reaches that node back within its colour
    is a component. Then the rest again. A contracted node is in the component of the nodes before and after its chain if
    those are in one.
    """
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    left, gone, found = edges.where("src <> dst"), [], None
    while True:
        left, more, rings = without_chains(left)
        gone += more
        found = rings if found is None else found if rings is None else found.unionByName(rings)
        if not left.take(1):
            break
        colour, changed = cut(left.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node"))), True
        while changed:
            incoming = left.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("new"))
            new = cut(colour.join(incoming, "node", "left").select("node", F.least("colour", "new").alias("colour"), (F.col("new") < F.col("colour")).alias("changed")))
            changed, colour = bool(new.where("changed").take(1)), new.select("node", "colour")
        of_src, of_dst = (colour.select(F.col("node").alias(x), F.col("colour").alias(f"_{x}")) for x in ("src", "dst"))
        back = left.join(of_src, "src").join(of_dst, "dst").where("_src = _dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        heads = colour.where("node = colour").select("node")
        members = cut(breadth_first(cut(heads), cut(back)).join(colour, "node").select("node", F.col("colour").alias("component")))
        found = members if found is None else found.unionByName(members)
        left = cut(left.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    found = cut(nodes.withColumn("component", F.col("node")) if found is None else nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    for chains in reversed(gone):
        of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))  # noqa: B023, E731
        inside = chains.join(of("first"), "first").join(of("last"), "last").where("_first = _last").select("node", F.col("_first").alias("new"))
        found = cut(found.join(inside, "node", "left").select("node", F.coalesce("new", "component").alias("component")))
    return found


def find_cycles(edges: DataFrame) -> DataFrame:
    """(node) that lie on a cycle of edges(src, dst), an edge from a node to itself included."""
    labels = strong_components(edges)
    several = labels.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return labels.join(several, "component", "left_semi").select("node").unionByName(edges.where("src = dst").select(F.col("src").alias("node"))).distinct()


def squared(jumps: DataFrame, most: int) -> DataFrame | None:
    """Two jumps (src, dst) at once; none if there are more than `most` such pairs, or no pair."""
    pairs = cut(jumps.join(jumps.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")).distinct())
    return pairs if 0 < pairs.count() <= most else None


def breadth_first(start: DataFrame, steps: DataFrame) -> DataFrame:
    """(node) of start and all that steps(src, dst) lead to; squared steps are followed too, as long as they are few."""
    jumps, seen, frontier = steps, start, start
    rounds, most = 0, None
    while True:
        fresh = cut(frontier.join(steps, frontier.node == steps.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if not fresh.take(1):
            return seen
        seen, frontier, rounds = seen.unionByName(fresh), fresh, rounds + 1
        if rounds % 4 == 0 and jumps is not None:
            most = steps.count() * GROWTH if most is None else most
            jumps = squared(jumps, most)
            if jumps is not None:
                seen = frontier = cut(seen)
                steps = steps.unionByName(jumps)


def reachable(seeds: DataFrame, edges: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node) reached from the seeds over edges(src, dst, external), and (node) targets that aren't known.

    A node with a single edge in is reached if the node at the other end is, so trees and chains are contracted into what
    they hang from, in rounds that grow with the logarithm of their depth; what nothing leads to goes. That is done again
    while it leaves fewer edges. The rest goes breadth first: each round joins the new nodes alone, and follows squared
    edges too, as long as they are few.
    """
    start = cut(seeds.select("node").where("node is not null").distinct())
    steps, hung = cut(edges.where("not external").select("src", "dst").where("src <> dst").distinct()), []
    while True:
        into = start.select(F.col("node").alias("src")).unionByName(steps.select(F.col("dst").alias("src"))).distinct()
        steps = cut(steps.join(into, "src", "left_semi").join(start.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        single = cut(steps.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("to")).where("n = 1").select(F.lit("in").alias("kind"), F.col("dst").alias("node"), "to"))
        if not single.take(1):
            break
        ends = cut(followed(single).select("node", "last", "ring"))
        hung.append(ends.where("not ring").select("node", "last"))
        rest = steps.join(ends.select(F.col("node").alias("dst")), "dst", "left_anti").join(ends.select(F.col("node").alias("src"), "last", "ring"), "src", "left")
        steps = cut(rest.where("ring is null or not ring").select(F.coalesce("last", "src").alias("src"), "dst").where("src <> dst").distinct())
    seen = breadth_first(start, steps)
    for trees in reversed(hung):
        seen = cut(seen.unionByName(trees.join(seen.select(F.col("node").alias("last")), "last", "left_semi").select("node")))
    return seen, seen.join(known.select("node"), "node", "left_anti")
