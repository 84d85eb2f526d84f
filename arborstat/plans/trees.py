"""Rooted trees out of undirected forests in rounds that grow with the logarithm of their size.

Every edge is two arcs, and the arc after u -> v is v -> w, w being v's neighbour after u in
cyclic order. On a tree this walks once around it, whatever node it starts from. Pointer
doubling finds each walk's smallest arc and the steps to it, so a walk gets a name and every
arc a place in it without a start being chosen before. Of an edge's two arcs the one that
comes first on a walk from the root leads away from it: that gives parents. Doubling along
parents then adds up whatever a path from the root carries.

An arc's number is its position in the global order of arcs, so a node with very many
neighbours is spread over tasks like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborstat.plans.selection import positions
from arborstat.session import cut_and_count, cut_lineage, release, spread


def walks(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, walk, place, length, tree) of every arc of a simple graph without loops (``edges``: keys, src, dst).

    ``walk`` names the walk, ``place`` counts along it from its smallest arc, and
    ``length`` is its number of arcs. ``tree`` says that the walk goes around a whole
    component and that this is a tree: it then has every edge both ways and a node more
    than edges. Components with cycles may have several walks.
    """
    both = edges.select(*keys, "src", "dst").unionByName(edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
    placed = positions(both, [*keys, "src", "dst"], "arc")
    ends = placed.groupBy(*keys, "src").agg(F.min("arc").alias("first"), F.max("arc").alias("last"))
    turned = placed.join(ends, [*keys, "src"]).withColumn("turn", F.when(F.col("arc") < F.col("last"), F.col("arc") + 1).otherwise(F.col("first")))
    # One row per edge knows both arcs: each goes on with the neighbour after the one it came from.
    pair = turned.groupBy(*keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        *[F.max(F.when(F.col("src") < F.col("dst"), F.col(c)) if up else F.when(F.col("src") > F.col("dst"), F.col(c))).alias(f"{c}{int(up)}") for c in ("arc", "turn") for up in (True, False)]
    )
    linked = pair.select(*keys, F.inline(F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("arc1").alias("arc"), F.col("turn0").alias("to")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("arc0").alias("arc"), F.col("turn1").alias("to")),
    )))
    arcs, n = cut_and_count(linked, F.lit(True))
    named = _around(arcs.select("arc", "to"), n)
    full = arcs.drop("to").join(spread(named, n), "arc")
    per_node = full.groupBy("walk", *keys, "src").agg(F.count("*").alias("n"))
    sizes = per_node.groupBy("walk").agg(F.sum("n").alias("length"), F.count("*").alias("nodes"))
    # A walk is closed if it has each of its edges both ways.
    edge = full.groupBy(*keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("walk").alias("walk"), F.max("walk").alias("other"))
    torn = edge.where("walk <> other").select(F.explode(F.array("walk", "other")).alias("walk")).distinct().withColumn("torn", F.lit(True))
    of = sizes.join(torn, "walk", "left").select("walk", "length", (F.col("torn").isNull() & (F.col("length") == 2 * (F.col("nodes") - 1))).alias("tree"))
    place = F.pmod(F.col("length") - F.col("steps"), F.col("length"))
    out = cut_lineage(full.join(of, "walk").select(*keys, "src", "dst", "walk", place.alias("place"), "length", "tree"))
    release(arcs, named)
    return out


def _around(arcs: DataFrame, rows: int) -> DataFrame:
    """(arc, walk, steps) from (arc, to), a permutation of ``rows`` arcs: the smallest arc on the way around and the steps to it."""
    # The reach is a column and no constant, so that every round runs the same compiled code.
    state, moved = arcs.select("arc", "to", F.col("arc").alias("walk"), F.lit(0).cast("bigint").alias("steps"), F.lit(1).cast("bigint").alias("reach")), 1
    while moved:
        out = state
        for _ in range(3):
            ahead = spread(out.select(F.col("arc").alias("to"), F.col("to").alias("to2"), F.col("walk").alias("walk2"), F.col("steps").alias("steps2")), rows)
            nearer = F.col("walk2") < F.col("walk")
            out = out.select("arc", "to", "walk", "steps", "reach").join(ahead, "to").select(
                "arc", F.col("to2").alias("to"), F.least("walk", "walk2").alias("walk"), F.when(nearer, F.col("steps2") + F.col("reach")).otherwise(F.col("steps")).alias("steps"),
                (F.col("reach") * 2).alias("reach"), nearer.alias("moved"),
            )
        # No arc saw a smaller one in the last doubling: then each has seen all of its walk.
        before = state
        state, moved = cut_and_count(out, F.col("moved"))
        release(before)
    named = state.select("arc", "walk", "steps")
    named._cut_path = state._cut_path
    return named


def parents(arcs: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, parent) of all nodes but the roots; ``arcs`` as :func:`walks` gives them for trees, ``roots`` (keys, root) one node of each tree at most.

    Nodes of trees without a root are absent.
    """
    out_of_root = arcs.join(spread(roots.select(*keys, F.col("root").alias("src"))), [*keys, "src"])
    begins = out_of_root.groupBy("walk").agg(F.min("place").alias("begin"))  # any arc out of the root will do as the first
    ordered = arcs.join(spread(begins), "walk").withColumn("at", F.pmod(F.col("place") - F.col("begin"), F.col("length")))
    first = ordered.groupBy(*keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(F.struct("at", "src", "dst")).alias("first"))
    return first.select(*keys, F.col("first.dst").alias("node"), F.col("first.src").alias("parent"))


def climb(links: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """(keys, node, root, hops, carried) from links (keys, node, parent, carried): the sums of what the links carry from the root down.

    The jumps double, so rounds grow with the logarithm of the depth. Roots themselves are
    absent, as they have no link. Links have to be free of cycles; one would never end, so
    it raises an error once the jumps exceed the number of links.
    """
    state, left = cut_and_count(links.select(*keys, "node", F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("hops"), *carried), F.lit(True))
    names, limit, reach = ["hops", *carried], left, 1
    while left:
        if reach > 2 * limit:
            raise ValueError("links have a cycle")
        out = state
        for _ in range(3):
            above = spread(out.select(*keys, F.col("node").alias("root"), F.col("root").alias("higher"), *[F.col(c).alias(f"up_{c}") for c in names]), limit)
            met = F.col("higher").isNotNull()
            out = out.select(*keys, "node", "root", *names).join(above, [*keys, "root"], "left").select(
                *keys, "node", F.coalesce("higher", "root").alias("root"), *[F.when(met, F.col(c) + F.col(f"up_{c}")).otherwise(F.col(c)).alias(c) for c in names], met.alias("moved"),
            )
            reach *= 2
        before = state
        state, left = cut_and_count(out, F.col("moved"))
        release(before)
    return state.drop("moved") if "moved" in state.columns else state
