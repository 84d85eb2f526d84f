"""Trees and graphs: simple graph, degrees, root, generations, path distances, symmetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborstat.functions.numeric import dbl, ratio
from arborstat.plans.propagation import both_ways, connected_components, nearest_first, propagate
from arborstat.plans.trees import climb, parents, walks
from arborstat.session import cut_and_count, cut_lineage, spread


def simple_graph(edges: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """One row per unordered node pair; of parallel edges the highest branch_id wins. Self-loops stay."""
    e = edges.withColumns({"__a": F.least("src", "dst"), "__b": F.greatest("src", "dst")})
    g = e.groupBy(*keys, "__a", "__b").agg(F.max_by(F.struct("branch_id", *attributes), "branch_id").alias("e"))
    return g.select(*keys, F.col("__a").alias("src"), F.col("__b").alias("dst"), "e.*")


def degrees(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, degree); a self-loop counts twice, isolated nodes have degree 0."""
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node"))
    d = ends.groupBy(*keys, "node").agg(F.count("*").alias("degree"))
    return nodes.select(*keys, "node").join(spread(d), [*keys, "node"], "left").select(*keys, "node", F.coalesce("degree", F.lit(0)).alias("degree"))


def select_root(nodes: DataFrame, degree: DataFrame, keys: list[str]) -> DataFrame:
    """Root per graph: largest diameter among nodes of degree >= 2, ties to the larger z.

    Without such a node the one of the highest degree. Remaining ties go to the
    smaller node id. ``nodes`` has keys, node, diameter and z.
    """
    n = nodes.join(spread(degree), [*keys, "node"])
    branching = F.col("degree") >= 2
    order = F.struct(
        branching.alias("b"), F.when(branching, F.col("diameter")).alias("d"), F.when(branching, F.col("z")).alias("z"),
        F.col("degree").alias("g"), (-F.col("node")).alias("n"),
    )
    return n.groupBy(*keys).agg(F.max_by("node", order).alias("root"))


def nearest_node(nodes: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Node nearest to the one target point (tz, ty, tx) of each graph; ties to the smaller id."""
    n = nodes.join(targets, keys)
    d = sum(((F.col(c) - F.col(f"t{c}")) * (F.col(c) - F.col(f"t{c}")) for c in "yx"), (F.col("z") - F.col("tz")) * (F.col("z") - F.col("tz")))
    return n.groupBy(*keys).agg(F.min(F.struct(F.sqrt(dbl(d)).alias("distance"), "node")).alias("m")).select(*keys, "m.node", "m.distance")


def component_roots(components: DataFrame, degree: DataFrame, main: DataFrame, keys: list[str]) -> DataFrame:
    """Root of every component: the main root in its own, else the highest degree (smaller id on ties)."""
    c = components.join(spread(degree), [*keys, "node"])
    best = c.groupBy(*keys, "component").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("root"))
    main_of = components.join(main.withColumnRenamed("root", "node"), [*keys, "node"]).select(*keys, "component", F.col("node").alias("main_root"))
    return best.join(main_of, [*keys, "component"], "left").select(*keys, "component", F.coalesce("main_root", "root").alias("root"))


def _split_trees(g: DataFrame, nodes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The walks around the components that are trees (arcs), (keys, node) of the components with cycles, and (keys, node) of nodes without edges."""
    arcs = walks(g.where("src <> dst"), keys)
    ends = arcs.groupBy(*keys, F.col("src").alias("node")).agg(F.min("tree").alias("tree"))
    alone = nodes.select(*keys, "node").distinct().join(spread(ends), [*keys, "node"], "left_anti")
    return arcs, ends.where("not tree").select(*keys, "node"), alone


def assign_generations(edges: DataFrame, nodes: DataFrame, keys: list[str], root: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Generations by breadth-first order from each component's root.

    A root starts at -1; a child is one generation further if its parent has degree
    three or more. A node met from several parents in the same hop takes the smallest
    (generation, parent id). Returns (keys, node, generation) and the edges with the
    generation of tree edges, NULL on the others.

    Components that are trees get parents and generations by pointer doubling, in rounds
    that grow with the logarithm of their size; those with cycles are searched hop by hop.
    """
    g = cut_lineage(simple_graph(edges, keys, [c for c in edges.columns if c not in (*keys, "src", "dst", "branch_id")]))
    degree = cut_lineage(degrees(g, nodes, keys))
    if root is None:
        root = select_root(nodes, degree, keys)
    splits = degree.select(*keys, F.col("node").alias("parent"), (F.col("degree") >= 3).cast("long").alias("split"))
    arcs, cyclic, alone = _split_trees(g, nodes, keys)
    whole = arcs.where("tree")
    roots = cut_lineage(component_roots(whole.select(*keys, F.col("src").alias("node"), F.col("walk").alias("component")).distinct(), degree, root, keys))
    links = cut_lineage(parents(whole, roots, keys).join(spread(splits), [*keys, "parent"]))
    climbed = climb(links, keys, ["split"])
    lone = alone.unionByName(roots.select(*keys, F.col("root").alias("node"))).withColumn("generation", F.lit(-1))
    found = climbed.select(*keys, "node", (F.col("split") - 1).cast("int").alias("generation"))
    link = links.select(*keys, "node", "parent").join(spread(found), [*keys, "node"])
    cyclic, many = cut_and_count(cyclic, F.lit(True))
    if many:
        more, more_links = _searched_generations(g, cyclic, degree, root, splits, keys)
        found, link = found.unionByName(more), link.unionByName(more_links)
    ends = [F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst")]
    return found.unionByName(lone), g.join(spread(link.select(*keys, *ends, "generation")), [*keys, "src", "dst"], "left")


def _searched_generations(g: DataFrame, part: DataFrame, degree: DataFrame, root: DataFrame, splits: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, node, generation) and (keys, node, parent, generation) of the components that ``part`` (keys, node) holds, hop by hop."""
    own = g.join(part.withColumnRenamed("node", "src"), [*keys, "src"], "left_semi")
    roots = component_roots(connected_components(own, part, keys), degree, root, keys)
    # Hop and generation share one number, hop first, so that the smallest is the
    # smallest generation among the fewest hops and aggregates as a plain long.
    hop = 1 << 32
    seeds = roots.select(*keys, F.col("root").alias("node"), F.lit(0).cast("long").alias("best"))
    arcs = both_ways(own, keys).where("src <> dst").join(splits.withColumnRenamed("parent", "src"), [*keys, "src"])
    tree = propagate(seeds, arcs, keys, lambda best: best + F.lit(hop) + F.col("split"))
    generation = (F.col("best").bitwiseAND(F.lit(hop - 1)) - 1).cast("int").alias("generation")

    def at(end: str) -> DataFrame:
        return tree.select(*keys, F.col("node").alias(end), F.col("best").alias(f"best_{end}"))

    down = arcs.join(at("src"), [*keys, "src"]).join(at("dst"), [*keys, "dst"]).where(F.col("best_dst") == F.col("best_src") + F.lit(hop) + F.col("split"))
    link = down.groupBy(*keys, F.col("dst").alias("node")).agg(F.min("src").alias("parent"), F.max("best_dst").alias("best")).select(*keys, "node", "parent", generation)
    return tree.select(*keys, "node", generation), link


def path_distances(edges: DataFrame, root: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, distance): shortest length from the root; unreachable nodes are absent. Negative lengths are refused.

    Of parallel edges the shortest counts. A root whose component is a tree sends its
    lengths down by pointer doubling; with cycles the paths are found bucket by bucket.
    """
    if edges.where("length < 0").limit(1).count():
        raise ValueError("path_distances needs lengths of 0 or more")
    ends = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    g = cut_lineage(edges.where("src <> dst").select(*keys, *ends, dbl("length").alias("length")).groupBy(*keys, "src", "dst").agg(F.min("length").alias("length")))
    arcs, cyclic, _ = _split_trees(g, root.select(*keys, F.col("root").alias("node")), keys)
    links = parents(arcs.where("tree"), root, keys)
    both = [F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst")]
    sums = climb(links.select("*", *both).join(spread(g), [*keys, "src", "dst"]).select(*keys, "node", "parent", "length"), keys, ["length"])
    found = sums.select(*keys, "node", F.col("length").alias("distance")).unionByName(root.select(*keys, F.col("root").alias("node"), F.lit(0.0).alias("distance")))
    cyclic, many = cut_and_count(cyclic, F.lit(True))
    if not many:
        return found
    loops = root.join(cyclic.withColumnRenamed("node", "root"), [*keys, "root"], "left_semi")
    own = g.join(cyclic.withColumnRenamed("node", "src"), [*keys, "src"], "left_semi")
    seeds = loops.select(*keys, F.col("root").alias("node"), F.lit(0.0).alias("best"))
    width = own.agg(F.avg("length")).first()[0]
    more = nearest_first(seeds, both_ways(own, keys, "length"), keys, 4 * width).withColumnRenamed("best", "distance")
    return found.unionByName(more).groupBy(*keys, "node").agg(F.min("distance").alias("distance"))


def branch_distances(edges: DataFrame, distances: DataFrame, keys: list[str]) -> DataFrame:
    """Proximal and distal end of every branch with their distances.

    With one end unreachable the other plus the branch length stands in; equal
    distances make dst the proximal end.
    """
    def at(end: str) -> DataFrame:
        return distances.select(*keys, F.col("node").alias(end), F.col("distance").alias(f"d_{end}"))

    j = edges.join(at("src"), [*keys, "src"], "left").join(at("dst"), [*keys, "dst"], "left")
    s, d = F.col("d_src"), F.col("d_dst")
    src_first = F.when(s.isNotNull() & d.isNotNull(), s < d).when(s.isNotNull(), True).when(d.isNotNull(), False).otherwise(True)
    return j.select(
        *keys, "branch_id", F.when(src_first, F.col("src")).otherwise(F.col("dst")).alias("proximal_node"),
        F.when(src_first, F.col("dst")).otherwise(F.col("src")).alias("distal_node"),
        F.coalesce(F.least(s, d), s, d).alias("proximal_distance"),
        F.when(s.isNotNull() & d.isNotNull(), F.greatest(s, d)).otherwise(F.coalesce(s, d) + F.col("length")).alias("distal_distance"),
    )


def endpoint_summary(distances: DataFrame, degree: DataFrame, keys: list[str]) -> DataFrame:
    e = degree.where("degree = 1").join(distances, [*keys, "node"])
    return e.groupBy(*keys).agg(
        F.count("*").alias("n_endpoints"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"), F.avg("distance").alias("mean_distance")
    )


def bifurcations(nodes: DataFrame, degree: DataFrame, generations: DataFrame, keys: list[str]) -> DataFrame:
    return degree.where("degree >= 3").join(spread(nodes), [*keys, "node"]).join(spread(generations), [*keys, "node"], "left")


def symmetry(edges: DataFrame, nodes: DataFrame, root: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes reachable on either side of the root without crossing it, and min/max of the two.

    The root's neighbours are sorted by z (node id on ties); the first half is left.
    NULL with fewer than two neighbours or one common z. What a side reaches is the
    union of the components its neighbours belong to once the root is taken out.
    """
    from pyspark.sql import Window

    r = root.select(*keys, "root")

    def root_as(name: str) -> DataFrame:
        return r.select(*keys, F.col("root").alias(name))

    nb = both_ways(edges, keys).join(spread(root_as("src")), [*keys, "src"]).where("src <> dst").select(*keys, F.col("dst").alias("node")).distinct()
    nb = nb.join(spread(nodes.select(*keys, "node", "z")), [*keys, "node"])
    w = Window.partitionBy(*keys)  # the neighbours of one node per graph
    nb = nb.select(
        *keys, "node", F.row_number().over(w.orderBy("z", "node")).alias("i"), F.count("*").over(w).alias("n"),
        F.min("z").over(w).alias("lo"), F.max("z").over(w).alias("hi"),
    ).where("n >= 2 and lo < hi").withColumn("side", F.when(F.col("i") <= F.floor(F.col("n") / 2), "left").otherwise("right"))
    rest_edges = edges.join(root_as("src"), [*keys, "src"], "left_anti").join(root_as("dst"), [*keys, "dst"], "left_anti")
    rest_nodes = nodes.select(*keys, "node").join(root_as("node"), [*keys, "node"], "left_anti")
    comp = connected_components(rest_edges, rest_nodes, keys)
    sizes = comp.groupBy(*keys, "component").agg(F.count("*").alias("size"))
    reached = nb.join(spread(comp), [*keys, "node"]).select(*keys, "side", "component").distinct().join(spread(sizes), [*keys, "component"])
    s = reached.groupBy(*keys).agg(
        F.sum(F.when(F.col("side") == "left", F.col("size"))).alias("left_side_branch_count"),
        F.sum(F.when(F.col("side") == "right", F.col("size"))).alias("right_side_branch_count"),
    )
    l, g = F.col("left_side_branch_count"), F.col("right_side_branch_count")
    return r.join(s, keys, "left").withColumn("symmetry_index", ratio(F.least(l, g), F.greatest(l, g))).drop("root")


def prune_short_ends(edges: DataFrame, keys: list[str], min_length: float = 3.0, rounds: int = 3) -> DataFrame:
    """Drop branches shorter than ``min_length`` that end in a degree-1 node, up to ``rounds`` times."""
    for _ in range(rounds):
        nodes = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node"))
        ends = nodes.groupBy(*keys, "node").agg(F.count("*").alias("d")).where("d = 1").select(*keys, "node")
        e = edges.join(ends.select(*keys, F.col("node").alias("src"), F.lit(True).alias("es")), [*keys, "src"], "left")
        e = e.join(ends.select(*keys, F.col("node").alias("dst"), F.lit(True).alias("ed")), [*keys, "dst"], "left")
        drop = (F.col("es").isNotNull() | F.col("ed").isNotNull()) & (F.col("length") < min_length)
        edges = cut_lineage(e.where(~drop).drop("es", "ed"))
    return edges
