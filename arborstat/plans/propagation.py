"""Iterative graph plans: connected components and propagation from seeds.

State lives in tables between rounds (see :func:`arborstat.session.cut_lineage`), so
a lost executor costs one round, and tables that no later round reads are deleted.
Loops run until nothing changes; each round makes some value smaller, so they end. All
graphs of a batch (``keys``, e.g. scan_id) advance together. Messages are combined per
node by an aggregate with a map-side part, and only inner joins meet a node with its
edges, so that adaptive execution can split a node with very many of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from arborstat.session import cut_and_count, cut_lineage, release, spread


def both_ways(edges: DataFrame, keys: list[str], *extra: str) -> DataFrame:
    """Each undirected edge as two rows (src, dst)."""
    e = edges.select(*keys, "src", "dst", *extra)
    return e.unionByName(e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), *extra))


def connected_components(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, component): the smallest node id each node is connected to.

    Each round every component root with a smaller neighbour hooks to the smallest
    one, the hooks are followed to their ends, and the graph shrinks to its roots.
    Rounds grow with the logarithm of the graph, and later rounds see less and less
    of it; the nodes themselves are joined once, at the end.
    """
    big, small = F.greatest("src", "dst"), F.least("src", "dst")
    some = F.lit(True)
    arcs, left = cut_and_count(edges.where("src <> dst").select(*keys, big.alias("src"), small.alias("dst")).distinct(), some)
    rounds: list[DataFrame] = []
    tables: list[DataFrame] = []
    hooked = 0
    while left:
        followed = _follow(arcs.groupBy(*keys, "src").agg(F.min("dst").alias("to")), keys, left)
        tables.append(followed)
        hook = spread(followed, left)
        hooked += left
        rounds.append(hook)
        down = hook.select(*keys, F.col("src").alias("dst"), F.col("to").alias("to2"))
        moved = arcs.join(hook, [*keys, "src"]).join(down, [*keys, "dst"], "left").select(
            *keys, F.col("to").alias("a"), F.coalesce("to2", "dst").alias("b")
        ).where("a <> b")
        before = arcs
        arcs, left = cut_and_count(moved.select(*keys, F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct(), some)
        release(before)

    ends: DataFrame | None = None
    for hook in reversed(rounds):  # every node hooks in one round only
        if ends is None:
            ends = hook
        else:
            later = spread(ends.select(*keys, F.col("src").alias("to"), F.col("to").alias("end")), hooked)
            ends = hook.join(later, [*keys, "to"], "left").select(*keys, "src", F.coalesce("end", "to").alias("to")).unionByName(ends)
    every = nodes.select(*keys, "node").distinct()
    if ends is None:
        return every.withColumn("component", F.col("node"))
    root = spread(ends.select(*keys, F.col("src").alias("node"), "to"), hooked)
    out = cut_lineage(every.join(root, [*keys, "node"], "left").select(*keys, "node", F.coalesce("to", "node").alias("component")))
    release(arcs, *tables)
    return out


def _follow(hook: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Let every pointer ``src -> to`` (``rows`` at most) lead to the end of its chain; pointers only ever decrease."""
    last, moved = cut_lineage(hook), 1
    while moved:
        out = last
        for _ in range(2):  # each time, chains get half as long
            nxt = spread(out.select(*keys, F.col("src").alias("to"), F.col("to").alias("next")), rows)
            out = out.select(*keys, "src", "to").join(nxt, [*keys, "to"], "left").select(*keys, "src", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
        out, moved = cut_and_count(out, F.col("moved"))
        release(last)
        last = out
    ends = last.drop("moved")
    ends._cut_path = last._cut_path
    return ends


def propagate(
    seeds: DataFrame, arcs: DataFrame, keys: list[str], step: Callable[[Column], Column], hops_per_round: int = 8,
) -> DataFrame:
    """Smallest reachable value per node: (keys, node, best).

    ``seeds`` has keys, node and an orderable ``best`` (a number, which aggregates
    without a sort, or a struct); ``arcs`` has keys, src, dst and whatever ``step`` reads
    (besides ``node``, the source) to turn the source's ``best`` into the target's, which
    must not be smaller. Only the frontier sends: what a round improved in its last hop.
    Several hops run in one round over what they reach; then the values are compared with
    those known, and improvements alone are written, beside the earlier ones. An arc from
    each node to itself carries its own value along, so that inner joins do.
    """
    out = [c for c in arcs.columns if c not in keys]
    own = arcs.select(*keys, "src").distinct().withColumns({"dst": F.col("src"), "stays": F.lit(True)})
    table = cut_lineage(arcs.withColumn("stays", F.lit(False)).unionByName(own, allowMissingColumns=True))
    arcs = table.select(*[F.col(k).alias(f"__{k}") for k in keys], *out, "stays")
    on = F.col("node") == F.col("src")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    value = F.when(F.col("stays"), F.col("best")).otherwise(step(F.col("best")))
    rows = [*keys, F.col("dst").alias("node"), value.alias("best"), "stays"]
    lowest = F.min("best").alias("best")
    aggs = [lowest, F.min(F.when(F.col("stays"), F.col("best"))).alias("old")]
    fresh_now = (F.col("old").isNull() | (F.col("best") < F.col("old"))).alias("fresh")

    def together(tables: list[DataFrame]) -> DataFrame:
        every = tables[0].select(*keys, "node", "best")
        for more in tables[1:]:
            every = every.unionByName(more.select(*keys, "node", "best"))
        return every.groupBy(*keys, "node").agg(lowest)

    known = [cut_lineage(seeds.groupBy(*keys, "node").agg(lowest).withColumn("fresh", F.lit(True)))]
    fresh = 1
    while fresh:
        reached = known[-1].where("fresh")
        for _ in range(hops_per_round):
            sent = reached.join(arcs, on).where("stays or fresh").select(*rows)
            reached = sent.groupBy(*keys, "node").agg(*aggs).select(*keys, "node", "best", fresh_now)
        before = together(known).withColumnRenamed("best", "before")
        better = reached.join(before, [*keys, "node"], "left").where("before is null or best < before").drop("before")
        delta, fresh = cut_and_count(better, F.col("fresh"))
        known.append(delta)
        if len(known) > 8 and fresh:  # few tables to read: fold the earlier improvements
            folded = cut_lineage(together(known[:-1]))
            release(*known[:-1])
            known = [folded, delta]
    state = cut_lineage(together(known))
    release(table, *known)
    return state


def nearest_first(seeds: DataFrame, arcs: DataFrame, keys: list[str], width: float, hops_per_round: int = 4) -> DataFrame:
    """Shortest lengths (keys, node, best) from ``seeds`` (keys, node, best) along ``arcs`` (keys, src, dst, length of 0 or more), bucket by bucket.

    A bucket is as wide as ``width`` in distance. While nodes of the nearest open bucket
    are unsettled only they send, and along arcs no longer than the width; once none
    is left all the bucket's nodes send along their long arcs, once. Thus a
    node rarely sends a distance that is to be improved. Every graph of a batch has
    buckets of its own. Waiting nodes are a table between rounds.
    """
    width = max(width, 5e-324)
    table = cut_lineage(arcs.select(*keys, "src", "dst", "length"))
    short, long = table.where(F.col("length") <= width), table.where(F.col("length") > width)
    lowest = F.min("best").alias("best")

    def sent(frontier: DataFrame, along: DataFrame) -> DataFrame:
        met = frontier.select(*keys, F.col("node").alias("src"), "best").join(along, [*keys, "src"])
        return met.groupBy(*keys, F.col("dst").alias("node")).agg(F.min(F.col("best") + F.col("length")).alias("best"))

    def merged(known: DataFrame, offers: DataFrame, flag: str) -> DataFrame:
        """Known values with better offers taken in; what was improved waits."""
        both = known.join(offers.withColumnRenamed("best", "offer"), [*keys, "node"], "full_outer")
        better = F.col("offer").isNotNull() & (F.col("best").isNull() | (F.col("offer") < F.col("best")))
        return both.select(*keys, "node", F.when(better, F.col("offer")).otherwise(F.col("best")).alias("best"), (better | F.coalesce(flag, F.lit(False))).alias("waits"), (F.coalesce("open", F.lit(False)) & ~better).alias("open"))

    # waits: short arcs are to be sent along; open: sent, but the long arcs are not.
    first = seeds.groupBy(*keys, "node").agg(lowest).select("*", F.lit(True).alias("waits"), F.lit(False).alias("open"))
    state, left = cut_and_count(first, F.lit(True))
    while left:
        bucket = F.floor(F.col("best") / width)
        nearest = state.where("waits or open").groupBy(*keys).agg(F.min(bucket).alias("bucket"))
        now = state.join(nearest, keys, "left") if keys else state.join(nearest.withColumn("__one", F.lit(1)), F.lit(1) == F.col("__one"), "left").drop("__one")
        now = cut_lineage(now.select(*keys, "node", "best", "waits", "open", F.coalesce(bucket == F.col("bucket"), F.lit(False)).alias("now")))
        light = now.where("now and waits").limit(1).count() > 0
        before = state
        if light:
            flags = now.select(*keys, "node", "best", (F.col("waits") & ~F.col("now")).alias("waits"), (F.col("open") | (F.col("waits") & F.col("now"))).alias("open"))
            offers = sent(now.where("now and waits"), short)
            step = merged(flags, offers, "waits")
        else:
            flags = now.select(*keys, "node", "best", "waits", (F.col("open") & ~F.col("now")).alias("open"))
            step = merged(flags, sent(now.where("now and open"), long), "waits")
        state, left = cut_and_count(step, F.col("waits") | F.col("open"))
        release(before, now)
    out = cut_lineage(state.select(*keys, "node", "best"))
    release(table, state)
    return out
