"""Walks, parents and sums on forests, and graphs with cycles beside them, against plain searches."""

import heapq
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from arborstat import session
from arborstat.operators import graphs as G
from arborstat.plans.propagation import nearest_first
from arborstat.plans import trees
from arborstat.plans.trees import climb, parents, walks

K = ["scan_id"]


def some_graphs(seed):
    """Edges (scan_id, branch_id, src, dst, length): trees of several shapes, components with cycles, loops and parallel edges."""
    rng = random.Random(seed)
    edges, branch = [], 0

    def add(scan, a, b):
        nonlocal branch
        edges.append((scan, branch, a, b, float(rng.randint(1, 40)) if branch % 9 else 0.0))
        branch += 1

    for scan in (1, 2):
        for i in range(1, 60):  # a chain
            add(scan, *rng.sample([i, i - 1], 2))
        for i in range(101, 180):  # a random tree
            add(scan, rng.randint(100, i - 1), i)
        for i in range(201, 260):  # a star
            add(scan, i, 200)
        for i in range(301, 340):  # with cycles
            add(scan, rng.randint(300, i - 1), i)
        for _ in range(12):
            add(scan, rng.randint(300, 339), rng.randint(300, 339))
        add(scan, 300, 301), add(scan, 301, 300), add(scan, 500, 500)
        for i in range(8):
            add(scan, 600 + i, 600 + (i + 1) % 8)
    return edges


def adjacency(edges):
    near = defaultdict(lambda: defaultdict(list))
    for scan, _, a, b, length in edges:
        near[scan, a], near[scan, b]
        if a != b:
            near[scan, a][b].append(length)
            near[scan, b][a].append(length)
    return near


@pytest.fixture(scope="module", params=[1])
def graph(spark, request):
    edges = some_graphs(request.param)
    df = spark.createDataFrame(edges, "scan_id int, branch_id long, src long, dst long, length double")
    names = sorted({(e[0], n) for e in edges for n in e[2:4]} | {(1, 700)})
    nodes = spark.createDataFrame([(s, n, float(n % 17), n % 5, 0, 0) for s, n in names], "scan_id int, node long, diameter double, z int, y int, x int")
    return edges, df, nodes


def test_walks_tell_trees(graph):
    edges, df, _ = graph
    g = G.simple_graph(df, K, []).where("src <> dst")
    rows = walks(g, K).collect()
    near = adjacency(edges)
    assert len(rows) == sum(len(v) for v in near.values())
    by = defaultdict(list)
    for r in rows:
        by[r.walk].append(r)
        assert r.tree == (r.src < 300)
    for some in by.values():
        places = {r.place: r for r in some}
        assert sorted(places) == list(range(len(some))) and {r.length for r in some} == {len(some)}
        assert all(places[p].dst == places[(p + 1) % len(some)].src for p in places)


def test_distances_against_a_heap(graph, spark):
    edges, df, _ = graph
    near = adjacency(edges)
    for start in (150, 310):
        want = {}
        for scan in (1, 2):
            heap = [(0.0, start)]
            while heap:
                d, v = heapq.heappop(heap)
                if (scan, v) not in want:
                    want[scan, v] = d
                    for w, lengths in near[scan, v].items():
                        heapq.heappush(heap, (d + min(lengths), w))
        root = spark.createDataFrame([(1, start), (2, start)], "scan_id int, root long")
        got = {(r.scan_id, r.node): r.distance for r in G.path_distances(df, root, K).collect()}
        assert got == want


def test_buckets_of_any_width(graph, spark):
    edges, df, _ = graph
    arcs = df.where("src <> dst").select("scan_id", "src", "dst", "length").unionByName(df.where("src <> dst").select("scan_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "length"))
    seeds = spark.createDataFrame([(1, 300, 0.0), (1, 600, 5.0), (2, 310, 0.0)], "scan_id int, node long, best double")
    some = [{(r.scan_id, r.node): r.best for r in nearest_first(seeds, arcs.where("src >= 300"), K, w).collect()} for w in (40.0, 1000.0)]
    assert some[0] == some[1] and len(some[0]) > 80


def test_generations_against_a_queue(graph):
    edges, df, nodes = graph
    near = adjacency(edges)
    degree = {k: sum(1 for _ in v) for k, v in near.items()} | {(1, 700): 0}
    loops = {(e[0], e[2]) for e in edges if e[2] == e[3]}
    degree = {k: d + 2 * (k in loops) for k, d in degree.items()}
    found, marked = G.assign_generations(df, nodes, K)
    got = {(r.scan_id, r.node): r.generation for r in found.collect()}
    main = {}
    for (scan, n), d in degree.items():
        order = (d >= 2, n % 17 if d >= 2 else -1, n % 5 if d >= 2 else -1, d, -n)
        main[scan] = max(main.get(scan, ((),)), (order, n))
    seen, want = set(), {}
    for scan, n in degree:
        if (scan, n) in seen:
            continue
        part, todo = {n}, [n]
        while todo:
            for w in near.get((scan, todo.pop()), ()):
                if w not in part:
                    part.add(w), todo.append(w)
        seen |= {(scan, v) for v in part}
        root = main[scan][1] if main[scan][1] in part else max(part, key=lambda v: (degree[scan, v], -v))
        want[scan, root], queue = -1, deque([root])
        hop = {root: 0}
        while queue:
            v = queue.popleft()
            for w in near.get((scan, v), ()):
                value = want[scan, v] + (degree[scan, v] >= 3)
                if w not in hop:
                    hop[w] = hop[v] + 1
                    want[scan, w] = value
                    queue.append(w)
                elif hop[w] == hop[v] + 1:
                    want[scan, w] = min(want[scan, w], value)
    assert got == want
    trees = [r for r in marked.collect() if r.src != r.dst and r.src < 300]
    assert all(r.generation == max(want[r.scan_id, r.src], want[r.scan_id, r.dst]) for r in trees) and len(trees) == 2 * (59 + 79 + 59)


def test_climbing_refuses_cycles(spark):
    links = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "scan_id int, node long, parent long")
    with pytest.raises(ValueError):
        climb(links, K, [])


def test_tree_steps_broadcast_no_large_table(graph, monkeypatch):
    """Tables of arcs and links have files of a few bits a row; what decides is the number of rows."""
    _, df, _ = graph
    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    plans, write = [], trees.cut_and_count

    def noted(df, cond):
        plans.append(df)
        return write(df, cond)

    monkeypatch.setattr(trees, "cut_and_count", noted)
    arcs = walks(G.simple_graph(df.where("src < 300"), K, []).where("src <> dst"), K)
    roots = arcs.groupBy(*K, "walk").agg(F.min("src").alias("root")).drop("walk")
    links = session.cut_lineage(parents(arcs, roots, K))
    climb(links, K, [])
    plans = [p._jdf.queryExecution().executedPlan().toString() for p in [*plans, parents(arcs, session.cut_lineage(roots), K)]]
    plans = [p for p in plans if "__offset" not in p]  # a row per shuffle partition is broadcast on request
    assert len(plans) > 3 and not any("BroadcastExchange" in p for p in plans)
