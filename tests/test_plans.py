"""Scale plans against brute force, on data where one key holds a third of the rows."""

import math
import random
import time
from collections import defaultdict, deque
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborstat import session
from arborstat.operators import components as C, graphs as G, longitudinal as L, profiling as P, voxels as V
from arborstat.plans import ordered, proximity, selection
from arborstat.plans.propagation import both_ways, connected_components, propagate


def skewed(n=600, seed=1):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 25, n))
    v = np.round(rng.lognormal(0, 2, n), 1)  # heavy tail with ties
    v[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"k": key, "row": np.arange(n), "v": v})


@pytest.fixture(scope="module")
def frame(spark):
    pdf = skewed()
    return pdf, spark.createDataFrame(pdf)


@pytest.fixture(params=[False, True])
def counting(request, monkeypatch):
    """Groups as they are, and with a bound so small that most are counted in passes."""
    if request.param:
        monkeypatch.setattr(selection, "WHOLE", 12)
        monkeypatch.setattr(selection, "BUCKETS", 8)


def test_percentiles(frame, counting):
    pdf, df = frame
    probs = {"p10": ("v", 0.1), "p50": ("v", 0.5), "p95": ("v", 0.95), "row50": ("row", 0.5)}
    got = {r["k"]: r for r in selection.grouped(df, ["k"], [F.count("*").alias("n")], probs).collect()}
    for k, g in pdf.groupby("k"):
        assert got[k]["n"] == len(g)
        for name, (c, p) in probs.items():
            assert got[k][name] == pytest.approx(np.nanpercentile(g[c], p * 100), abs=1e-9)


def test_null_keys_an_outlier_and_a_hot_key(spark, counting):
    """NULL is a group, one huge value changes nothing else, and nine tenths of the rows may have one key."""
    rows = [(None, float(i)) for i in range(5)] + [(1, float(i % 10)) for i in range(900)] + [(1, 1e12)] + [(2, None), (2, 3.0), (3, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r["k"]: (r["n"], r["m"]) for r in selection.grouped(df, ["k"], [F.count("*").alias("n")], {"m": ("v", 0.5)}).collect()}
    assert got == {None: (5, 2.0), 1: (901, 5.0), 2: (2, 3.0), 3: (1, None)}


def test_select_ranks(frame, counting):
    pdf, df = frame
    r = selection.select_ranks(df, [], "v", {"a": lambda n: F.floor(n / 3), "out": lambda n: n}).first()
    v = np.sort(pdf.v.dropna().to_numpy())
    assert (r["n"], r["a"], r["out"]) == (len(v), v[len(v) // 3], None)


def test_ranks_of_whole_numbers_and_infinities(spark, counting):
    """Integers keep their type; infinite ends do not stop the narrowing."""
    rows = [(k, v) for k in (1, None) for v in [*range(40), *[7] * 30, 2**62, -(2**62)]]
    got = selection.select_ranks(spark.createDataFrame(rows, "k int, v long"), ["k"], "v", {"a": lambda n: n - 1, "b": lambda n: n - 2, "c": lambda n: F.lit(0), "d": lambda n: F.lit(20)})
    assert {(r.k, r.n, r.a, r.b, r.c, r.d) for r in got.collect()} == {(k, 72, 2**62, 39, -(2**62), 7) for k in (1, None)}
    wide = [(float("inf"),)] * 3 + [(float("-inf"),)] * 3 + [(float(i) ** 9,) for i in range(60)]
    got = selection.select_ranks(spark.createDataFrame(wide, "v double"), [], "v", {"a": lambda n: F.lit(2), "b": lambda n: F.lit(13), "c": lambda n: n - 4, "d": lambda n: n - 3})
    assert tuple(got.first()) == (66, float("-inf"), 10.0**9, 59.0**9, float("inf"))


def test_rank_quartile(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 6, 101):
        v = np.where(rng.random(n) < 0.4, 5.0, np.round(rng.normal(size=n), 1))  # two fifths tied
        pdf = pd.DataFrame({"v": v, "row": rng.permutation(n)})
        got = ordered.rank_quartile(spark.createDataFrame(pdf), "v", "row").toPandas().sort_values(["v", "row"])
        want = [max(1, -(-4 * i // max(n - 1, 1))) for i in range(n)]
        assert got.quartile.tolist() == want
        if n >= 6:
            assert got.quartile.tolist() == (pd.qcut(np.arange(1, n + 1), 4, labels=False) + 1).tolist()


def test_positions(frame):
    pdf, df = frame
    got = selection.positions(df.where("v is not null and not isnan(v)"), ["k", "v", "row"]).toPandas().sort_values("position")
    want = pdf.dropna().sort_values(["k", "v", "row"])
    assert got.position.tolist() == list(range(len(want)))
    assert got.row.tolist() == want.row.tolist()


def test_previous_row(spark):
    rows = [(1, s, i) for i, s in enumerate([0, 5, 9000, 9001, 10**9])] + [(2, 7, 99)] + [(None, 3, 1), (None, 8, 2)]
    got = {(r["k"], r["seq"]): r["prev_v"] for r in ordered.with_previous(spark.createDataFrame(rows, "k int, seq long, v int"), ["k"], "seq", ["v"]).collect()}
    assert got == {(1, 0): None, (1, 5): 0, (1, 9000): 1, (1, 9001): 2, (1, 10**9): 3, (2, 7): None, (None, 3): None, (None, 8): 1}


def random_graph(seed, n=80, m=90):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n), round(rng.uniform(0.1, 5), 2)) for _ in range(m)]
    edges += [(0, rng.randrange(n), 1.0) for _ in range(m // 2)]  # node 0 holds a third of the edges
    edges += [(n + i, n + i + 1, 1.0) for i in range(40)]  # a long path
    return edges, list(range(n + 41))


def neighbours(edges):
    nb = defaultdict(set)
    for a, b, _ in edges:
        if a != b:
            nb[a].add(b), nb[b].add(a)
    return nb


def brute_components(edges, nodes):
    nb, out = neighbours(edges), {}
    for s in sorted(nodes):
        if s in out:
            continue
        todo = deque([s])
        out[s] = s
        while todo:
            for y in nb[todo.popleft()]:
                if y not in out:
                    out[y] = s
                    todo.append(y)
    return out


def frames(spark, edges, nodes):
    e = spark.createDataFrame([(1, i, a, b, w) for i, (a, b, w) in enumerate(edges)], "scan_id int, branch_id long, src long, dst long, length double")
    return e, spark.createDataFrame([(1, n) for n in nodes], "scan_id int, node long")


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_components(spark, seed):
    edges, nodes = random_graph(seed)
    e, n = frames(spark, edges, nodes)
    got = {r["node"]: r["component"] for r in connected_components(e, n, ["scan_id"]).collect()}
    assert got == brute_components(edges, nodes)


def test_components_without_edges(spark):
    e, n = frames(spark, [(1, 1, 1.0)], [1, 2])
    assert {(r["node"], r["component"]) for r in connected_components(e, n, ["scan_id"]).collect()} == {(1, 1), (2, 2)}


def test_shortest_paths_on_cycles(spark):
    import heapq

    edges, nodes = random_graph(3)
    e, _ = frames(spark, edges, nodes)
    root = spark.createDataFrame([(1, 0)], "scan_id int, root long")
    got = {r["node"]: r["distance"] for r in G.path_distances(e, root, ["scan_id"]).collect()}
    adj = defaultdict(list)
    for a, b, w in edges:
        adj[a].append((b, w)), adj[b].append((a, w))
    want, heap = {}, [(0.0, 0)]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in want:
            want[x] = d
            for y, w in adj[x]:
                heapq.heappush(heap, (d + w, y))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_generations_on_cycles(spark):
    edges, nodes = random_graph(4)
    e, n = frames(spark, edges, nodes)
    root = spark.createDataFrame([(1, 5)], "scan_id int, root long")
    got = {r["node"]: r["generation"] for r in G.assign_generations(e, n, ["scan_id"], root)[0].collect()}
    simple = {(min(a, b), max(a, b)) for a, b, _ in edges}
    nb = neighbours([(a, b, 1) for a, b in simple])
    deg = {x: len(nb[x]) + 2 * ((x, x) in simple) for x in nodes}
    comp = brute_components(edges, nodes)
    want = {}
    for c in set(comp.values()):
        members = [x for x in nodes if comp[x] == c]
        start = 5 if comp[5] == c else min(members, key=lambda x: (-deg[x], x))
        level, want[start] = {start: -1}, -1
        while level:
            nxt = {}
            for x in sorted(level):
                for y in nb[x]:
                    if y not in want:
                        nxt[y] = min(nxt.get(y, 10**9), level[x] + (deg[x] >= 3))
            want.update(nxt)
            level = nxt
    assert got == want


def test_propagate_respects_keys(spark):
    arcs = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (2, 3, 4)], "scan_id int, src long, dst long")
    seeds = spark.createDataFrame([(1, 1), (2, 1)], "scan_id int, node long").withColumn("best", F.struct(F.lit(0).alias("hop")))
    out = propagate(seeds, both_ways(arcs, ["scan_id"]), ["scan_id"], lambda b: F.struct((b["hop"] + 1).alias("hop")), hops_per_round=1)
    assert {(r["scan_id"], r["node"], r["best"]["hop"]) for r in out.collect()} == {(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 3, 1), (2, 4, 2)}


def cloud(seed, n, span):
    rng = np.random.default_rng(seed)
    return rng.integers(0, span, (n, 3))


def test_closest_pairs(spark):
    sp = (0.7, 0.8, 1.5)  # x, y, z
    mm = np.array([sp[2], sp[1], sp[0]])
    a, b, g = cloud(1, 60, 300), cloud(2, 80, 300), np.arange(60) % 7
    da = spark.createDataFrame([(1, int(k), *map(int, p)) for k, p in zip(g, a)], "scan_id int, component long, z int, y int, x int")
    db = spark.createDataFrame([(1, *map(int, p)) for p in b], "scan_id int, z int, y int, x int")
    got = {r["component"]: r for r in proximity.closest_pairs(da, db, ["scan_id"], "component", sp).collect()}
    for k in range(7):
        d = np.linalg.norm((a[g == k][:, None] - b[None]) * mm, axis=2)
        assert got[k]["distance"] == pytest.approx(d.min())
        pa, pb = np.array(got[k]["point_a"]), np.array(got[k]["point_b"])
        assert np.linalg.norm((pa - pb) * mm) == pytest.approx(d.min())


def test_linked_groups(spark):
    sp, p, g = (0.7, 0.8, 1.5), cloud(3, 90, 60), np.arange(90) % 12
    mm = np.array([sp[2], sp[1], sp[0]])
    df = spark.createDataFrame([(1, int(k), *map(int, x)) for k, x in zip(g, p)], "scan_id int, component long, z int, y int, x int")
    got = {(r["src"], r["dst"]) for r in proximity.linked_groups(df, ["scan_id"], "component", 6.0, sp).collect()}
    want = {(i, j) for i in range(12) for j in range(i + 1, 12) if np.linalg.norm((p[g == i][:, None] - p[g == j][None]) * mm, axis=2).min() <= 6.0}
    assert got == want and want


def test_within_radius(spark):
    p = np.unique(cloud(4, 120, 40), axis=0)
    df = spark.createDataFrame([(1, i, *map(int, x)) for i, x in enumerate(p)], "scan_id int, i int, z int, y int, x int")
    got = {(r["i"], r["o_i"]) for r in proximity.within_radius(df, df, ["scan_id"], 7).collect()}
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert got == {(int(i), int(j)) for i, j in zip(*np.where(d < 7))}


def grid(spark, seed, density, shape=(6, 7, 9)):
    mask = np.random.default_rng(seed).random(shape) < density
    rows = [(1, z, y, x, -800 + z, int(mask[z, y, x])) for z, y, x in product(*map(range, shape))]
    return mask, spark.createDataFrame(rows, "scan_id int, z int, y int, x int, hu int, label int")


def flood(mask, steps):
    out, todo = {}, sorted(map(tuple, np.argwhere(mask)))
    for s in todo:
        if s in out:
            continue
        out[s], queue = s, [s]
        while queue:
            z, y, x = queue.pop()
            for dz, dy, dx in steps:
                q = (z + dz, y + dy, x + dx)
                if all(0 <= c < m for c, m in zip(q, mask.shape)) and mask[q] and q not in out:
                    out[q] = s
                    queue.append(q)
    return out


@pytest.mark.parametrize("faces,density", [(False, 0.12), (True, 0.45)])
def test_voxel_components(spark, faces, density):
    mask, df = grid(spark, 5, density)
    steps = [s for s in product((-1, 0, 1), repeat=3) if any(s) and (not faces or sum(map(abs, s)) == 1)]
    got = {(r["z"], r["y"], r["x"]): r["component"] for r in C.voxel_components(df, faces).collect()}
    want = {k: (v[0] << 42) + (v[1] << 21) + v[2] for k, v in flood(mask, steps).items()}
    assert got == want


@pytest.mark.parametrize("density", [0.1, 0.6])
def test_neighbour_counts(spark, density):
    mask, df = grid(spark, 6, density)
    pad = np.pad(mask.astype(int), 1)
    total = sum(np.roll(pad, s, (0, 1, 2)) for s in product((-1, 0, 1), repeat=3) if any(s))[1:-1, 1:-1, 1:-1]
    got = {(r["z"], r["y"], r["x"]): (r["n_neighbours"], r["is_endpoint"]) for r in V.neighbour_counts(df).collect()}
    assert got == {tuple(map(int, p)): (int(total[tuple(p)]), bool(total[tuple(p)] == 1)) for p in np.argwhere(mask)}


def test_consensus_vote(spark):
    rows = [("a", 10, 10, 10, 2.0), ("b", 12, 10, 10, 1.0), ("c", 200, 10, 10, 2.5), ("d", 12, 10, 10, 0.5)]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "scan_id int, seq int, method string, z int, y int, x int, weight double")
    got = C.consensus(df).first()
    score = [w + sum(w2 * (1 - abs(z - z2) / 25) for j, (_, z2, *_, w2) in enumerate(rows) if i != j and abs(z - z2) < 25) for i, (_, z, *_, w) in enumerate(rows)]
    best = int(np.argmax(score))
    assert got["method"] == rows[best][0] and got["confidence"] == pytest.approx(min(5.0, score[best] / 4))


def test_moving_average_spike(spark):
    areas = [10, 10, 11, 10, 10, 10, 11, 10, 10, 10, 80, 90, 95, 99, 99, 99, 99, 99]
    df = spark.createDataFrame([("s", i, float(a)) for i, a in enumerate(areas)], "k string, z int, a double")
    got = L.moving_average_spike(df, "k", "z", "a").first()
    d = np.diff(np.convolve(areas, np.ones(5) / 5, mode="valid"))
    hit = np.argmax(d > np.abs(d).mean() + 2 * d.std())
    found = bool((d > np.abs(d).mean() + 2 * d.std()).any())
    assert (got["found"], got["index"]) == (found, min(hit + 5, len(areas) - 1) if found else len(areas) // 2)


def test_propagate_has_no_depth_limit_and_takes_a_hub(spark):
    """A path far deeper than one round, and a star whose hub has most arcs."""
    n = 60
    path = [(1, i, i + 1) for i in range(n)] + [(2, 0, i) for i in range(1, 500)]
    arcs = both_ways(spark.createDataFrame(path, "scan_id long, src long, dst long"), ["scan_id"])
    seeds = spark.createDataFrame([(1, 0, 0), (2, 7, 0)], "scan_id long, node long, best long")
    out = propagate(seeds, arcs, ["scan_id"], lambda b: b + 1, hops_per_round=4)
    got = {(r.scan_id, r.node): r.best for r in out.collect()}
    assert all(got[1, i] == i for i in range(n + 1))
    assert got[2, 7] == 0 and got[2, 0] == 1 and all(got[2, i] == 2 for i in range(1, 500) if i != 7)


def test_tables_that_are_no_longer_read_are_deleted(spark, tmp_path, monkeypatch):
    from arborstat import session

    monkeypatch.setattr(session, "checkpoint_root", lambda spark: str(tmp_path))
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(40)], "scan_id long, src long, dst long")
    nodes = spark.createDataFrame([(1, i) for i in range(41)], "scan_id long, node long")
    out = connected_components(edges, nodes, ["scan_id"])
    assert {r.component for r in out.collect()} == {0}
    assert len(list(tmp_path.iterdir())) == 1  # the result
    session.release(out)
    assert not list(tmp_path.iterdir())


def test_negative_lengths_are_refused(spark):
    from arborstat.operators.graphs import path_distances

    edges = spark.createDataFrame([(1, 0, 1, -2.0)], "scan_id long, src long, dst long, length double")
    with pytest.raises(ValueError):
        path_distances(edges, spark.createDataFrame([(1, 0)], "scan_id long, root long"), ["scan_id"])


def test_closest_pairs_of_a_narrow_and_a_far_spread_set(spark, monkeypatch):
    """What is written per level stays near the size of the sets, never their product."""
    made = []
    cut = proximity.cut_lineage
    monkeypatch.setattr(proximity, "cut_lineage", lambda df: made.append(cut(df)) or made[-1])
    monkeypatch.setattr(proximity, "release", lambda *tables: None)
    line = [(1, 7, 0, 0, 3 * x) for x in range(600)]
    a = spark.createDataFrame(line, "scan_id long, component long, z int, y int, x int")
    b = spark.createDataFrame([(1, 2, 0, 900), (1, 0, 1, 901)], "scan_id long, z int, y int, x int")
    r = proximity.closest_pairs(a, b, ["scan_id"], "component").first()
    assert r["distance"] == pytest.approx(2**0.5) and r["point_a"]["x"] == 900
    assert max(t.count() for t in made) <= 64


def test_alternating_lines_make_pairs_linear_in_their_runs(spark):
    from arborstat.operators.voxels import overlapping

    runs = spark.createDataFrame([(1, 0, 0, 2 * i, 2 * i) for i in range(2000)], "scan_id long, z int, y int, x0 int, x1 int")
    sent = runs.withColumnsRenamed({"x0": "a0", "x1": "a1"})
    assert overlapping(runs, sent, 1).count() == 2000
    wide = spark.createDataFrame([(1, 0, 0, -5, 5000)], "scan_id long, z int, y int, a0 int, a1 int")
    assert overlapping(runs, wide, 0).count() == 2000


def test_voxel_ids_refuse_positions_out_of_range(spark):
    with pytest.raises(Exception, match="2097151"):
        spark.range(1).select(C.voxel_id(F.lit(0), F.lit(1 << 21), F.lit(0))).collect()


def greedy(parts, max_mm, min_voxels, limit):
    """Largest first against a growing set, by plain loops: {rank: (distance, joined)}."""
    order = sorted(parts, key=lambda c: (-len(parts[c]), c))
    main, out = list(parts[order[0]]), {}
    for c in order[1 : limit + 1]:
        if len(parts[c]) >= min_voxels:
            d = min(math.dist(p, q) for p in parts[c] for q in main)
            out[c] = (round(d, 9), d <= max_mm)
            if d <= max_mm:
                main += parts[c]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_growing_reconnection_is_the_greedy_run(spark, seed):
    rng = random.Random(seed)
    scans = {0: {1: [(0, 0, x) for x in range(9)], 2: [(0, 0, x) for x in range(14, 17)], 3: [(0, 0, 11), (0, 0, 12)]}}  # 2 is met before 3, which would have linked it
    scans[1] = {1: [(0, 0, x) for x in range(9)], 2: [(0, 0, x) for x in range(11, 14)], 3: [(0, 0, 16), (0, 0, 17)]}  # 3 joins through 2
    for s in (2, 3, 4):
        scans[s] = {c: rng.sample([(z, y, x) for z in range(2) for y in range(3) for x in range(5 * c, 5 * c + 4)], rng.randint(1, 9)) for c in range(14)}
    rows = [(s, c, *p) for s, parts in scans.items() for c, ps in parts.items() for p in ps]
    comp = spark.createDataFrame(rows, "scan_id long, component long, z int, y int, x int").withColumn("hu", F.lit(0.0))
    got = C.grow_main(comp, C.component_stats(comp), 3.0, 2, 10).collect()
    want = {(s, c): v for s, parts in scans.items() for c, v in greedy(parts, 3.0, 2, 10).items()}
    assert {(r.scan_id, r.component): (round(r.distance, 9), r.reconnected) for r in got} == want
    assert not want[0, 2][1] and want[0, 3][1] and want[1, 3][1]
    alone = comp.where("component = 1")
    assert C.grow_main(alone, C.component_stats(alone), 3.0).count() == 0


def test_component_steps_broadcast_no_large_table(spark, monkeypatch):
    """Files of runs and links are small as their keys repeat; what decides is the number of rows."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    rows = [(s, z, y, x, 0, 1) for s in range(3) for z in range(4) for y in range(4) for x in range(4) if (x + y + z + s) % 3]
    voxels = spark.createDataFrame(rows, "scan_id long, z int, y int, x int, hu int, label int")
    comp = session.cut_lineage(C.voxel_components(voxels))
    stats = session.cut_lineage(C.component_stats(comp))
    plans = [C.voxel_components(voxels), C.keep_largest(comp, stats), C.remove_small(comp, stats, 2), C.fragmentation(stats), C.triage(comp, stats, 1.5, 2, 6), C.reconnect(comp, stats, 2.2, 2)]
    for df in plans:
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_votes_are_sent_to_few_cells(spark):
    """Every vote is written for the cells it reaches, and pairs are summed where they meet."""
    p = np.unique(cloud(5, 300, 90), axis=0)
    rows = [(1, i, "m", 1.0 + i % 3, *map(int, x)) for i, x in enumerate(p)]
    rows += [(1, 1000 + i, "n", 2.0, *map(int, x)) for i, x in enumerate(p[:20])]
    df = spark.createDataFrame(rows, "scan_id int, seq int, method string, weight double, z int, y int, x int")
    plan = C.consensus(df, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 5 and "array(-1, 0, 1)" not in plan and "[-1,0,1]" not in plan
    best = C.consensus(df, 7).first()
    pos, w, seq = np.array([r[4:] for r in rows]), np.array([r[3] for r in rows]), np.array([r[1] for r in rows])
    score = (w * np.clip(1 - np.linalg.norm(pos[:, None] - pos[None], axis=2) / 7, 0, None)).sum(1)
    i = min(range(len(rows)), key=lambda k: (-round(score[k], 9), seq[k]))
    assert (best["method"], best["z"], best["y"], best["x"]) == (rows[i][2], *rows[i][4:])
    assert best["confidence"] == pytest.approx(min(5.0, score[i] / len(rows)))


def test_graph_steps_broadcast_no_nodes(spark):
    """Degrees, roots and generations meet nodes by shuffles: their files are small, their rows are not."""
    nodes = spark.range(200).selectExpr("1 as scan_id", "id as node", "cast(id % 50 as int) as z", "cast(id % 7 as double) as diameter")
    edges = spark.range(1, 200).selectExpr("1 as scan_id", "id as branch_id", "cast(floor(id / 2) as long) as src", "id as dst")
    degree = G.degrees(edges, nodes, ["scan_id"])
    root = G.select_root(nodes, degree, ["scan_id"])
    for df in (degree, root, G.bifurcations(nodes, degree, degree.select("scan_id", "node"), ["scan_id"])):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    r = G.symmetry(edges, nodes, spark.createDataFrame([(1, 1)], "scan_id int, root long"), ["scan_id"]).first()
    # Node 1 has the neighbours 0, 2 and 3: 0 is alone on the left, the subtrees of 2 and 3 are on the right.
    assert (r["left_side_branch_count"], r["right_side_branch_count"]) == (1, 198)


def test_slice_uniformity(spark):
    """Against brute force: repeated positions, words of 64 that are skipped, negative positions, a scan with most rows; rows are neither dealt by range nor sorted before they are folded."""
    rng = random.Random(3)
    rows = [(0, z) for z in range(-700, 3000)] + [(k, rng.choice([-130, -64, -1, 0, 63, 64, 65, 127, 128, 4000, -(2**31), 2**31 - 1][: 11 + (k % 5 == 0)][k % 2 :])) for k in range(1, 40) for _ in range(rng.randint(1, 6))]
    rows = [(k, z) for k, z in rows if abs(z) < 2**31 - 1] + [(50, None), (51, None), (51, 4), (51, 9), (None, 3), (None, 5)]
    df = spark.createDataFrame(rows + rows[::3], "scan_id int, z int")
    want = {}
    for k in {k for k, _ in rows}:
        zs = sorted({z for key, z in rows if key == k and z is not None})
        gaps = [b - a for a, b in zip(zs, zs[1:])]
        m, s, x = (np.mean(gaps), np.std(gaps), max(gaps)) if gaps else (None, 0.0, 0)
        want[k] = (not (m is not None and (s / m > 0.10 or x > 2 * m or s > 1)), round(float(s), 6), x)
    out = P.slice_uniformity(df)
    assert out.schema["max_gap"].dataType.simpleString() == "int"
    assert {r["scan_id"]: (r["is_uniform"], round(r["spacing_std"], 6), r["max_gap"]) for r in out.collect()} == want
    assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_written_rounds_leave_no_shuffle_files(spark):
    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for f in store.getAllFiles().mkString(" ").split() if "shuffle_" in f}

    before, given = files(), spark.conf.get(session.SHUFFLE_CLEANUP)
    made = session.cut_lineage(spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 100).alias("k")).count())
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and made.count() == 100
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == given
