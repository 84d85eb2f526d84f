"""Threshold joins against all pairs, and what the bounds save."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborstat.llm import hard_negatives as H


def expected(rows, scale=256):
    data = []
    for vec, emb, label in rows:
        if vec is None or label is None or emb is None or any(x is None or not math.isfinite(x) for x in emb):
            continue
        data.append((vec, label, [math.floor(scale * x) for x in emb]))
    out, anchors = [], {(v, la, tuple(x)) for v, la, x in data if v % 100 == 0}
    for a, la, x in anchors:
        scored = sorted(((-sum(p * q for p, q in zip(x, y)), v, lb) for v, lb, y in data if v != a))
        for ps, p, _ in [s for s in scored if s[2] == la][:5]:
            window = [(-s, v) for s, v, lb in scored if lb != la and 80 * -ps <= 100 * -s <= 100 * -ps][:5]
            out += [(a, p, k, v, -ps, s) for k, (s, v) in enumerate(window, 1)]
    return sorted(out)


def found(df, **kw):
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % 100 == 0, **kw).collect())


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(H, "ROWS", 64)
    monkeypatch.setattr(H, "ANCHOR_ROWS", 4)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    rows = [(int(i * 10), [float(x) for x in centres[rng.integers(6)] + rng.normal(size=12) * 0.4], int(rng.integers(4)) if i % 3 else 0) for i in range(400)]
    rows += [(i, rows[3][1], 1 + i % 2) for i in range(5000, 5040)]  # ties
    rows += [(100, rows[5][1], 2), (100, rows[5][1], 2), (7, [1.0], 0), (8, [], 1), (9, None, 1), (11, [float("nan")] * 12, 1), (12, [None] * 12, 1), (13, rows[1][1], None), (None, rows[1][1], 1), (300, [0.0] * 12, 3)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("anchor", "window", "score", "rank", "row", "id", "v", "key", "salt")})
    got = found(df.repartition(3))
    assert got == expected(rows) and len(got) > 100


def test_hot_id_and_few_rows(spark):
    rows = [(0, [1.0, 0.5], 1)] * 12 + [(i, [1.0, 0.5 - i / 100], i % 2) for i in range(1, 20)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == sorted(set(expected(rows)))
    assert found(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], SCHEMA)) == []
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_large_numbers(spark):
    rows = [(i, [3e6 + i, -1e4 * i, 7.0], i % 2) for i in range(101)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == expected(rows)


@pytest.mark.parametrize("least", [-5, 0, 2000, 20000, 10**9])
def test_kernel(least):
    rng = np.random.default_rng(0)
    x, y = rng.integers(-90, 90, (7, 40)), rng.integers(-90, 90, (300, 40))
    y[:50, 10:] = 0
    i, j, s, _ = H.above(x, y, np.full(7, least))
    full = x @ y.T
    assert sorted(zip(i.tolist(), j.tolist(), s.astype(int).tolist())) == sorted((a, b, int(full[a, b])) for a, b in zip(*np.nonzero(full >= least)))


def test_bounds_save_products():
    """Unit vectors around centres: high thresholds leave a small part of the products to be computed."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 64)) * (0.9 ** np.arange(64))
    m = centres[rng.integers(10, size=2000)] + rng.normal(size=(2000, 64)) * 0.05
    m = np.floor(256 * m / np.linalg.norm(m, axis=1)[:, None]).astype(np.int64)
    full = 20 * 2000 * 64
    assert H.above(m[:20], m, np.full(20, 58000))[3] < 0.4 * full
    assert H.above(m[:20], m, np.full(20, 70000))[3] == 0
