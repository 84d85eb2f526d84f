"""Mixing budgets, and rule measures against loops."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from arborstat.llm import mixing as M, quality_rules as R


def corpus(spark, sizes):
    rows = [(i, " ".join(["w"] * (3 + i % 5)), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def tokens(rows):
    total = Counter()
    for r in rows:
        total[r.source] += len(r.text.split())
    return total


def test_repetition_limit_and_budget(spark):
    docs = corpus(spark, {"a": 600, "b": 60, "c": 20})
    natural = tokens(docs.collect())
    rows = M.mix(docs, max_repeats=2.5, block_tokens=100).collect()
    got, all_tokens = tokens(rows), sum(natural.values())
    repeats = {s: got[s] / natural[s] for s in natural}
    assert max(repeats.values()) <= 2.5 and repeats["c"] > 2.3 and repeats["a"] < 1
    assert all_tokens - 3 * 8 <= sum(got.values()) <= all_tokens
    copies = Counter(r.doc_id for r in rows)
    assert all(abs(copies[r.doc_id] - repeats[r.source]) < 1 for r in rows)  # whole passes, then part of one
    assert {(r.doc_id, r.epoch) for r in rows}.__len__() == len(rows)
    order = [r.source for r in sorted(rows, key=lambda r: r.mix_order)]
    assert abs(order[: len(order) // 2].count("a") / order.count("a") - 0.5) < 0.2


def test_entropy_target(spark):
    docs = corpus(spark, {"a": 800, "b": 100, "c": 100})
    got = tokens(M.mix(docs, entropy=0.9, budget=2000.0, block_tokens=50).collect())
    share = [v / sum(got.values()) for v in got.values()]
    assert abs(-sum(p * math.log(p) for p in share) / math.log(3) - 0.9) < 0.02


def test_cover_leaves_no_document_out(spark):
    docs = corpus(spark, {"a": 300, "b": 30, "c": 7})
    rows = M.mix(docs, max_repeats=3, budget="cover", block_tokens=64).collect()
    assert {r.doc_id for r in rows} == set(range(337))
    assert max(Counter(r.doc_id for r in rows).values()) <= 3


@pytest.mark.parametrize("kind", [{"entropy": 2.0}, {"max_repeats": 0.5}, {"max_repeats": 100}])
def test_targets_out_of_reach(spark, kind):
    assert M.mix(corpus(spark, {"a": 30, "b": 10}), **kind).count() > 0


def test_odd_rows(odd_docs, no_docs):
    rows = M.mix(odd_docs, max_repeats=1.5, budget="cover").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd_docs.collect()}
    assert M.mix(no_docs, entropy=0.9).count() == 0


def measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, odd_docs):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a ", "b ", "ab ", "é ", "\n", "x\n", "# ", "|", "\t", "\x0b", " ", "😀"]) for _ in range(rng.randint(0, 120)))) for i in range(600)]
    rows += [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = R.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        m = measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (r.kept and r.base_failed)


def test_order_never_changes_the_verdict(spark):
    rows = [("good plain words " * 30,), ("A! " * 60,), ("x # " * 60,), ("line\n" * 60,), ("12 " * 80,), ("- a\n- b\n- c",), ("lorem ipsum " * 20,), ("",)]
    df = spark.createDataFrame(rows, "text string")
    order = list(R.RULES)
    first = [r.v for r in df.select(R.cascade(order, R.Measures.of(F.col("text"))).alias("v")).collect()]
    assert first == [r.v for r in df.select(R.cascade(order[::-1], R.Measures.of(F.col("text"))).alias("v")).collect()]
    assert first[0] and not any(first[1:5]) and not first[6]


def test_estimates_order_by_rejection_per_cost(spark):
    df = spark.createDataFrame([("a # " * 50,)] * 50 + [("plain words " * 50,)] * 50, "text string")
    found = R.estimate(df, R.RULES, rows=1000)
    assert [x[2] / x[1] for x in found] == sorted((x[2] / x[1] for x in found), reverse=True)
    assert {r.name: s for r, _, s in found}["symbols"] == 0.5
    assert R.measure(df.where(F.lit(False))).count() == 0


def test_query_and_pipeline_keep_the_order_of_the_mix(spark):
    import hashlib

    import corpus_pipeline as P
    from arborstat.llm import queries
    from arborstat.session import cut_lineage

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    place = lambda r: (r.mix_order, int(hashlib.md5(f"{r.doc_id}:1:in".encode()).hexdigest()[:15], 16))
    mixed = sorted(M.mix(docs, max_repeats=1.25).collect(), key=place)
    assert [(r.doc_id, r.epoch) for r in queries.QUERIES["op1_temperature_mix"](spark, sf).collect()] == [(r.doc_id, r.epoch) for r in mixed]
    cover = [r.doc_id for r in sorted(M.mix(docs, max_repeats=P.MOST_REPEATS, budget="cover").collect(), key=place)]
    table = cut_lineage(P.source_mix(spark, docs, sf))
    assert [r.doc_id for r in P.encode(spark, table, sf).select("doc_id").collect()] == cover
