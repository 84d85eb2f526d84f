"""Components of similar documents against all pairs."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from arborstat.llm import jaccard_join as J
from arborstat.llm.common import BATCH_ROWS


def brute(rows, n=3, percent=90):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.fixture(scope="module")
def clusters():
    """Near copies at all distances around common bases, and a passage that many short documents share."""
    rng = random.Random(5)
    vocabulary, rows = [f"w{i}" for i in range(3000)], []
    for _ in range(5):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 60, 120]))]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w[rng.randint(0, 3) :] if rng.random() < 0.2 else w))
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 8))]) for _ in range(80)]
    rows += [None, "", "one", "One", "one two", "one two three", "ONE  two\tthree"]
    return list(enumerate(rows))


@pytest.mark.parametrize("short, n, percent", [(16, 3, 90), (2, 3, 90), (4, 5, 80)])
def test_components(spark, clusters, monkeypatch, short, n, percent):
    monkeypatch.setattr(J, "SHORT_LIST", short)
    df = spark.createDataFrame(clusters, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.components(df, n=n, percent=percent).collect()}
    assert got == brute(clusters, n, percent)


def test_odd_rows(odd_docs, no_docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.components(odd_docs).collect()), key=str)
    assert len(got) == odd_docs.count()
    assert (None, 3, None) in got and (0, 0, 0) in got and (4, 0, 4) in got
    assert got.count((3, 4, 2)) == 2
    assert J.components(no_docs).count() == 0


def test_one_id_on_two_texts(spark):
    x, y = [f"x{i}" for i in range(60)], [f"y{i}" for i in range(60)]
    rows = [(5, " ".join(x)), (2, " ".join(x + ["end"])), (5, " ".join(y)), (9, " ".join(y + ["end"])), (5, "something else altogether"), (5, " ".join(x))]
    for some in (rows, rows[::-1]):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.components(spark.createDataFrame(some, "doc_id long, text string")).collect())
        assert got == [(2, 59, 2), (5, 1, 5), (5, 58, 2), (5, 58, 2), (5, 58, 5), (9, 59, 5)]


def test_likely_keeps_texts_out_of_python(spark, monkeypatch):
    """No row whose key is asked for is lost, few others stay, and no text goes to Python and back for it."""
    given = spark.range(-3000, 3000).select(F.col("id").alias("a"), F.repeat(F.lit("x"), 50).alias("text")).unionByName(spark.sql("select cast(null as bigint) a, 'y' text"))
    ids = spark.range(-3000, 3000, 7).select(F.col("id").alias("a"))
    kept = J._likely(given, ids, "a")
    assert "InArrow" not in kept._jdf.queryExecution().executedPlan().toString()
    got = [r["a"] for r in kept.select("a").collect()]
    assert {r["a"] for r in ids.collect()} <= set(got) and len(got) < 870
    assert J._likely(given, ids.limit(0), "a").count() == 0
    monkeypatch.setattr(J, "FILTER_BITS", 1 << 16)  # two words of bits: first and last places are taken
    assert J._likely(given, ids, "a").join(ids, "a", "left_semi").count() == ids.count()


def test_texts_go_to_python_in_short_batches(spark, monkeypatch):
    """Every step that reads texts holds few of them at a time; the session's own setting is back afterwards."""
    rows = [(i, " ".join(f"w{i % 900}x{k}" for k in range(12))) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    seen = spark.sparkContext.accumulator(0)
    plain = J.in_groups

    def counted(batches, column, *args):
        for b in plain(batches, column, *args):
            seen.add(b.num_rows > 1000)
            yield b

    monkeypatch.setattr(J, "in_groups", counted)
    before = spark.conf.get(BATCH_ROWS)
    got = {r["doc_id"]: r["component_id"] for r in J.components(docs).collect()}
    assert got == {i: i % 900 for i in range(2500)}
    assert seen.value == 0 and spark.conf.get(BATCH_ROWS) == before


def test_lists_deal_prefix_members_once(spark, odd_docs, monkeypatch):
    """What one write holds on disk: members go to their lists and to the lists' sizes; prefixes of all rows are gone by then."""
    plans, write = [], J.cut_lineage

    def noted(df):
        if "pivot" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            kept.extend("prefix" in t.columns for t in made if "_cut_path" in t.__dict__)
        made.append(write(df))
        return made[-1]

    made, kept = [], []
    monkeypatch.setattr(J, "cut_lineage", noted)
    got = {(r.doc_id, r.n_shingles) for r in J.components(odd_docs).collect()}
    assert {(5, 977), (2, 4), (0, 0)} <= got
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") <= 2
    assert sum(kept) == 1  # those of the groups
