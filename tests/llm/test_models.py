"""Learnt operators: held-out accuracy, exact inference against enumeration, gradients against differences."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborstat.llm import language_crf as C, quality_mil as Q, topk_search as K, toxicity_kn as T
from arborstat.llm.common import held_out


def invented(seed, syllables, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(n)]


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    m = C.Model(["a", "b", "c"], np.zeros((2, 3)), np.zeros(0, np.uint64), np.zeros((1, 3)), rng.normal(size=(3, 3)).astype("f4"), rng.normal(size=3).astype("f4"))
    counts = np.array([4, 0, 1, 5])
    emitted = rng.normal(size=(10, 3)).astype("f4")
    got, at = m.marginals(emitted, counts), 0
    for n in counts:
        e, p = emitted[at : at + n], np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            s = sum(e[i, k] for i, k in enumerate(path)) + (m.first[path[0]] if n else 0) + sum(m.step[a, b] for a, b in zip(path, path[1:]))
            for i, k in enumerate(path):
                p[i, k] += np.exp(s)
        if n:
            assert np.allclose(got[at : at + n], p / p.sum(1, keepdims=True), atol=1e-4)
        at += n


def test_language_and_switching(spark, odd_docs, no_docs):
    a, b = invented(1, ["ba", "lo", "mi", "tu"], 150), invented(2, ["kra", "sch", "ung", "ö"], 150)
    m = C.fit([(t, "xx") for t in a[:100]] + [(t, "yy") for t in b[:100]])
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(t, "xx") for t in a[100:]] + [(t, "yy") for t in b[100:]])], "doc_id long, text string, lang string")
    rows = C.predict(df, m).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.98 and all(0 <= r.score <= 1 for r in rows)
    w = C.words_of([a[120] + " " + b[120]])
    labels = m.marginals(m.emissions(w), w.counts).argmax(1)
    split = len(a[120].split())
    assert (labels[:split] == 0).mean() > 0.9 and (labels[split:] == 1).mean() > 0.9
    odd = {(r.doc_id, r.text): r for r in C.predict(odd_docs, m, keep=["doc_id", "text"]).collect()}
    assert odd[0, None].lang_pred == "und" and odd[8, "12 34 !!"].lang_pred == "und" and odd[4, " \n\t "].score == 0
    empty = C.train(no_docs, ~held_out())
    assert C.predict(odd_docs, empty, keep=["doc_id"]).select("lang_pred").distinct().collect() == [("und",)]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = C.train(docs, ~held_out(), per_lang=40)
    rows = C.predict(docs, m).where(held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_attention_gradients():
    rng = np.random.default_rng(1)
    m = Q.Model()
    m.w["att"] = rng.normal(size=Q.GATE)
    counts, y = np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0])
    x = rng.random((8, Q.KINDS**2))

    def loss():
        p, _ = m.forward(x, counts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.5e-4 * sum((v**2).sum() for v in m.w.values())

    for k, g in m.gradients(x, counts, y).items():
        at = tuple(rng.integers(0, n) for n in m.w[k].shape)
        old = m.w[k][at]
        m.w[k][at] = old + 1e-5
        up = loss()
        m.w[k][at] = old - 1e-5
        down = loss()
        m.w[k][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_quality_held_out(spark, odd_docs, no_docs):
    good, bad = invented(3, ["ba", "lo", "mi", "tu"], 300), invented(4, ["ba", "lo", "mi", "tu"], 300)
    bad = [t.replace(" ", " $# ") if i % 2 else t.upper().replace(" ", "!! ") for i, t in enumerate(bad)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(600)] + [(None, 1), (5, None)], "doc_id long, quality int")
    m = Q.train(docs, labels, ~held_out())
    rows = Q.predict(docs, m).where(held_out()).collect()
    assert np.mean([r.predicted == int(r.doc_id < 300) for r in rows]) > 0.95
    assert Q.predict(odd_docs, m, keep=["doc_id"]).where("score between 0 and 1").count() == odd_docs.count()
    none = Q.train(no_docs, labels.where("false"), ~held_out())
    assert {r.score for r in Q.predict(odd_docs, none, keep=["doc_id"]).collect()} == {0.5}


def test_toxicity_held_out(spark, odd_docs, no_docs):
    rng = random.Random(9)
    texts = invented(5, ["ba", "lo", "mi", "tu", "ra"], 900)
    toxic = [i % 3 == 0 for i in range(900)]
    insults = [f"vile{c}" for c in "abcde"]
    texts = [t + " " + " ".join(rng.sample(insults, 3)) if bad else t for t, bad in zip(texts, toxic)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bad)) for i, bad in enumerate(toxic)] + [(None, 1), (1, None), (1, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.score(docs, labels, ~held_out()).collect()}
    out = [r.doc_id for r in docs.where(held_out()).collect()]
    assert np.mean([got[i].predicted == int(toxic[i]) for i in out]) > 0.97
    odd = T.score(odd_docs, labels, ~held_out()).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert T.score(no_docs, labels, ~held_out()).count() == 0
    assert {r.predicted for r in T.score(docs, labels.where("toxic = 0"), ~held_out()).collect()} == {0}


def test_word_counts_against_loops(spark):
    rows = [("a b a c", 0), ("a b", 1), ("c a b", 1)]
    got = T.count_words(spark.createDataFrame(rows, "text string, toxic long")).collect()
    number = {w: int(T.word_numbers([w])[0][0]) for w in "abc"}
    by = {r.word: (r.n0, r.n1, r.contexts) for r in got}
    assert by == {number["a"]: (1, 2, 3), number["b"]: (1, 2, 1), number["c"]: (1, 1, 2)}


def test_every_word_has_its_own_counts(spark):
    """More words than 2^20 buckets tell apart, and a word with more left neighbours than 2^12."""
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(5)) for i in range(120_000)]
    rows = [(" ".join(x for w in words[k::4] for x in (w, "hub")), k % 2) for k in range(4)]
    got = {r.word: r for r in T.count_words(spark.createDataFrame(rows, "text string, toxic long")).collect()}
    assert len(got) == 120_001 and got[int(T.word_numbers(["hub"])[0][0])].contexts == 120_000
    numbers = T.word_numbers([" ".join(words)])[0]
    assert all((got[int(x)].n0, got[int(x)].n1) == (1 - i % 4 % 2, i % 4 % 2) for i, x in enumerate(numbers))


def test_log_ratios_and_evidence_against_dictionaries(spark):
    """The counts, the pruning and the sums of the word model, worked out with dictionaries."""
    rng = random.Random(3)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    rows = [(" ".join(rng.choices(words, k=30) + ["vile"] * (i % 2 and rng.random() < 0.6) + ["kind"] * (i % 2 == 0 and rng.random() < 0.5)), i % 2) for i in range(200)]
    more = [(" ".join(rng.choices(words, k=20)), None) for _ in range(100)]
    n, n0, n1, left = Counter(), Counter(), Counter(), set()
    for text, toxic in rows + more:
        w = text.split()
        n.update(set(w))
        (n1 if toxic else n0 if toxic == 0 else Counter()).update(set(w))
        left |= set(zip(w, ["", *w]))
    contexts, total = Counter(w for w, _ in left), n.total()
    freed = sum(min(x, T.SHARED_DISCOUNT) for x in n.values())
    shared = {w: max(n[w] - T.SHARED_DISCOUNT, 0) / total + freed / total * (contexts[w] + 0.5) / (len(left) + 0.5 * len(n)) for w in n}
    own = [{w: max(c[w] - shared[w] * c.total() - T.DISCOUNT * math.sqrt(shared[w] * c.total() + 1), 0) / c.total() for w in n} for c in (n0, n1)]
    rest = [1 - sum(o.values()) for o in own]
    expected = {w: math.log(own[1][w] / rest[1] + shared[w]) - math.log(own[0][w] / rest[0] + shared[w]) for w in n if own[0][w] or own[1][w]}
    assert {"vile", "kind"} <= set(expected)

    learnt = spark.createDataFrame(rows, "text string, toxic long").repartition(3)
    every = spark.createDataFrame([(t,) for t, _ in rows + more], "text string").repartition(5)
    ratios = T.log_ratios(T.document_counts(learnt, every), every)
    got = {r.word: r.ratio / T.UNIT for r in ratios.collect()}
    number = {w: int(T.word_numbers([w])[0][0]) for w in n}
    assert set(got) == {number[w] for w in expected}
    assert all(abs(got[number[w]] - x) < 0.01 for w, x in expected.items())
    docs = spark.createDataFrame([(1, "vile vile words"), (2, "kind"), (3, None), (4, "nothing known")], "doc_id long, text string")
    found = {r.doc_id: (r["mean"], r["root"]) for r in T.evidence(docs, ratios, "text", ["doc_id"]).collect()}
    sums = {1: (2 * got[number["vile"]], 3), 2: (got[number["kind"]], 1), 3: (0, 1), 4: (0, 2)}
    assert all(found[i] == pytest.approx((s / k, s / math.sqrt(k))) for i, (s, k) in sums.items())


def test_the_divisor_of_left_neighbours_is_the_number_of_pairs(spark, monkeypatch):
    """Not an estimate of it: ratios as dictionaries give them, to the last digits but for the order of sums."""
    rng = random.Random(11)
    words = [f"w{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(3000)]
    rows = [(" ".join(x for _ in range(60) for x in (rng.choice(words), *["vile"] * (i % 2 and rng.random() < 0.05))), i % 2) for i in range(400)] + [("", 0), (None, None), ("alone", None)]
    n, n0, n1, left = Counter(), Counter(), Counter(), set()
    for text, toxic in rows:
        w = (text or "").split()
        n.update(set(w))
        (n1 if toxic else n0 if toxic == 0 else Counter()).update(set(w))
        left |= set(zip(w, ["", *w]))
    total, contexts = n.total(), Counter(w for w, _ in left)
    freed = sum(min(x, T.SHARED_DISCOUNT) for x in n.values())
    shared = {w: max(n[w] - T.SHARED_DISCOUNT, 0) / total + freed / total * (contexts[w] + 0.5) / (len(left) + 0.5 * len(n)) for w in n}
    own = [{w: max(c[w] - shared[w] * c.total() - T.DISCOUNT * math.sqrt(shared[w] * c.total() + 1), 0) / c.total() for w in n} for c in (n0, n1)]
    rest = [1 - sum(o.values()) for o in own]
    expected = {w: math.log(own[1][w] / rest[1] + shared[w]) - math.log(own[0][w] / rest[0] + shared[w]) for w in n if own[0][w] or own[1][w]}
    assert "vile" in expected

    every = spark.createDataFrame(rows, "text string, toxic long").repartition(3).withColumn("text", F.coalesce("text", F.lit("")))
    ratios = {r.word: r.ratio for r in T.log_ratios(T.document_counts(every.where("toxic is not null"), every), every).collect()}
    assert set(ratios) == {int(T.word_numbers([w])[0][0]) for w in expected}
    assert all(abs(ratios[int(T.word_numbers([w])[0][0])] - x * T.UNIT) < 2 for w, x in expected.items())
    for held, bits in ((1 << 22, 6), (100, 1), (1, 16)):
        monkeypatch.setattr(T, "HELD", held)
        monkeypatch.setattr(T, "GROUP", 5000)
        assert T.pair_count(every, bits) == len(left)
    assert T.pair_count(every.where("false")) == 0


def test_repeated_texts_and_ids_keep_their_rows(spark):
    docs = spark.createDataFrame([(i, ("vile " if i % 2 else "fine ") + "plain words here") for i in range(300)] + [(1, "fine plain words here")] * 3 + [(None, "vile plain words here"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 300)], "doc_id long, toxic int")
    rows = T.score(docs, labels, ~held_out()).collect()
    assert len(rows) == 305 and len({r.score for r in rows}) == 3
    assert sorted(r.predicted for r in rows if r.doc_id is None) == [0, 1]
    assert sorted(r.predicted for r in rows if r.doc_id == 1) == [0, 0, 0, 1]


def test_language_sample_has_a_bound(spark):
    """Rows without an id or with one id, equal texts and long texts: never more than asked for, and no language is lost."""
    long = "lang wort " * 30_000
    rows = [(None, f"text {i}", "en") for i in range(400)] + [(1, f"mot {i}", "fr") for i in range(400)] + [(2, "same", "en")] * 400 + [(3, long, "de")]
    got = C.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), 50, "doc_id", "text", "lang")
    sizes = {k: sum(la == k for _, la in got) for k in ("en", "fr", "de")}
    assert sizes == {"en": 50, "fr": 50, "de": 1} and max(len(t) for t, _ in got) == C.SAMPLE_CHARS


def brute_topk(rows, k, scale=1024):
    good = [(i, np.floor(scale * np.array(v, np.float64)).astype(int).tolist()) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v in {(i, tuple(v)) for i, v in good if i % 100 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, u)), j) for j, u in good if j != i)[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_topk_matches_all_pairs(spark, monkeypatch, scale):
    monkeypatch.setattr(K, "CANDIDATE_ROWS", 64)
    monkeypatch.setattr(K, "QUERY_ROWS", 4)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x * (scale if i % 7 == 0 else 1))) for x in v]) for i, v in enumerate(rng.normal(size=(700, 10)))]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2100, [1.0, None] + [0.0] * 8), (2200, [float("nan")] + [0.0] * 9), (None, [1.0] * 10), (2300, [float("inf")] * 10), (2400, [1.0, 2.0]), (2500, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in K.search(df, F.col("vec_id") % 100 == 0, 10).collect()}
    assert got == brute_topk(rows, 10)


def test_topk_with_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.rank, r.vec_id) for r in K.search(df, F.col("vec_id") == 0, 10).collect()} == {(0, 1, 1), (0, 2, 2)}
    assert K.search(df.where("false"), F.col("vec_id") == 0, 10).count() == 0


def test_topk_with_many_rows_of_the_query_id(spark):
    """Twelve rows share the query's id and are better than all others, which are still found."""
    rows = [(0, [1.0, 1.0, 1.0, 1.0], 0)] * 12 + [(i, [0.5, 0.1, i / 100, 0.2], 0) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.rank, r.vec_id) for r in K.search(df, F.col("vec_id") == 0, 10).collect())
    assert got == [(k, 30 - k) for k in range(1, 11)]


def test_blocks_give_the_messages_of_single_words():
    """Marginals and transitions of block-wise messages against the plain recursion in doubles, long sequences included."""
    rng = np.random.default_rng(5)
    for sizes in ([1, 2, 3, 0, 4, 5], [700, 33, 1, 650], [0], [4097]):
        counts, langs = np.array(sizes), 3
        step, first = rng.normal(0, 2, (langs, langs)), rng.normal(0, 1, langs)
        emitted = rng.normal(0, 3, (counts.sum(), langs))
        m = C.Model(list("abc"), np.zeros((2, langs), np.float32), np.zeros(0, np.uint64), np.zeros((1, langs), np.float32), step.astype(np.float32), first.astype(np.float32))
        got, moves = m.marginals(emitted.astype(np.float32), counts, pairs=True)
        want, sums, at = [], np.zeros((langs, langs)), 0
        for n in counts:
            e, at = np.exp(emitted[at : at + n]), at + n
            forth, back = np.zeros((n, langs)), np.ones((n, langs))
            for t in range(n):
                x = np.exp(first) if t == 0 else forth[t - 1] @ np.exp(step)
                forth[t] = x * e[t] / (x * e[t]).sum()
            for t in range(n - 2, -1, -1):
                y = np.exp(step) @ (e[t + 1] * back[t + 1])
                back[t] = y / y.sum()
            for t in range(n - 1):
                joint = forth[t][:, None] * np.exp(step) * e[t + 1] * back[t + 1]
                sums += joint / joint.sum()
            want.append(forth * back / (forth * back).sum(1, keepdims=True))
        assert np.allclose(got, np.concatenate(want), atol=1e-4) and np.allclose(moves, sums, rtol=1e-3, atol=1e-3)


def test_long_texts_go_piece_by_piece(monkeypatch):
    m = C.fit([("the quick fox jumps over it", "en"), ("der schnelle fuchs springt darüber", "de")])
    texts = ["the fox " * 300 + "der fuchs ist schnell\n" * 50, "", "kurz", "x" * 500]
    whole, n = m.emitted(texts)
    monkeypatch.setattr(C, "GROUP", 64)
    parts, k = m.emitted(texts)
    assert list(n) == list(k) and np.allclose(whole, parts, atol=1e-5)
    assert "".join(C.pieces(texts[0])) == texts[0] and max(map(len, C.pieces(texts[0]))) < 90


def test_lexicon_counts_all_learnable_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(C, "LEXICON", 2)
    rows = [("aa aa aa bb bb cc", "en"), ("bb bb dd", "en"), ("zz", "de"), (None, "de"), ("", "de"), ("qq qq", None)]
    got = C.frequent_words(spark.createDataFrame(rows, "text string, lang string"), F.lit(True))
    want = C.words_of(["aa bb zz"], grams=False).whole
    assert sorted(got.tolist()) == sorted(want.tolist())
    assert len(C.frequent_words(spark.createDataFrame([], "text string, lang string"), F.lit(True))) == 0
