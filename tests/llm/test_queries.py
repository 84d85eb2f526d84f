"""Registered queries against their SQL, and the pipeline's contract, on the smallest tables."""

import pytest

import parity


@pytest.fixture(scope="module")
def con():
    return parity.duck("/root/testdata/sf0.001")


def names():
    from arborstat.llm import queries

    return sorted(queries.ORACLES)


@pytest.mark.parametrize("name", names())
def test_sql(spark, con, name):
    from arborstat.llm import queries

    message, n = parity.compare(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), con, queries.ORACLES[name])
    assert not message and n > 0


def test_pipeline(spark, odd_docs, no_docs):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = P.run(spark, sf).collect()
    assert rows and all(r.round_trip for r in rows)
    lost = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in rows}
    assert len(lost) < 0.25 * docs.count()  # copies
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, no_docs, sf).count() == 0
    kept = P.near_duplicates(spark, odd_docs, sf).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["0", "1", "2", "4", "5", "6", "7", "8", "None"]


def test_pipeline_stages_follow_their_operators(spark):
    """Redaction and rejection on planted rows."""
    import corpus_pipeline as P

    rows = [(1, "the password = abcdefghijklmnop here", "en", "a", 36), (2, "plain words only", "en", "a", 16), (3, None, "en", None, None), (4, "1 2 3", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clean = {r.doc_id: r for r in P.secret_scan(spark, docs, "").collect()}
    assert clean[1].text == "the [secret] here" and clean[1].n_chars == 17
    assert clean[2].text == "plain words only" and clean[3].text is None and len(clean) == 4
    assert {r.doc_id for r in P.language_id(spark, docs, "").collect()} <= {1, 2}


def test_near_duplicates_judge_rows_by_their_texts(spark):
    import corpus_pipeline as P

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(2, a, "en", "s", 1), (5, a + " end", "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "s", 1), (5, "zz only here", "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "t", 1), (None, b, "en", "s", 1), (None, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, docs, "").collect()), key=str)
    assert kept == sorted([(2, a), (5, b), (5, "zz only here"), (None, c), (None, None)], key=str)
