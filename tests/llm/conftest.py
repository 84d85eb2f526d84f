import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with nulls everywhere, empty and long texts, repeated rows and columns named like outputs."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (None, "no id at all here", "en", None, 17), (2, "same words in this one text", "en", "a", 27),
        (3, "same words in this one text", "en", "b", 27), (3, "same words in this one text", "en", "b", 27), (4, " \n\t ", "en", "b", 4), (5, long, "en", "a", len(long)),
        (6, "ein kleiner satz für die ähnlichkeit", "de", "b", 36), (7, "漢字かな😀 <|endoftext|> x", None, "b", 20), (8, "12 34 !!", "en", "a", 8),
    ]
    df = spark.createDataFrame(rows, DOCS)
    extra = {c: "1" for c in ("spans", "score", "n_tokens", "ids", "epoch", "kept", "tokens", "block", "id", "n", "at", "low", "size", "words", "rank")}
    from pyspark.sql import functions as F

    return df.withColumns({f"x_{c}": F.lit(v) for c, v in extra.items()})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clash_docs(spark):
    """Documents with columns of the very names that operators use or add, each with a value of its own."""
    from pyspark.sql import functions as F

    rows = [(i, f"the quick brown fox number {i} runs over the lazy dog and on", "en" if i % 2 else "de", "ab"[i % 3 == 0], 60) for i in range(30)]
    names = ("times", "block", "blocks", "epoch", "epochs", "mix_order", "turn", "room", "cut", "score", "lang_pred", "spans", "ids", "n_tokens", "decoded", "kept", "n_words", "t", "l", "h", "word", "root", "same", "a", "b")
    return spark.createDataFrame(rows, DOCS).withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id")) for n in names})
