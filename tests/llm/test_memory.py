"""What the executors' Python workers hold: short batches, bounded memos, memory given back."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from arborstat.llm import bpe, common
from arborstat.llm.common import BATCH_ROWS, whole_text, with_columns

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture
def many(spark):
    text = F.concat(F.lit("words of text number "), F.col("id").cast("string"))
    return spark.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(30).cast("long").alias("n_chars"))


def test_language_stage_sends_short_batches(spark, many, monkeypatch):
    import corpus_pipeline as P

    def predict(docs, model, text, keep, outputs):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                n = b.num_rows
                yield with_columns(b, keep, {outputs[0]: pa.array(["en" if n <= 1000 else "und"] * n), outputs[1]: pa.array([1.0] * n)})

        given = docs.select(*keep, whole_text(text).alias("__text"))
        return given.mapInArrow(run, common.schema_of(docs, keep, f"`{outputs[0]}` string, `{outputs[1]}` double"))

    monkeypatch.setattr(P.language_crf, "predict", predict)
    before = spark.conf.get(BATCH_ROWS)
    known = P.language_id(spark, many, "")
    assert spark.conf.get(BATCH_ROWS) == before
    assert sorted(r.doc_id for r in known.collect()) == list(range(2500))


def test_few_remembered_words_give_the_same_ids(many):
    own, texts = bpe.ByteBpe(PATH), [r.text for r in many.collect()]
    own.kept_pieces = own.kept_words = 50
    few = [own.encode(texts[i : i + 100]) for i in range(0, 2500, 100)]
    assert len(own.inner) + len(own.words) < 1000
    assert sum(few, []) == bpe.ByteBpe(PATH).encode(texts)
    ids = {n: sorted((r.doc_id, r.ids) for r in bpe.encode(many, PATH, keep=["doc_id"], remembered=n).collect()) for n in (None, 50)}
    assert ids[None] == ids[50]


def test_memory_is_given_back(monkeypatch):
    freed, seen = [], []
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: freed.append(len(seen))})())
    run = common.gives_back(lambda batches: (2 * b for b in batches))
    for x in run(iter([1, 2, 3])):
        seen.append(x)
    assert seen == [2, 4, 6] and freed == [3]
