"""Extra columns named like those of operators: values survive, or a ValueError names the column."""

import pytest

from arborstat.llm import bpe, language_crf, mixing, quality_mil, quality_rules, secrets, token_counts
from arborstat.llm.queries import tokenizer_path

EXTRA = slice(5, None)


def intact(rows, columns):
    return all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in columns[EXTRA])


@pytest.mark.parametrize("stage", range(4))
def test_pipeline_stages_carry_them(spark, clash_docs, stage):
    import corpus_pipeline as P

    out = P.STAGES[stage][1](spark, clash_docs, "")
    rows = out.collect()
    assert out.columns == clash_docs.columns and rows and intact(rows, out.columns)


def test_mix_carries_them_under_other_outputs(clash_docs):
    out = mixing.mix(clash_docs, max_repeats=1.5, outputs=("__epoch", "__order"))
    assert out.columns == [*clash_docs.columns, "__epoch", "__order"]
    assert intact(out.collect(), clash_docs.columns)


def test_predict_carries_them_under_other_outputs(clash_docs):
    model = language_crf.fit([("the quick fox", "en"), ("der schnelle fuchs", "de")])
    out = language_crf.predict(clash_docs, model, outputs=("__lang", "__score"))
    rows = out.collect()
    assert intact(rows, clash_docs.columns) and {r["__lang"] for r in rows} == {"en"}


@pytest.mark.parametrize(
    "call, name",
    [
        (lambda d: mixing.mix(d, max_repeats=1.5), "mix_order"),
        (lambda d: mixing.mix(d.withColumnRenamed("epoch", "EPOCH").drop("mix_order"), max_repeats=1.5), "epoch"),
        (lambda d: language_crf.predict(d, language_crf.fit([])), "lang_pred"),
        (lambda d: secrets.scan(d), "spans"),
        (lambda d: bpe.encode(d, tokenizer_path()), "ids"),
        (lambda d: token_counts.count_tokens(d, tokenizer_path()), "n_tokens"),
        (lambda d: quality_rules.measure(d), "kept"),
        (lambda d: quality_mil.predict(d, None), "score"),
    ],
)
def test_outputs_that_are_there_are_named(clash_docs, call, name):
    with pytest.raises(ValueError, match=name):
        call(clash_docs)
