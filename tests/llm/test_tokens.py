"""BPE walk and token counts against the libraries that define them."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from arborstat.llm import bpe, token_counts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [
    "", "a", "  ", "hello  world", " x ", "\n\n a\t b", "don't we'll 's 're", " 's", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "a" * 1500,
    "é漢字かな😀 ½²", "\x1c \x1d a\x85 b", "<|endo ftext|>", " " * 300 + "x" + "=" * 200, "a b \r\n c",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    letters = "abcdefg hij \n\n't's 123 éü漢😀 !!?.  \t\r"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(800)] + ["".join(rng.choice("abehtio ") for _ in range(rng.randint(1, 60))) for _ in range(800)]


def test_walk_matches_library(library, texts):
    own = bpe.ByteBpe(PATH)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == expected
    assert [bpe.decode_ids(x, own.bytes_of) for x in got] == [library.decode(e, skip_special_tokens=False) for e in expected]


def test_long_text_in_stretches(library, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 50)
    text = "some words, with  double spaces\n and <|endoftext|> marks " * 20
    assert np.frombuffer(bpe.ByteBpe(PATH).encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_token_is_its_own_encoding():
    own = bpe.ByteBpe(PATH)
    some = sorted(own.id_of)[::37]
    assert own.encode_words(some) == [own.id_of[t].to_bytes(4, "little") for t in some]


def test_encode_and_decode_tables(spark, library, odd_docs, no_docs):
    rows = bpe.decode(bpe.encode(odd_docs, PATH, keep=["doc_id"]).withColumnRenamed("ids", "packed"), PATH, ids="packed", keep=["doc_id", "n_tokens", "packed"]).collect()
    expected = sorted((str(r.doc_id), hashlib.sha256(np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest(), r.text or "") for r in odd_docs.collect())
    assert sorted((str(r.doc_id), hashlib.sha256(r.packed).hexdigest(), r.decoded) for r in rows) == expected
    together = bpe.encode(odd_docs, PATH, keep=["doc_id"], decoded=True).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in together) == sorted((str(r.doc_id), r.packed, r.decoded) for r in rows)
    assert bpe.encode(no_docs, PATH).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(64, 20), (200, 40)])
def test_chunks_resynchronise(library, texts, chunk, overlap):
    counter = token_counts.Counter(PATH, chunk, overlap)
    assert counter.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.resynced > 50


def test_overlap_widens_inside_a_long_word(library):
    counter = token_counts.Counter(PATH, 64, 20)
    texts = ["x" * 700 + " end", "ab" * 500, "a b c " * 50 + "<|endoftext|>" * 30 + " tail" * 40]
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.widened > 0


def test_count_table(library, odd_docs, no_docs):
    rows = token_counts.count_tokens(odd_docs, PATH, keep=["doc_id", "text"], chunk=4096, overlap=64).collect()
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 512)
    assert len(rows) == odd_docs.count() and token_counts.count_tokens(no_docs, PATH).count() == 0
