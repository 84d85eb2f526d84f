"""Token counts of texts of any length, by overlapping chunks that resynchronise.

A text longer than a chunk is encoded in chunks that overlap. Each chunk is encoded
alone, with offsets; two neighbours are spliced at a boundary that both have. Which
boundaries are safe is proven, not hoped for: the pre-tokenizer scans forward and looks
at most a few characters ahead, so if a word starts at the same place in two chunks and
that place is not close to the end of the left one, both scans go on alike from there.
Token borders inside a word are never used. If the overlap has no common word start (one
word may be longer than the overlap), the left chunk is encoded again with twice the
overlap, up to the end of the text if need be, where nothing is left to align.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arborstat.llm.bpe import WORD, ByteBpe
from arborstat.llm.common import in_groups, refuse_clash, schema_of, whole_text, with_columns

CHUNK = 32_768
OVERLAP = 512
#: How far the pre-tokenizer looks beyond the word it cuts (a contraction's two letters), with room to spare.
LOOKAHEAD = 8
#: Pieces whose counts are kept in a task, at most.
KEPT = 600_000


#: Character classes of letters below this one are alike in all libraries.
FIRST_UNUSUAL = "\u0250"


def fast_encoder(path: str):
    """A second library's encoder for the same vocabulary, if the file is a plain byte-level BPE; else None."""
    import tiktoken

    try:
        bpe = ByteBpe(path)
    except ValueError:
        return None
    return tiktoken.Encoding("counts", pat_str=WORD, mergeable_ranks=bpe.id_of, special_tokens={})


class Counter:
    """Token counts as the library gives them for one tokenizer file."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.of.no_truncation()
        self.of.no_padding()
        self.fast = fast_encoder(path)
        self.special = [t.content for t in self.of.get_added_tokens_decoder().values()]
        self.margin = max([LOOKAHEAD, *map(len, self.special)])
        self.chunk, self.overlap = chunk, max(overlap, 2 * self.margin)
        self.known: dict[str, int] = {}
        self.resynced = self.widened = 0

    def short(self, texts: list[str]) -> list[int]:
        """Counts of texts up to a chunk.

        A single space between two other characters starts a word for certain, so the
        pieces between such spaces are chunks that need no overlap; each distinct one is
        encoded once. A text with a piece that has white space at an end, or with a
        special token, is encoded whole.
        """
        if len(self.known) > KEPT:
            self.known = {}
        known, cut, distinct = self.known, [t.split(" ") for t in texts], set()
        for c in cut:
            distinct.update(c[1:-1])
        new = [p for p in distinct if p not in known]
        odd = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        known.update(dict.fromkeys(odd))
        plain = [p for p in new if p not in odd]
        known.update(zip(plain, self.sizes([" " + p for p in plain])))
        ends = list({c[0] for c in cut} | {" " + c[-1] for c in cut if len(c) > 1})
        of, out = dict(zip(ends, self.sizes(ends))), []
        for t, c in zip(texts, cut):
            try:
                certain = not any(s in t for s in self.special) and (len(c) < 2 or c[-1] and not c[-1][0].isspace() and c[0] and not c[0][-1].isspace())
                out.append(of[c[0]] + sum(map(known.__getitem__, c[1:-1])) + (of[" " + c[-1]] if len(c) > 1 else 0) if certain else None)
            except TypeError:
                out.append(None)
        whole = [i for i, n in enumerate(out) if n is None]
        for i, n in zip(whole, self.sizes([texts[i] for i in whole])):
            out[i] = n
        return out

    def sizes(self, texts: list[str]) -> Iterator[int]:
        """Counts without chunks. What has unusual letters goes to the library that the counts are defined by."""
        for t in texts:
            if self.fast and (t.isascii() or max(t) < FIRST_UNUSUAL) and not any(s in t for s in self.special):
                yield len(self.fast.encode_ordinary(t))
            else:
                yield len(self.of.encode(t, add_special_tokens=False).ids)

    def scan(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """(place in the text, tokens before it in this chunk) of each word of ``text[start:end]``, and of the chunk's end."""
        got = self.of.encode(text[start:end], add_special_tokens=False)
        starts, before = [], None
        for k, ((a, _), word) in enumerate(zip(got.offsets, got.word_ids)):
            if word != before or word is None:
                starts.append((start + a, k))
            before = word
        return [*starts, (end, len(got.ids))]

    def long(self, text: str) -> int:
        """Count of a text of any length: chunks spliced at common word starts."""
        total, size = 0, len(text)
        start, come_in = 0, 0  # of the present chunk, and the place from which its tokens count
        words, end = self.scan(text, 0, min(size, self.chunk + self.overlap)), min(size, self.chunk + self.overlap)
        while end < size:
            overlap, joined = self.overlap, None
            following = end - overlap
            while joined is None and end < size:
                nxt_end = min(size, following + self.chunk + self.overlap)
                nxt = self.scan(text, following, nxt_end)
                theirs = {a for a, _ in nxt[1:-1]}  # a chunk's own start proves nothing
                joined = next((a for a, _ in words if a in theirs and following < a <= end - self.margin and a >= come_in), None)
                if joined is None:
                    overlap *= 2
                    self.widened += 1
                    end = min(size, end + overlap)
                    words = self.scan(text, start, end)
            if joined is None:
                break  # the left chunk reaches the end of the text
            count = dict(words)
            total += count[joined] - count.get(come_in, 0)
            self.resynced += 1
            start, come_in, words, end = following, joined, nxt, nxt_end
        count = dict(words)
        return total + words[-1][1] - (count[come_in] if start else 0)

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        few = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        for i, n in zip(few, self.short([texts[i] for i in few])):
            out[i] = n
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.long(t)
        return out


@lru_cache(4)
def loaded(path: str, chunk: int, overlap: int) -> Counter:
    return Counter(path, chunk, overlap)


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` columns with n_bytes (UTF-8), n_tokens (long) and over_limit (n_tokens > ``limit``) of each row's whole text.

    Null texts count as empty: no bytes, no tokens. Repeated rows count alike; an empty
    table gives an empty one. Columns named like the outputs cannot be kept (ValueError). Memory
    for a text's tokens is bounded by the chunk, unless one word is longer. Rows stay
    where they are.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    refuse_clash(keep, ["n_bytes", "n_tokens", "over_limit"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path, chunk, overlap)
        for b in in_groups(batches, "__text"):
            n = counter.counts(b.column("__text").to_pylist())
            yield with_columns(b, [*keep, "n_bytes"], {"n_tokens": pa.array(n, pa.int64())})

    given = docs.select(*keep, F.octet_length(whole_text(text)).cast("bigint").alias("n_bytes"), whole_text(text).alias("__text"))
    counted = given.mapInArrow(run, schema_of(given, [*keep, "n_bytes"], "n_tokens bigint"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
