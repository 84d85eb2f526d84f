"""Toxicity by class-conditional Kneser-Ney word models with a shared backoff.

Both classes back off to one model of all documents, labelled or not: discounted word
counts over continuation counts (how many different left neighbours a word has). A class
keeps mass of its own only for words it uses more often than the shared model lets one
expect, beyond the noise of that count; the discount is the expected count and DISCOUNT
standard deviations. Rare expressions thus weigh the same in both classes. A document's
evidence is the difference of its two length-normalised log-likelihoods.

Words are told apart by a 64-bit digest and left neighbours by theirs. Counts and log
ratios stay Spark tables that grow with the input; documents meet them by a join on words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from arborstat.llm.common import gives_back, in_groups, whole_text
from arborstat.llm.jaccard_join import _mixed, texts_of
from arborstat.session import cut_lineage, release, shuffles_removed

DISCOUNT = 2.5
SHARED_DISCOUNT = 0.75
#: Log ratios are whole multiples of 1 / UNIT, so that their sums do not depend on an order.
UNIT = 1 << 24
#: Characters of the texts that are taken together, about.
GROUP = 2_000_000
#: Pairs that a task gathers, about, before it sends them on, each once.
HELD = 1 << 22
#: Labelled rows on which the two weights of the score are fitted, at most.
CALIBRATION_ROWS = 20_000

_WORD = re.compile(rb"[A-Za-z\x80-\xff]+")


def words_in(text: str) -> list[bytes]:
    """Runs of letters (ASCII letters and all other non-ASCII characters), in lower case."""
    return _WORD.findall(text.lower().encode("utf-8", "surrogatepass"))


def digests(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64).view(np.int64)


#: Left neighbour of a first word.
_START = digests([b""])


def word_numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digest of every word of the texts in turn, and words per text."""
    words = [words_in(t) for t in texts]
    return digests(w for some in words for w in some), np.fromiter(map(len, words), np.int64, len(words))


def _words(rows: DataFrame) -> DataFrame:
    """(word, n, n0, n1) per group of texts from rows (text, toxic): in how many rows without a label and of each class a word occurs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_groups(batches, "text", GROUP):
            w, counts = word_numbers(b.column("text").to_pylist())
            words, at = np.unique(w, return_inverse=True)
            once = np.unique(np.repeat(np.arange(b.num_rows), counts) << 32 | at)
            label = np.array([-1 if x is None else x for x in b.column("toxic").to_pylist()], np.int64)
            of, word = label[once >> 32], once & 0xFFFFFFFF
            n = [np.bincount(word[of == k], minlength=len(words)) for k in (-1, 0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(words), *map(pa.array, n)], names=["word", "n", "n0", "n1"])

    return rows.select("text", "toxic").mapInArrow(run, "word bigint, n bigint, n0 bigint, n1 bigint")


def _pairs(rows: DataFrame) -> DataFrame:
    """(word, before) from rows (text): every word with its left neighbour, once per group of texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_groups(batches, "text", GROUP):
            w, counts = word_numbers(b.column("text").to_pylist())
            words, at = np.unique(w, return_inverse=True)
            left = np.roll(at, 1) + 1
            left[(np.cumsum(counts) - counts)[counts > 0]] = 0
            pairs = np.unique(at << 32 | left)
            before = np.concatenate([_START, words])[pairs & 0xFFFFFFFF]
            yield pa.RecordBatch.from_arrays([pa.array(words[pairs >> 32]), pa.array(before)], names=["word", "before"])

    return rows.select("text").mapInArrow(run, "word bigint, before bigint")


def _left_neighbours(pairs: DataFrame) -> DataFrame:
    return pairs.distinct().groupBy("word").agg(F.count("*").alias("contexts"))


def _once(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(np.full(min(len(x), 1), True), x[1:] != x[:-1])]


def pair_count(rows: DataFrame, bits: int = 8) -> int:
    """How many different pairs of a word and its left neighbour the rows (text) have in all.

    Pairs are told apart by 64-bit digests as words are, and counted in 2^``bits`` parts
    by their first bits. Sorted, they are sent as gaps, in as many bytes as the widest takes.
    """
    low = np.uint64(64 - bits)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        every = _once(np.concatenate(held))
        at = np.append(np.flatnonzero(np.diff(every >> low, prepend=~(every[:1] >> low))), len(every))
        parts, packs = every[at[:-1]] >> low, []
        for part, start, end in zip(parts, at, at[1:]):
            gaps = np.diff(every[start:end], prepend=part << low)
            width = max(1, int(gaps.max()).bit_length() + 7 >> 3)
            packs.append(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int64)), pa.array(packs, pa.binary()), pa.array(np.diff(at))], names=["part", "gaps", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in in_groups(batches, "text", GROUP):
            w, counts = word_numbers(b.column("text").to_pylist())
            left = np.roll(w, 1)
            left[(np.cumsum(counts) - counts)[counts > 0]] = _START[0]
            held.append(_once(_mixed(w.view(np.uint64)) + left.view(np.uint64)))
            n += len(held[-1])
            if n > HELD:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def count(key, parts):
        every = []
        for gaps, n in zip(parts.column("gaps").to_pylist(), parts.column("n").to_pylist()):
            whole = np.zeros((n, 8), np.uint8)
            whole[:, : len(gaps) // n] = np.frombuffer(gaps, np.uint8).reshape(n, -1)
            every.append(np.cumsum(whole.view("<u8").ravel()))
        return pa.table({"pairs": pa.array([len(_once(np.concatenate(every)))], pa.int64())})

    packs = rows.select("text").mapInArrow(gives_back(run), "part bigint, gaps binary, n bigint")
    with shuffles_removed(rows.sparkSession):
        return packs.groupBy("part").applyInArrow(count, "pairs bigint").agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]


def document_counts(rows: DataFrame, background: DataFrame) -> DataFrame:
    """(word, n, n0, n1): in how many rows of ``background`` (text) and of each class of ``rows`` (text, toxic) a word occurs."""
    both = _words(rows).withColumn("n", F.lit(0)).unionByName(_words(background.select("text", F.lit(None).cast("bigint").alias("toxic"))))
    return both.groupBy("word").agg(*[F.sum(x).alias(x) for x in ("n", "n0", "n1")])


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n, n0, n1, contexts) from rows (text, toxic): :func:`document_counts` and how many left neighbours each word has."""
    return document_counts(rows, rows).join(_left_neighbours(_pairs(rows)), "word")


def log_ratios(counts: DataFrame, background: DataFrame) -> DataFrame:
    """(word, ratio) of the words with evidence: log P(word | toxic) - log P(word | ordinary) in 1 / UNIT, less what a word without evidence has.

    ``counts``: (word, n, n0, n1) of all words. The continuation counts are divided by the
    number of all pairs of ``background`` (text), which are counted. More left neighbours
    only raise what the shared model expects, so a word that has no evidence at none has
    none at any number, its ratio is 0 whatever its neighbours are, and they are told apart
    for the other words only.
    """
    freed = F.coalesce(F.sum(F.least("n", F.lit(SHARED_DISCOUNT))), F.lit(0.0)).alias("freed")
    total = counts.agg(F.count("*").alias("words"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "n0", "n1")], freed).first()
    none = counts.where("false").select("word", F.lit(0).cast("bigint").alias("ratio"))
    if not total["n0"] or not total["n1"]:
        return none
    unigram = F.greatest(F.col("n") - SHARED_DISCOUNT, F.lit(0.0)) / total["n"]

    def own(k: str) -> Column:
        expected = F.col("shared") * total[k]
        return F.greatest(F.col(k) - expected - DISCOUNT * F.sqrt(expected + 1), F.lit(0.0)) / total[k]

    few = cut_lineage(counts.withColumn("shared", unigram).where((own("n0") > 0) | (own("n1") > 0)).select("word", "n", "n0", "n1"))
    if few.isEmpty():
        release(few)
        return none
    # A document has at least about as many pairs as words: parts grow in number with them up to a limit, then in size.
    pairs = pair_count(background, min(16, max(6, (total["n"] >> 17).bit_length())))
    near = cut_lineage(_left_neighbours(_pairs(background).join(few.select("word"), "word", "left_semi")))
    spread = (F.col("contexts") + 0.5) / (pairs + 0.5 * total["words"])
    shared = unigram + total["freed"] / total["n"] * spread
    # Words that no class has mass for are equally likely in both.
    some = few.join(near, "word").withColumn("shared", shared).select("word", "shared", own("n0").alias("own0"), own("n1").alias("own1"))
    some = cut_lineage(some.where("own0 > 0 or own1 > 0"))
    rest = some.agg(1 - F.coalesce(F.sum("own0"), F.lit(0.0)), 1 - F.coalesce(F.sum("own1"), F.lit(0.0))).first()
    logs = [F.log(F.col(f"own{k}") / rest[k] + F.col("shared")) for k in (0, 1)]
    out = cut_lineage(some.select("word", F.round((logs[1] - logs[0]) * UNIT).cast("bigint").alias("ratio")))
    release(few, near, some)
    return out


def evidence(docs: DataFrame, ratios: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with mean (of the words' log ratios) and root (mean times the root of the number of words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_groups(batches, "__text", GROUP):
            words = [Counter(words_in(t)) for t in b.column("__text").to_pylist()]
            row, size = b.column("__row").to_numpy(), np.fromiter(map(len, words), np.int64, len(words))
            times = np.fromiter((k for w in words for k in w.values()), np.int64)
            n = pa.array(np.fromiter((w.total() for w in words), np.int64, len(words)))
            # A row of its own carries the columns; any word will do as it is there no times.
            yield pa.RecordBatch.from_arrays([b.column("__row"), b.column("__row"), pa.array(np.zeros(len(words), np.int64)), n, *(b.column(k) for k in keep)], names=names)
            none = [pa.nulls(len(times), c.type) for c in (n, *(b.column(k) for k in keep))]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row, size)), pa.array(digests(x for w in words for x in w)), pa.array(times), *none], names=names)

    names = ["__row", "__word", "__times", "__n", *keep]
    given = docs.select(*keep, whole_text(text).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    schema = ", ".join(["__row bigint", "__word bigint", "__times bigint", "__n bigint", *(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)])
    met = given.mapInArrow(run, schema).join(ratios.select(F.col("word").alias("__word"), "ratio"), "__word", "left")
    total = F.coalesce(F.sum(F.col("__times") * F.col("ratio")), F.lit(0)) / F.lit(float(UNIT))
    sums = met.groupBy("__row").agg(total.alias("__total"), F.max("__n").alias("__n"), *[F.first(k, ignorenulls=True).alias(k) for k in keep])
    n = F.greatest("__n", F.lit(1))
    return sums.select(*keep, (F.col("__total") / n).alias("mean"), (F.col("__total") / F.sqrt(n)).alias("root"))


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (intercept, mean, root) of a logistic curve; without both classes the base rate alone."""
    base = np.array([np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0, 0.0])
    if y.sum() in (0, len(y)):
        return base
    f = np.column_stack([np.ones(len(x)), x])
    w = base.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -40, 40)))
        step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + 1e-2 * np.eye(3), f.T @ (y - p) - 1e-2 * (w - base))
        w += np.clip(step, -5, 5)
    return w


def score(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7, rows: int = CALIBRATION_ROWS) -> DataFrame:
    """(doc_id, score, predicted), one row per row of ``docs``: how likely the text is toxic, and whether score >= ``threshold``.

    Learns from documents of ``docs`` where ``learn`` (over its columns) holds and
    ``labels`` has a non-null label; an id labelled more than once counts as toxic if any
    label says so. The shared backoff counts all of ``docs``. Null texts are empty; a text without words gets the score of no evidence.
    Without labels of both classes every score is the smoothed base rate. Equal texts get
    equal scores; an empty table gives an empty one.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("bigint").alias("id")).agg(F.max(label).cast("bigint").alias("toxic"))
    known = docs.where(learn).select(F.col(doc_id).cast("bigint").alias(doc_id), text)
    ids = cut_lineage(marks.join(known.select(F.col(doc_id).alias("id")).distinct(), "id", "left_semi"))
    learnt = texts_of(known, ids.select("id"), doc_id, text).join(ids, "id").select("text", "toxic")
    every = docs.select(whole_text(text).alias("text"))
    counts = cut_lineage(document_counts(learnt, every))
    ratios = log_ratios(counts, every)
    found = cut_lineage(evidence(docs.withColumn("__learn", learn), ratios, text, [doc_id, "__learn"]))
    release(counts, ratios)
    seen = found.where("__learn").select(F.col(doc_id).cast("bigint").alias("id"), "mean", "root").join(ids, "id")
    some = seen.orderBy(F.xxhash64("id", F.lit(5)), "id", "mean").limit(rows).select("mean", "root", "toxic").toPandas()
    release(ids)
    w = calibrate(some[["mean", "root"]].to_numpy(float), some["toxic"].to_numpy(float))
    logit = F.lit(float(w[0])) + F.col("mean") * float(w[1]) + F.col("root") * float(w[2])
    out = found.select(doc_id, (1 / (1 + F.exp(-logit))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
