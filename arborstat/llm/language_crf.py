"""Language of each document by a linear-chain conditional random field over its words.

Every word gets a label; documents that switch languages get several. A word's features
are its affixes and inner n-grams (hashed), and its entry in a lexicon of the frequent
words of each language. Transitions between labels are learnt with them. Word marginals
come from forward-backward; a document's language has the largest mean marginal.

The lexicon is counted over all labelled rows. The weights are fitted on a bounded sample
of them (``per_lang`` documents of each language), every word taking its document's label.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from arborstat.llm.common import gives_back, in_groups, refuse_clash, schema_of, whole_text, with_columns

BITS = 17
#: Labelled documents of each language that the model is fitted on, at most.
PER_LANG = 300
#: Of a longer text a stretch of so many characters is taken, from a place that its hash sets, so that the sample's size has a bound.
SAMPLE_CHARS = 20_000
#: Frequent words of each language in the lexicon, at most.
LEXICON = 500
#: Shares of the words whose most frequent ones are found apart.
SHARES = 16
#: Words of a stretch that training takes at once.
STRETCH = 64
EPOCHS = 6
#: Characters of the texts that are scored together, about.
GROUP = 500_000
UNKNOWN = "und"

_LETTER = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])
_WHITE = re.compile(r"[\x20\x09-\x0D]")
_MIX = [np.uint32(k) for k in (0, 0, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


@dataclass
class Words:
    """The words of some texts: hashed features in a row, where each word's begin, and words per text."""

    grams: list[np.ndarray]
    starts: np.ndarray
    whole: np.ndarray
    counts: np.ndarray


def words_of(texts: list[str], grams: bool = True) -> Words:
    """Words are runs of letters (ASCII letters and all other non-ASCII characters), in lower case."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    a = np.frombuffer(b"\0" + b"\0".join(parts) + b"\0\0\0\0", np.uint8)
    letter = _LETTER[a]
    begins = np.flatnonzero(letter[1:] & ~letter[:-1])  # the place before the first letter
    counts = np.diff(np.searchsorted(begins, np.concatenate([[0], np.cumsum(sizes)])))
    # Keep each word with one border before it; the next word's border ends it.
    keep = letter.copy()
    keep[begins] = True
    at = np.flatnonzero(keep)
    b = np.where(letter[at], a[at], 0).astype(np.uint32)
    starts = np.searchsorted(at, begins)
    border = b == 0
    padded = np.concatenate([b, np.zeros(4, np.uint32)])
    edge = np.concatenate([border, np.ones(4, bool)])
    found, code, crossed = [], b.copy(), np.zeros(len(b), bool)
    for n in (2, 3, 4) if grams else ():
        code = (code << np.uint32(8)) ^ padded[n - 1 : n - 1 + len(b)]
        if n > 2:
            crossed = crossed | edge[n - 2 : n - 2 + len(b)]  # a border inside, not at an end
        found.append(np.where(crossed, 0, 1 + ((code * _MIX[n]) >> np.uint32(32 - BITS)) % np.uint32((1 << BITS) - 1)).astype(np.int32))
    # A digest of the whole word: an order-sensitive sum.
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    powers = np.cumprod(np.full(64, 0x100000001B3, np.uint64))
    letters = (b.astype(np.uint64) + np.uint64(0x9E37)) * powers[place % 64] * (place // 64 + 1).astype(np.uint64)
    whole = np.add.reduceat(letters, starts) if len(starts) else np.zeros(0, np.uint64)
    return Words(found, starts, whole, counts)


def pieces(text: str) -> Iterator[str]:
    """The text in parts of about GROUP characters, cut at white space (a longer run without any stays whole)."""
    at = 0
    while len(text) - at > GROUP:
        cut = _WHITE.search(text, at + GROUP)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # (features, langs); row 0 stays zero
    lexicon: np.ndarray  # sorted digests
    lexical: np.ndarray  # (lexicon + 1, langs); the last row is for other words
    step: np.ndarray  # (langs, langs) transition scores
    first: np.ndarray

    def entry(self, whole: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(whole), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == whole, at, len(self.lexicon))

    def emissions(self, w: Words) -> np.ndarray:
        if not len(w.starts):
            return np.zeros((0, len(self.langs)), np.float32)
        total = self.weight[w.grams[0]]
        total += self.weight[w.grams[1]]
        total += self.weight[w.grams[2]]
        return np.add.reduceat(total, w.starts, axis=0) + self.lexical[self.entry(w.whole)]

    def emitted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions and words per text; texts of over GROUP characters go piece by piece."""
        if max(map(len, texts), default=0) <= GROUP:
            w = words_of(texts)
            return self.emissions(w), w.counts
        parts, counts = [], []
        for t in texts:
            mine = [self.emissions(words_of([piece])) for piece in pieces(t)]
            parts += mine
            counts.append(sum(map(len, mine)))
        return np.concatenate(parts), np.array(counts, np.int64)

    def marginals(self, emitted: np.ndarray, counts: np.ndarray, pairs: bool = False):
        """Marginals of every word, sequences of ``counts`` words one after another; with ``pairs`` also expected transitions.

        Sequences are cut into blocks of about the root of their length. The transfer matrices of
        all blocks are multiplied out side by side, messages run over the blocks, and all
        blocks are then filled in side by side: the same sums as word by word.
        """
        ends = np.cumsum(counts)
        step = np.exp(self.step - self.step.max()).astype(np.float32)
        first = np.exp(self.first - self.first.max()).astype(np.float32)
        scaled = np.exp(emitted - emitted.max(axis=1, keepdims=True)).astype(np.float32) if len(emitted) else emitted
        ahead, back = np.ones_like(scaled), np.ones_like(scaled)
        length = np.frexp(np.maximum(counts, 1).astype(np.float64) - 0.5)[1]
        for size in np.unique(length[counts > 0]):  # sequences of similar length go together
            mine = np.flatnonzero((length == size) & (counts > 0))
            n = counts[mine]
            steps = int(np.ceil(np.sqrt(n.max())))
            blocks = -(-n // steps)
            top = np.cumsum(blocks) - blocks  # first block of each sequence
            k = np.arange(blocks.sum()) - np.repeat(top, blocks)
            at = (np.repeat(ends[mine] - n, blocks) + k * steps)[:, None] + np.arange(steps)[None, :]
            there = at < np.repeat(ends[mine], blocks)[:, None]
            e = np.where(there[:, :, None], scaled[np.where(there, at, 0)], 1).transpose(1, 0, 2)
            live = there.T[:, :, None]
            whole = np.broadcast_to(np.eye(len(step), dtype=np.float32), (len(k), *step.shape))
            for t in range(1, steps if blocks.max() > 1 else 0):
                more = (whole @ step) * e[t][:, None, :]
                whole = np.where(live[t][:, :, None], more / more.sum((1, 2), keepdims=True), whole)
            enter, leave = first * e[0], np.ones_like(e[0])
            for j in range(1, int(blocks.max())):
                b = top[blocks > j] + j
                x = ((enter[b - 1][:, None, :] @ whole[b - 1])[:, 0] @ step) * e[0][b]
                enter[b] = x / x.sum(1, keepdims=True)
            for j in range(int(blocks.max()) - 1, 0, -1):
                b = top[blocks > j] + j
                y = (e[0][b] * (whole[b] @ leave[b][:, :, None])[:, :, 0]) @ step.T
                leave[b - 1] = y / y.sum(1, keepdims=True)
            forth = np.empty_like(e)
            forth[0] = cur = enter / enter.sum(1, keepdims=True)
            for t in range(1, steps):
                cur = (cur @ step) * e[t]
                cur /= cur.sum(1, keepdims=True)
                forth[t] = cur
            ahead[at[there]] = forth.transpose(1, 0, 2)[there]
            forth[steps - 1] = cur = leave
            for t in range(steps - 2, -1, -1):
                new = (e[t + 1] * cur) @ step.T
                forth[t] = cur = np.where(live[t + 1], new / new.sum(1, keepdims=True), cur)
            back[at[there]] = forth.transpose(1, 0, 2)[there]
        out = ahead * back
        out /= out.sum(1, keepdims=True)
        if not pairs:
            return out
        inner = np.ones(len(out), bool)
        inner[ends[counts > 0] - 1] = False
        i = np.flatnonzero(inner)
        joint = ahead[i][:, :, None] * step * (scaled[i + 1] * back[i + 1])[:, None, :]
        joint /= np.maximum(joint.sum((1, 2), keepdims=True), 1e-30)
        return out, joint.sum(0)


def fit(rows: list[tuple[str, str]], seed: int = 7, lexicon: np.ndarray | None = None) -> Model:
    """Fit on (text, lang) rows: gradient steps (one rate per weight) on stretches of words.

    ``lexicon``: sorted digests of frequent words; without it they are counted in the rows.
    """
    langs = sorted({lang for _, lang in rows})
    labels = np.array([langs.index(lang) for _, lang in rows])
    w = words_of([t for t, _ in rows])
    owner = np.repeat(labels, w.counts)
    if lexicon is None:
        keys = [np.zeros(0, np.uint64)]
        for k in range(len(langs)):
            found, n = np.unique(w.whole[owner == k], return_counts=True)
            keys.append(found[np.argsort(-n, kind="stable")[:LEXICON]])
        lexicon = np.unique(np.concatenate(keys))
    L = len(langs)
    m = Model(langs, np.zeros((1 << BITS, L), np.float32), lexicon, np.zeros((len(lexicon) + 1, L), np.float32), np.zeros((L, L), np.float32), np.zeros(L, np.float32))
    if not len(owner):
        return m
    # Stretches of up to STRETCH words, shuffled.
    doc_start = np.cumsum(w.counts) - w.counts
    begin = np.concatenate([np.arange(s, s + n, STRETCH) for s, n in zip(doc_start, w.counts)])
    size = np.minimum(STRETCH, np.repeat(doc_start + w.counts, -(-w.counts // STRETCH)) - begin)
    stop = np.append(w.starts, len(w.grams[0]))
    entry = m.entry(w.whole)
    square = [np.full_like(x, 1e-2) for x in (m.weight, m.lexical, m.step, m.first)]
    rng = np.random.default_rng(seed)

    def move(x: np.ndarray, g: np.ndarray, k: int, rate: float) -> None:
        square[k] += g * g
        x -= rate * g / np.sqrt(square[k])

    for _ in range(EPOCHS):
        order = rng.permutation(len(begin))
        for some in np.array_split(order, max(1, len(order) // 512)):
            words = np.concatenate([np.arange(b, b + n) for b, n in zip(begin[some], size[some])])
            spans = [np.arange(stop[i], stop[i + 1]) for i in words]
            flat, starts = np.concatenate(spans), np.cumsum([0, *map(len, spans[:-1])])
            part = Words([g[flat] for g in w.grams], starts, w.whole[words], size[some])
            p, expected = m.marginals(m.emissions(part), size[some], pairs=True)
            g = p
            g[np.arange(len(words)), owner[words]] -= 1
            each = np.repeat(g, list(map(len, spans)), axis=0)
            total = np.zeros_like(m.weight)
            for grams in part.grams:
                for k in range(L):
                    total[:, k] += np.bincount(grams, each[:, k], 1 << BITS)
            total[0] = 0
            lexical = np.stack([np.bincount(entry[words], g[:, k], len(lexicon) + 1) for k in range(L)], 1).astype(np.float32)
            seen = np.zeros_like(expected)
            own = owner[begin[some]]
            np.add.at(seen, (own, own), size[some] - 1)
            heads = np.cumsum(size[some]) - size[some]
            scale = len(words)
            move(m.weight, total / scale * 50, 0, 0.1)
            move(m.lexical, lexical / scale * 50, 1, 0.1)
            move(m.step, (expected - seen) / scale + 1e-3 * m.step, 2, 0.1)
            move(m.first, g[heads].sum(0) / len(some), 3, 0.05)
    return m


def sample(docs: DataFrame, learn: Column, per_lang: int, doc_id: str, text: str, lang: str) -> list[tuple[str, str]]:
    """(text, lang) of up to ``per_lang`` different texts of each language, in an order set by hashes of the texts; a stretch of each long text."""
    t = F.col(text)
    rows = docs.where(learn & F.col(lang).isNotNull() & t.isNotNull()).select(t.alias("t"), F.col(lang).alias("l"), F.struct(F.xxhash64(t, F.lit(11)).alias("a"), F.xxhash64(F.lit(12), t).alias("b")).alias("h"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    cut = rows.select("l", "h").distinct().withColumn("r", rank).where(F.col("r") <= per_lang).groupBy("l").agg(F.max("h").alias("top"))
    some = rows.join(cut, "l").where(F.col("h") <= F.col("top"))
    begin = F.pmod(F.col("h.a"), F.greatest(F.char_length("t") - SAMPLE_CHARS, F.lit(0)) + 1)
    kept = some.dropDuplicates(["l", "h"]).select(F.substring("t", begin.cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("t"), "l")
    return sorted((r["t"], r["l"]) for r in kept.collect())


def frequent_words(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> np.ndarray:
    """Digests of the LEXICON most frequent words of each language, counted over all learnable rows; ties by digest."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_groups(batches, "t", GROUP):
            langs = b.column("l").to_pylist()
            owners = np.array(langs, object)
            whole = [np.concatenate([words_of([p], grams=False).whole for p in pieces(t)]) for t in b.column("t").to_pylist()]
            for name in sorted(set(langs)):
                found, n = np.unique(np.concatenate([whole[i] for i in np.flatnonzero(owners == name)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["l", "w", "n"])

    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))
    sums = rows.mapInArrow(gives_back(count), "l string, w long, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    # First the best of each share of the words, so that a language's last ranking reads SHARES * LEXICON rows at most.
    top = sums.withColumn("share", F.pmod(F.xxhash64("w"), F.lit(SHARES)))
    for keys in (["l", "share"], ["l"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "w"))
        top = top.withColumn("r", rank).where(F.col("r") <= LEXICON).drop("r")
    top = top.select("w").distinct()
    return np.unique(np.array([r["w"] for r in top.collect()], np.int64).view(np.uint64))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, outputs: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns with lang_pred and score (mean marginal of that language over the words), named as ``outputs`` says.

    lang_pred is ``und`` with score 0 where the text is null or has no letter, and
    everywhere if the model has learnt no language. Equal means go to the first language
    in alphabetical order. Equal texts get equal results, an empty table an empty one;
    columns named like the outputs cannot be kept (ValueError).
    """
    keep = docs.columns if keep is None else keep
    refuse_clash(keep, outputs)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # size: 2^17 features by languages

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in in_groups(batches, "__text", GROUP):
            emitted, counts = m.emitted(b.column("__text").to_pylist())
            has = np.array(b.column("__letter").to_pylist(), bool) & (counts > 0) & bool(m.langs)
            best, score = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            if has.any():
                p = m.marginals(emitted, counts).astype(np.float64)
                some = np.flatnonzero(counts > 0)
                mean = np.zeros((b.num_rows, len(m.langs)))
                mean[some] = np.add.reduceat(p, (np.cumsum(counts) - counts)[some]) / counts[some, None]
                best, score = mean.argmax(1), np.clip(mean.max(1), 0, 1)
            names = [m.langs[k] if h else UNKNOWN for k, h in zip(best, has)]
            yield with_columns(b, keep, {outputs[0]: pa.array(names, pa.string()), outputs[1]: pa.array(np.where(has, score, 0.0), pa.float64())})

    given = docs.select(*keep, whole_text(text).alias("__text"), whole_text(text).rlike(r"\p{L}").alias("__letter"))
    return given.mapInArrow(gives_back(run), schema_of(docs, keep, f"`{outputs[0]}` string, `{outputs[1]}` double"))


def train(docs: DataFrame, learn: Column, per_lang: int = PER_LANG, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from the rows where ``learn`` holds and neither text nor language is null."""
    return fit(sample(docs, learn, per_lang, doc_id, text, lang), lexicon=frequent_words(docs, learn, text, lang))
