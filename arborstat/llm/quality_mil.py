"""Quality classifier by attention over passages (multiple-instance learning).

Only documents are labelled, but quality shows in passages. Every passage of a text is
encoded; gated attention says how much each counts; the score reads the weighted passage
representation. Encoder, gates and reader are learnt together from document labels, on a
bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from arborstat.llm.common import in_groups, refuse_clash, schema_of, whole_text, with_columns
from arborstat.llm.jaccard_join import texts_of
from arborstat.session import cut_lineage, release

#: Bytes of a passage.
PASSAGE = 600
#: Labelled documents that the model is fitted on, at most, and passages of each: longer ones are left out of the sample.
TRAINING_ROWS, TRAINING_PASSAGES = 4_000, 256
HIDDEN, GATE, STEPS = 16, 8, 250
#: Kinds of bytes; pairs of kinds are a passage's features.
KINDS = 16


def byte_kinds() -> np.ndarray:
    of = np.full(256, 12)
    for kind, chars in enumerate([" ", "\n", "", "", "", ".", ",", "!?", "|", "#*$%&<>", "\"'()[]{}", "-_/\\"]):
        of[[ord(c) for c in chars]] = kind
    of[ord("a") : ord("z") + 1], of[ord("A") : ord("Z") + 1], of[ord("0") : ord("9") + 1] = 2, 3, 4
    of[128:192], of[192:] = 14, 13
    of[[b for b in range(32) if b != 10]] = 15
    return of


_KIND = byte_kinds()


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (roots of the shares of byte-kind pairs), and passages per text; an empty text has one without features."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    counts = np.maximum(1, -(-sizes // PASSAGE))
    kinds = _KIND[np.frombuffer(b"".join(parts), np.uint8)]
    total = int(counts.sum())
    if not len(kinds):
        return np.zeros((total, KINDS * KINDS), np.float32), counts
    starts, first = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
    place = np.arange(len(kinds)) - np.repeat(starts, sizes)
    of = np.repeat(first, sizes) + place // PASSAGE
    pair = kinds * KINDS + np.append(kinds[1:], 0)
    ends = np.append(of[1:] != of[:-1], True)  # the last byte of a passage has no successor in it
    x = np.bincount((of * (KINDS * KINDS) + pair)[~ends], minlength=total * KINDS * KINDS).reshape(total, -1)
    return np.sqrt(x / np.maximum(1, x.sum(1, keepdims=True))).astype(np.float32), counts


class Model:
    """Weights, and the forward pass over bags of passages."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        d = KINDS * KINDS
        self.w = {"enc": rng.normal(0, 0.3, (d, HIDDEN)), "b": np.zeros(HIDDEN), "tan": rng.normal(0, 0.3, (HIDDEN, GATE)), "sig": rng.normal(0, 0.3, (HIDDEN, GATE)),
                  "att": np.zeros(GATE), "read": rng.normal(0, 0.1, HIDDEN), "bias": np.zeros(1)}
        self.base: float | None = 0.5  # the score of all texts as long as nothing is learnt

    def forward(self, x: np.ndarray, counts: np.ndarray):
        w, starts = self.w, np.cumsum(counts) - counts
        h = np.tanh(x @ w["enc"] + w["b"])
        t, s = np.tanh(h @ w["tan"]), 1 / (1 + np.exp(-(h @ w["sig"])))
        e = (t * s) @ w["att"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["read"] + w["bias"], -40, 40)))
        return p, (h, t, s, a, z)

    def gradients(self, x, counts, y, decay: float = 1e-4):
        w, starts = self.w, np.cumsum(counts) - counts
        p, (h, t, s, a, z) = self.forward(x, counts)
        out = (p - y) / len(y)
        back = np.repeat(out[:, None] * w["read"], counts, axis=0)
        ga = (back * h).sum(1)
        ge = a * (ga - np.repeat(np.add.reduceat(a * ga, starts), counts))
        gate = ge[:, None] * w["att"]
        gt, gs = gate * s * (1 - t * t), gate * t * s * (1 - s)
        gh = (a[:, None] * back + gt @ w["tan"].T + gs @ w["sig"].T) * (1 - h * h)
        g = {"enc": x.T @ gh, "b": gh.sum(0), "tan": h.T @ gt, "sig": h.T @ gs, "att": (t * s).T @ ge, "read": z.T @ out, "bias": np.array([out.sum()])}
        return {k: v + decay * w[k] for k, v in g.items()}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.03) -> Model:
        self.base = float((y.sum() + 0.5) / (len(y) + 1))
        if not len(y) or y.min() == y.max():
            return self
        self.base = None
        one, two = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for n in range(1, steps + 1):
            for k, g in self.gradients(x, counts, y).items():
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                self.w[k] -= rate * (one[k] / (1 - 0.9**n)) / (np.sqrt(two[k] / (1 - 0.999**n)) + 1e-8)
        return self

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.full(len(texts), self.base) if self.base is not None else self.forward(*passages(texts))[0]


def train(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAINING_ROWS) -> Model:
    """A model from up to ``rows`` documents where ``learn`` holds and ``label`` is not null (the smaller one, if an id has several)."""
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("bigint").alias("id")).agg(F.min(label).cast("double").alias("y"))
    known = docs.where(learn).select(F.col(doc_id).cast("bigint").alias(doc_id), text)
    some = marks.join(known.select(F.col(doc_id).alias("id")).distinct(), "id", "left_semi").orderBy(F.xxhash64("id", F.lit(21)), "id").limit(rows)
    some = cut_lineage(some)
    given = texts_of(known, some.select("id"), doc_id, text).join(F.broadcast(some), "id")  # ``rows`` rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_groups(batches, "text"):
            x, counts = passages(b.column("text").to_pylist())
            cut = np.split((255 * x).round().astype(np.uint8), np.cumsum(counts)[:-1])
            kept = counts <= TRAINING_PASSAGES
            out = pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([c.tobytes() if k else b"" for c, k in zip(cut, kept)], pa.binary())], names=["id", "y", "x"])
            yield out.filter(pa.array(kept))

    bags = sorted((r["id"], r["y"], r["x"]) for r in given.select("id", "y", "text").mapInArrow(run, "id bigint, y double, x binary").collect())
    release(some)
    if not bags:
        return Model()
    x = [np.frombuffer(b[2], np.uint8).reshape(-1, KINDS * KINDS) for b in bags]
    return Model().fit(np.concatenate(x).astype(np.float32) / 255, np.array([len(v) for v in x]), np.array([b[1] for b in bags]))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with score (0 to 1, higher: good quality likelier) and predicted (1 if score >= 0.5).

    A null text counts as empty, one passage without features. Without labels of both
    kinds every score is the smoothed base rate. Equal texts get equal scores; an empty
    table gives an empty one; columns named like the outputs cannot be kept (ValueError).
    """
    keep = docs.columns if keep is None else keep
    refuse_clash(keep, ["score", "predicted"])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_groups(batches, "__text", 2_000_000):
            yield with_columns(b, keep, {"score": pa.array(sent.value.scores(b.column("__text").to_pylist()), pa.float64())})

    given = docs.select(*keep, whole_text(text).alias("__text"))
    return given.mapInArrow(run, schema_of(docs, keep, "score double")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
