"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

A window asks for an anchor's best rows with scores between two limits. Blocks of rows are
indexed by dimension, strongest dimensions first. A row is left out of a dimension's list
once the norm of what is left of it, times the anchors', stays below every threshold: its
pairs are judged by the remaining norms alone. Partial scores add up list by list; pairs
whose score so far and remaining norms cannot reach the threshold are given up, and once
few are left these alone are scored to the end.

Thresholds start high, so that the lists are short, and are lowered for the anchors whose
windows are not yet full, to the window's own lower limit at the last. Windows travel with
the blocks of anchors; every join is cut to the best of its block before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from arborstat.llm.topk_search import whole_numbers
from arborstat.session import cut_and_count, cut_lineage, release

ANCHOR_ROWS, ROWS = 512, 4096
#: Dimensions whose lists are added up before pairs are given up for the first time; then twice as many, and so on.
STEP = 8
#: Pairs are scored one by one once fewer than this share is left.
SPARSE = 0.1
#: Pairs whose remaining products are computed at a time.
SLICE = 1 << 16
NO_LIMIT = 1 << 62
#: Share of the way from a window's upper to its lower limit at which each round's threshold lies.
LOWERED = (0.25, 0.5, 1.0)

_BLOCK = "key bigint, salt bigint, ids binary, labels binary, vectors binary, bits int"
_ANCHORS = _BLOCK + ", of binary, window binary, low binary, high binary"
_FOUND = ["anchor", "window", "row_id", "score"]


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """Doubles where inner products are exact in them, else unlimited integers."""
    largest = [max(int(x.max()), -int(x.min())) if x.size else 0 for x in (a, b)]
    return np.float64 if largest[0] * largest[1] * max(1, a.shape[1]) < 2**52 else object


def _suffix_norms(m: np.ndarray) -> np.ndarray:
    """Norm of each row from each dimension on, a little too large rather than too small."""
    squares = np.square(m.astype(np.float64))
    tails = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([tails, np.zeros((len(m), 1))], axis=1)) * (1 + 1e-9)


def _spans(width: int) -> list[tuple[int, int]]:
    edges = [0]
    while edges[-1] < width:
        edges.append(min(width, max(STEP, 2 * edges[-1])))
    return list(zip(edges, edges[1:]))


def lists_end(nx: np.ndarray, ny: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each row the dimension from which it is in no list: the norm of the rest, times that of any anchor, is below the anchor's limit."""
    reach = np.full(nx.shape[1], -np.inf)
    if np.all(limit > 0):
        for d in range(nx.shape[1]):
            some = nx[:, d] > 0
            reach[d] = np.min(limit[some] / nx[some, d], initial=np.inf)
    covered = ny < reach[None, :]
    covered[:, -1] = True
    return np.argmax(covered, axis=1)


def above(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs (row of ``x``, row of ``y``, score) whose inner product reaches ``least`` of the row of ``x``, and how many products were computed.

    The dimensions come strongest first.
    """
    kind, spans = _kind(x, y), _spans(x.shape[1])
    nx, ny = _suffix_norms(x), _suffix_norms(y)
    limit = least.astype(np.float64)
    limit = limit - np.abs(limit) * 1e-9 - 1
    ends = lists_end(nx, ny, limit)
    order = np.argsort(-ends, kind="stable")
    if np.all(limit > 0):
        order = order[ends[order] > 0]  # rows in no list meet no anchor
    xk, yk, ny, ends = x.astype(kind), y[order].astype(kind), ny[order], ends[order]
    edges = np.array([0] + [b for _, b in spans])
    full = edges[np.searchsorted(edges, ends)]
    part, work = np.zeros((len(x), len(yk)), kind), 0
    done = np.zeros(len(yk), np.int64)
    alive = np.ones(part.shape, bool)
    for a, b in spans:
        listed = int(np.searchsorted(-ends, -a))  # the rows that are in the lists of these dimensions come first
        if listed:
            part[:, :listed] += xk[:, a:b] @ yk[:listed, a:b].T
            work += len(x) * listed * (b - a)
        done = np.minimum(full, b)
        alive = part.astype(np.float64) + nx[:, done] * ny[np.arange(len(yk)), done][None, :] >= limit[:, None]
        if not listed or np.count_nonzero(alive) <= SPARSE * alive.size:
            break
    xi, yi = np.nonzero(alive)
    got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))]
    for k in range(0, len(xi), SLICE):
        i, j = xi[k : k + SLICE], yi[k : k + SLICE]
        score, seen = part[i, j], done[j]
        for a, b in spans:
            rest = seen <= a
            if rest.any():
                score[rest] += (xk[i[rest], a:b] * yk[j[rest], a:b]).sum(axis=1)
                work += int(np.count_nonzero(rest)) * (b - a)
                stay = score.astype(np.float64) + np.where(rest, nx[i, b] * ny[j, b], np.inf) >= limit[i]
                i, j, score, seen = i[stay], j[stay], score[stay], seen[stay]
        good = score >= least[i]
        got.append((i[good], order[j[good]], score[good]))
    return *(np.concatenate(c) for c in zip(*got)), work


def _best(group: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's ``k`` best: high score first, then small id."""
    order = np.lexsort((ids, -scores, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g, side="left") < k]


def _answers(row: dict, same: bool, k: int) -> tuple[list[np.ndarray], int]:
    """The ``k`` best of a block for each window of a batch of anchors: (anchor, window, row_id, score), and the products computed."""
    number = lambda name: np.frombuffer(row[name], np.int64)
    anchors, ids = number("a_ids").reshape(-1, 2), number("ids")
    x, y = (np.frombuffer(row[f"{s}vectors"], f"i{row[f'{s}bits'] // 8}").reshape(n, -1).astype(np.int64) for s, n in (("a_", len(anchors)), ("", len(ids))))
    of, window, low, high = (number(f"a_{c}") for c in ("of", "window", "low", "high"))
    least = np.full(len(anchors), NO_LIMIT)
    np.minimum.at(least, of, low)
    i, j, score, work = above(x, y, least)
    fits = (anchors[i, 1] != ids[j]) & ((number("a_labels")[i] == number("labels")[j]) == same)
    i, j, score = i[fits], j[fits], score[fits]
    score = np.clip(score, -NO_LIMIT, NO_LIMIT).astype(np.int64)
    first = np.searchsorted(of, np.arange(len(anchors)))
    many = np.searchsorted(of, np.arange(len(anchors)), side="right") - first
    out = [np.zeros((4, 0), np.int64)]
    for n in range(int(many.max(initial=0))):
        w = np.minimum(first[i] + n, len(of) - 1)
        ok = (n < many[i]) & (low[w] <= score) & (score <= high[w])
        w, c, s = w[ok], j[ok], score[ok]
        best = _best(w, s, ids[c], k)
        out.append(np.stack([anchors[of[w[best]], 0], window[w[best]], ids[c[best]], s[best]]))
    return list(np.concatenate(out, axis=1)), work


def _matrix(rows: pa.Table, strongest: list[int]) -> tuple[bytes, int]:
    """The vectors as rows of equal width (short ones filled up with zeros), dimensions strongest first, in as few bits as they need."""
    vectors = rows.column("v").to_pylist()
    m = np.zeros((len(vectors), len(strongest)), np.int64)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    largest = max(int(m.max(initial=0)), -int(m.min(initial=0)))
    bits = 16 if largest < 1 << 15 else 32 if largest < 1 << 31 else 64
    return m[:, strongest].astype(f"i{bits // 8}").tobytes(), bits


def _packed(cells: list, schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([c], kinds[t]) for c, (_, t) in zip(cells, fields)], names=[n for n, _ in fields])


def _blocks(keyed: DataFrame, strongest: list[int]) -> DataFrame:
    """Rows (key, salt, id, label, v) as one row per (key, salt)."""

    def pack(key, rows):
        return _packed([key[0].as_py(), key[1].as_py(), *(rows.column(c).to_numpy().astype(np.int64).tobytes() for c in ("id", "label")), *_matrix(rows, strongest)], _BLOCK)

    return cut_lineage(keyed.groupBy("key", "salt").applyInArrow(pack, _BLOCK))


def _asking(keyed: DataFrame, strongest: list[int]) -> DataFrame:
    """Anchors (key, salt, row, id, label, v, asked: their windows) as one row per (key, salt)."""

    def pack(key, rows):
        asked = rows.column("asked").to_pylist()
        flat = [(i, w["window"], w["low"], w["high"]) for i, some in enumerate(asked) for w in some]
        names = np.stack([rows.column(c).to_numpy() for c in ("row", "id")], axis=1).astype(np.int64)
        windows = (np.array(c, np.int64).tobytes() for c in zip(*flat))
        return _packed([key[0].as_py(), key[1].as_py(), names.tobytes(), rows.column("label").to_numpy().astype(np.int64).tobytes(), *_matrix(rows, strongest), *windows], _ANCHORS)

    packed = cut_lineage(keyed.groupBy("key", "salt").applyInArrow(pack, _ANCHORS))
    return packed.select("key", F.col("salt").alias("batch"), *[F.col(c).alias(f"a_{c}") for c in packed.columns[2:]])


class _Index:
    """Blocks of all rows (row, id, label, v), by label and as they come, to be asked by anchors."""

    def __init__(self, rows: DataFrame, count: int):
        # As many rows come back as vectors have dimensions.
        squares = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("s"))
        self.strongest = [r["d"] for r in sorted(squares.collect(), key=lambda r: (-r["s"], r["d"]))]
        self.count = max(1, -(-count // ROWS))
        sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / ROWS).alias("__n"))
        place = F.xxhash64("row")
        self.by_label = _blocks(rows.join(sizes, "label").select(F.col("label").alias("key"), F.pmod(place, F.col("__n")).alias("salt"), "id", "label", "v"), self.strongest)
        self.mixed = _blocks(rows.select(F.lit(0).cast("bigint").alias("key"), F.pmod(place, F.lit(self.count).cast("bigint")).alias("salt"), "id", "label", "v"), self.strongest)

    def ask(self, anchors: DataFrame, windows: DataFrame, many: int, same: bool, k: int, pilot: bool = False) -> DataFrame:
        """(anchor, window, row_id, score, rank): the ``k`` best rows of the same or of other labels in each window (anchor, window, low, high).

        ``anchors`` has (row, id, label, v) of ``many`` anchors at most; rows with an anchor's own id are left out. A ``pilot`` asks one block only.
        """
        per = windows.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("window", "low", "high"))).alias("asked"))
        batches = max(1, -(-many // ANCHOR_ROWS))
        key = F.col("label") if same else F.lit(0).cast("bigint")
        batch = F.pmod(F.xxhash64("row"), F.lit(batches).cast("bigint"))
        asking = _asking(anchors.join(per, "row").select(key.alias("key"), batch.alias("salt"), "row", "id", "label", "v", "asked"), self.strongest)
        if same:
            pairs = asking.join(self.by_label.where("salt = 0") if pilot else self.by_label, "key")
        else:
            dealt = asking.sparkSession.range(batches * self.count).select((F.col("id") % batches).alias("batch"), F.floor(F.col("id") / batches).alias("salt"))
            pairs = dealt.join(asking, "batch").join(self.mixed, "salt")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    found, _ = _answers(row, same, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=_FOUND)

        columns = [c for c in pairs.columns if c.startswith("a_")] + ["ids", "labels", "vectors", "bits"]
        found = pairs.select(*columns).mapInArrow(run, ", ".join(f"{c} bigint" for c in _FOUND))
        rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "row_id"))
        return cut_lineage(found.withColumn("rank", rank).where(F.col("rank") <= k))


def _filled(index: _Index, anchors: DataFrame, many: int, windows: DataFrame, same: bool, k: int) -> DataFrame:
    """The ``k`` best of every window (anchor, window, steps, high): the thresholds ``steps`` are tried in turn until a window is full."""
    open_, left = cut_and_count(windows.withColumn("step", F.lit(0)), F.lit(True))
    rounds: list[DataFrame] = []
    while left:
        now = open_.select("anchor", "window", F.element_at("steps", F.col("step") + 1).alias("low"), "high")
        found = index.ask(anchors, now, min(left, many), same, k)
        full = found.groupBy("anchor", "window").agg(F.count("*").alias("__n"))
        state = open_.join(full, ["anchor", "window"], "left")
        ended = (F.coalesce("__n", F.lit(0)) >= k) | (F.col("step") + 1 >= F.size("steps"))
        rounds.append(found.join(state.where(ended).select("anchor", "window"), ["anchor", "window"], "left_semi"))
        open_, left = cut_and_count(state.where(~ended).drop("__n").withColumn("step", F.col("step") + 1), F.lit(True))
    out = None
    for some in rounds:
        out = some if out is None else out.unionByName(some)
    return out if out is not None else windows.select("anchor", "window", F.lit(0).cast("bigint").alias("row_id"), F.lit(0).cast("bigint").alias("score"), F.lit(0).alias("rank")).where("false")


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80, most_percent: int = 100, scale: int = 256,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str | Column = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives for each anchor and each of its best rows of the same label.

    Components become floor(``scale`` * x) and a score is the inner product with the
    anchor. Positives are the ``positives`` best other rows of the anchor's label; for each
    the ``negatives`` best rows of other labels with a score between ``least_percent`` and
    ``most_percent`` of its score come back (none for a negative score). Higher scores come
    first, ties by smaller id. Rows with null id, label or vector, or with a null or
    non-finite component, take no part. Vectors of different lengths are filled up with
    zeros. Rows with the anchor's id count as its own; equal anchor rows are answered once,
    different ones with one id each; repeated rows are candidates each. Extra columns are
    not read, whatever they are called. Scores beyond 62 bits are cut to that range. An
    empty table gives no rows.
    """
    mark = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), mark.cast("bigint").alias("label"), whole_numbers(embedding, scale).alias("v"), is_anchor.alias("asks"))
    rows = rows.where("id is not null and label is not null and v is not null").withColumn("row", F.monotonically_increasing_id())
    rows, count = cut_and_count(rows, F.lit(True))
    anchors, many = cut_and_count(rows.where("asks").groupBy("id", "label", "v").agg(F.min("row").alias("row")), F.lit(True))
    index = _Index(rows, count)

    # One block of the anchor's label gives thresholds: the k-th best of a part is a safe one, its better ones are tried before.
    whole = anchors.select(F.col("row").alias("anchor"), F.lit(0).cast("bigint").alias("window"), F.lit(-NO_LIMIT).alias("low"), F.lit(NO_LIMIT).alias("high"))
    seen = index.ask(anchors, whole, many, True, positives, pilot=True)
    tries = sorted({min(positives, 1 << i) for i in range(positives.bit_length() + 1)})
    some = seen.groupBy("anchor").agg(*[F.max(F.when(F.col("rank") == n, F.col("score"))).alias(f"at{n}") for n in tries])
    steps = F.filter(F.array(*[F.col(f"at{n}") for n in tries[:-1]], F.coalesce(f"at{tries[-1]}", F.lit(-NO_LIMIT))), lambda x: x.isNotNull())
    asked = whole.drop("low").join(some, "anchor", "left").select("anchor", "window", steps.alias("steps"), "high")
    best = cut_lineage(_filled(index, anchors, many, asked, True, positives))

    # Percentages of whole hundreds and of the rest, so that products stay in 64 bits.
    lowest = F.expr(f"(score div 100) * {least_percent} + (score % 100 * {least_percent} + 99) div 100")
    highest = F.expr(f"(score div 100) * {most_percent} + (score % 100 * {most_percent}) div 100")
    down = F.array(*[highest - F.floor((highest - lowest) * share).cast("bigint") for share in LOWERED])
    ranges = best.where("score >= 0").where(lowest <= highest).select("anchor", F.col("rank").cast("bigint").alias("window"), down.alias("steps"), highest.alias("high"))
    found = _filled(index, anchors, many, ranges, False, negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    known = best.select("anchor", F.col("rank").cast("bigint").alias("window"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, "anchor")
    return found.join(known, ["anchor", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
