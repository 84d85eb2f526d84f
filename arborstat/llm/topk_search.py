"""Exact top-k inner products by a three-phase uniform threshold.

The components of the vectors are split into a few lists; a score is the sum of its parts
from the lists. Phase one takes each list's best entries and scores them; the k-th best
score so found is a safe cutoff, since the true one cannot be lower. Phase two collects
the entries whose part reaches the cutoff divided by the number of lists: whoever has no
such part stays below the cutoff. Phase three drops those whose upper bound is too low and
resolves the scores of the rest exactly.

Queries and candidates are packed into blocks; each pair of blocks is one row of work.
Cutoffs travel with the query blocks, so nothing grows on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from arborstat.session import cut_and_count, cut_lineage, release

LISTS = 4
QUERY_ROWS, CANDIDATE_ROWS = 512, 4096
LOWEST = -(1 << 63)
_PACKED = "block bigint, ids binary, cuts binary, width int, vectors binary"


def whole_numbers(vectors: str, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector or a component is null or not finite."""
    fit = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fit, F.transform(vectors, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")))


def _pack(key, rows):
    """One block: ids and cutoffs as 64-bit integers, and the vectors as rows of equal width (short ones filled up with zeros)."""
    vectors = rows.column("v").to_pylist()
    width = max(map(len, vectors), default=0)
    m = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    ids, cuts = (rows.column(c).to_numpy().astype(np.int64).tobytes() for c in ("id", "cut"))
    return pa.table([[key[0].as_py()], [ids], [cuts], [width], [m.tobytes()]], schema=pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("cuts", pa.binary()), ("width", pa.int32()), ("vectors", pa.binary())]))


def _packed(rows: DataFrame, count: int, size: int) -> tuple[DataFrame, int]:
    blocks = max(1, -(-count // size))
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(blocks)))
    return cut_lineage(keyed.groupBy("block").applyInArrow(_pack, _PACKED)), blocks


def _pairs(queries: tuple[DataFrame, int], candidates: tuple[DataFrame, int]) -> DataFrame:
    """A row per pair of blocks."""
    (q, nq), (c, nc) = queries, candidates
    both = q.sparkSession.range(nq * nc).select((F.col("id") % nq).alias("qb"), F.floor(F.col("id") / nq).alias("cb"))
    left = q.select(F.col("block").alias("qb"), *[F.col(x).alias(f"q_{x}") for x in ("ids", "cuts", "width", "vectors")])
    right = c.select(F.col("block").alias("cb"), *[F.col(x).alias(f"c_{x}") for x in ("ids", "width", "vectors")])
    return both.join(left, "qb").join(right, "cb").drop("qb", "cb")


def _parts(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Inner products by list. In doubles where they are exact, else in unlimited integers."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    largest = [max(int(x.max()), -int(x.min())) if x.size else 0 for x in (q, c)]
    kind = np.float64 if largest[0] * largest[1] * max(1, width) < 2**52 else object
    return [q[:, g::LISTS].astype(kind) @ c[:, g::LISTS].astype(kind).T for g in range(LISTS)]


def _top(at: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of the entries ``at`` (query, candidate) the numbers of each query's ``k`` best: high score first, then small id."""
    order = np.lexsort((ids[at[1]], -scores, at[0]))
    q = at[0][order]
    first = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - first < k]


def _scored(pairs: DataFrame, k: int, refined: bool) -> DataFrame:
    """(query_id, vec_id, score) of each pair of blocks: phase one, or with cutoffs phases two and three."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qi, ci, cut = (np.frombuffer(row[n], np.int64) for n in ("q_ids", "c_ids", "q_cuts"))
                parts = _parts(*(np.frombuffer(row[f"{s}_vectors"], np.int64).reshape(len(i), row[f"{s}_width"]) for s, i in (("q", qi), ("c", ci))))
                own = qi[:, None] == ci[None, :]
                if refined:
                    # Parts that reach cutoff / LISTS are collected; the others are below it.
                    cutoff = cut.astype(parts[0].dtype)[:, None]
                    seen = [LISTS * p >= cutoff for p in parts]
                    bound = sum(np.where(s, LISTS * p, cutoff) for s, p in zip(seen, parts))
                    at = np.nonzero(np.logical_or.reduce(seen) & (bound >= LISTS * cutoff) & ~own)
                else:
                    some = np.zeros(own.shape, bool)
                    take = min(k, len(ci))
                    for p in parts:
                        # Rows with the query's own id, however many, take no other's place.
                        best = np.argpartition(-np.where(own, LOWEST, p), take - 1, axis=1)[:, :take] if take else np.zeros((len(qi), 0), np.int64)
                        np.put_along_axis(some, best, True, axis=1)
                    at = np.nonzero(some & ~own)
                scores = sum(p[at] for p in parts)
                if refined:
                    good = scores >= cutoff[at[0], 0]
                    at, scores = (at[0][good], at[1][good]), scores[good]
                scores = np.clip(scores, LOWEST + 1, (1 << 63) - 1).astype(np.int64) if len(scores) and scores.dtype == object else np.asarray(scores, np.int64)
                best = _top(at, scores, ci, k)
                yield pa.RecordBatch.from_arrays([pa.array(qi[at[0][best]]), pa.array(ci[at[1][best]]), pa.array(scores[best])], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query with all rows but its own.

    Components become floor(``scale`` * x). Ties go to the smaller vec_id; a query with
    fewer candidates gets all. Vectors that are null or hold a null or non-finite component,
    and rows without vec_id, take no part. Vectors of different lengths are filled up with
    zeros. Rows with the query's id count as its own; repeated rows are candidates each,
    repeated queries are answered once. Scores beyond 64 bits are cut to the range. An
    empty table gives no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), is_query.alias("query"), whole_numbers(embedding, scale).alias("v")).where("id is not null and v is not null")
    rows, count = cut_and_count(rows, F.lit(True))
    asked, n = cut_and_count(rows.where("query").select("id", "v").distinct(), F.lit(True))
    candidates = _packed(rows.select("id", F.lit(0).cast("bigint").alias("cut"), "v"), count, CANDIDATE_ROWS)
    plain = _packed(asked.select("id", F.lit(0).cast("bigint").alias("cut"), "v"), n, QUERY_ROWS)
    first = cut_lineage(_best(_scored(_pairs(plain, candidates), k, False), k))
    cutoffs = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cut"))
    # Fewer than k found: there are no more candidates, phase one has them all.
    bounded = asked.join(cutoffs, "id").select("id", "cut", "v")
    tightened = _packed(bounded, n, QUERY_ROWS)
    release(rows, asked, plain[0])
    second = _best(_scored(_pairs(tightened, candidates), k, True), k)
    few = first.join(cutoffs.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    columns = ["query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"]
    return second.select(*columns).unionByName(few.select(*columns))
