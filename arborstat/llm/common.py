"""What the operators share: reading tables, held-out rows, packed batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are runs of anything but these six ASCII white space characters.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels must not be learnt: crc32 of the id as text leaves 1 modulo 3 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the lambdas inside use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_groups(batches: Iterable[pa.RecordBatch], column: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts add up to about ``chars`` (one longer text makes a slice of its own)."""
    for batch in batches:
        sizes = pa.compute.utf8_length(batch.column(column)).to_pylist()
        at = size = 0
        for i, n in enumerate(sizes):
            if size and size + (n or 0) > chars:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n or 0
        if at < batch.num_rows:
            yield batch.slice(at)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is run meanwhile sends Python ``rows`` rows at a time at most: a batch of texts is held several times over, none of it in memory that Spark counts."""
    given = spark.conf.get(BATCH_ROWS)
    if not 0 < int(given) <= rows:
        spark.conf.set(BATCH_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, given)


def gives_back(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, which hands free memory back to the system when a task ends: workers wait for the next task, of any stage, with all they ever took."""

    @wraps(run)
    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            del batches
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return whole


def with_columns(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *new.values()], names=[*keep, *new])


def refuse_clash(columns: list[str], outputs: Iterable[str]) -> None:
    """A ValueError that names the columns which an operator would add a second time (Spark compares names without case)."""
    there = {c.lower() for c in columns}
    clash = [o for o in outputs if o.lower() in there]
    if clash:
        raise ValueError(f"columns {clash} are there already; rename them or the outputs")


def schema_of(df: DataFrame, keep: list[str], new: str) -> str:
    """DDL of the columns ``keep`` of ``df`` followed by ``new``."""
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), new])
