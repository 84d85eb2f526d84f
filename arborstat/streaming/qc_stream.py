"""Quality checks over arriving metric documents.

The checks of a case need nothing but its own row, so the batch operator runs
unchanged on a stream. State is kept only to drop documents that are sent again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from arborstat.operators.rules import qc_batch


def stream_cases(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def first_sent(cases: DataFrame, key: str, sent: str, within: str) -> DataFrame:
    """The first document of each key; what comes again up to ``within`` after it (event time ``sent``) is dropped.

    Keys are forgotten when the watermark passes, so state is bounded by what arrives in
    that time. Documents sent longer than ``within`` before the newest one of an earlier
    batch are late and dropped as well.
    """
    return cases.withWatermark(sent, within).dropDuplicatesWithinWatermark([key])


def start_qc(
    cases: DataFrame, key: str, metrics: dict[str, str], present: Column, output: str, checkpoint: str, zero_if_missing: tuple[str, ...] = (),
) -> StreamingQuery:
    """Append the QC summary of every new case as parquet; runs through what is there and stops.

    Started again with the same ``checkpoint`` it goes on with files that came since;
    pass ``cases`` through :func:`first_sent` where documents may come again.
    """
    return (
        qc_batch(cases, key, metrics, present, zero_if_missing).writeStream.format("parquet").outputMode("append")
        .option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
