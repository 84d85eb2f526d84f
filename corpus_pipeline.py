"""From raw documents to encoded training text: five stages over whole tables.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of
``documents``. A null or empty text has no letter, so the first stage takes it out; extra
columns are carried along; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborstat.llm import bpe, jaccard_join, language_crf, mixing, secrets
from arborstat.llm.common import held_out, short_batches, table, whole_text
from arborstat.llm.queries import tokenizer_path
from arborstat.session import cut_lineage, release

#: The best of L mean marginals is 1/L at least; a text whose best one covers less of the rest up to 1 counts as being in no language.
LEAST_LANGUAGE = 0.05
#: No source is read more than so many times as often as another.
MOST_REPEATS = 1.25
#: Pieces and words whose ids an encoding task remembers: an executor's workers hold them beside a heap that the stages before have filled.
REMEMBERED = 100_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts without letters and texts of no language go.

    Written here, as texts go to Python in short batches only while that is set.
    """
    with short_batches(spark):
        return cut_lineage(_known(docs))


def _known(docs: DataFrame) -> DataFrame:
    model = language_crf.train(docs, ~held_out())
    marked = language_crf.predict(docs.withColumn("__kept", F.col("text")), model, text="__kept", keep=docs.columns, outputs=("__lang", "__score"))
    least = 1 / max(len(model.langs), 1)
    known = (F.col("__lang") != language_crf.UNKNOWN) & (F.col("__score") >= least + LEAST_LANGUAGE * (1 - least))
    return marked.where(known).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 5-word shingles at 0.8 or more: by smallest doc_id, then by a digest of the row.

    Rows are judged by their own texts: those that repeat a doc_id or have none take part
    as all others, and rows without doc_id stay where none of their group has one. Rows
    without words stay.
    """
    _, roots = jaccard_join.linked(docs, "doc_id", "text", n=5, percent=80, key=docs.columns, without_id=True)
    stay = cut_lineage(roots.select(F.col("root.a").alias("__a"), F.col("root.b").alias("__b")).distinct())
    a, b = jaccard_join.row_key(docs.columns)
    words = whole_text().rlike(r"[^\x20\x09-\x0D]")
    kept = docs.where(words).withColumns({"__a": a, "__b": b}).dropDuplicates(["__a", "__b"]).join(stay, ["__a", "__b"], "left_semi")
    return kept.select(*docs.columns).unionByName(docs.where(~words))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; n_chars follows."""
    found = secrets.scan(docs, spans="__spans")
    clean = found.withColumn("text", F.when(F.size("__spans") > 0, secrets.redact("text", "__spans")).otherwise(F.col("text")))
    return clean.withColumn("n_chars", F.when(F.size("__spans") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources as even as the repetition limit allows; no document is left out, those of small sources may repeat.

    The table is written in the order of the mix.
    """
    mixed = mixing.mix(docs, max_repeats=MOST_REPEATS, budget="cover", outputs=("__epoch", "__order"))
    return mixing.in_order(mixed.select(*docs.columns, "__order"), order="__order").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (packed little-endian 32-bit integers), and whether decoding gives the text back.

    Rows stay in the order of the table that the mix wrote: its files by name, as Spark reads them by size.
    """
    docs = docs.orderBy(F.input_file_name(), F.monotonically_increasing_id())
    summed = docs.withColumn("__sum", F.md5(F.col("text").cast("binary")))
    both = bpe.encode(summed, tokenizer_path(), keep=["doc_id", "lang", "source", "__sum"], decoded=True, remembered=REMEMBERED)
    return both.select("doc_id", "lang", "source", "n_tokens", "ids", (F.md5(F.col("decoded").cast("binary")) == F.col("__sum")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("bpe_encode", encode),
]

#: The language model cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as a table before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = cut_lineage(made)
        release(made)
    return STAGES[-1][1](spark, docs, sf_dir)
