"""Readers: typed CSV, JSON documents keyed by directory, text reports, file listings.

All readers take an explicit schema, turn NaN into NULL and keep the file path at
hand where the key is part of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from arborstat.functions.numeric import clean
from arborstat.plans.selection import join_groups, select_ranks


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: clean(c) for c in floats}) if floats else df


def read_csv(spark: SparkSession, path, schema: str) -> DataFrame:
    """Typed CSV with a header; header names are checked against the schema."""
    return nan_to_null(spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path))


_RECORD = "__record"
_NUMBERS = {"tinyint", "smallint", "int", "bigint", "long", "float", "double"}


def _unreadable(fields: list[tuple[str, str]], text: Callable[[str], Column], otherwise: str) -> Column:
    """Why a record was not taken: its first field whose text is not of the type, else ``otherwise``."""
    reason = F.lit(otherwise)
    for name, kind in reversed(fields):
        what = "number" if kind in _NUMBERS or kind.startswith("decimal") else kind
        reason = F.when(text(name).isNotNull() & text(name).try_cast(kind).isNull(), F.lit(f"not a {what}: {name}")).otherwise(reason)
    return reason


def read_csv_checked(spark: SparkSession, path, schema: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Typed CSV as two tables: the rows that fit the schema, and (record, reason) of those that do not.

    A row is rejected if a field is not of its type or if there are too few or too many
    fields; nothing of it is taken. Empty fields are NULL, NaN becomes NULL. Records are
    lines; with ``header`` those that hold the column names are none.
    """
    kinds = [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema)]
    as_text = ", ".join(f"`{n}` string" for n, _ in kinds)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RECORD}
    line = F.col("value")
    lines = spark.read.text(path).where(F.trim(line) != "")
    if header:
        lines = lines.where(~F.from_csv(line, as_text).eqNullSafe(F.struct(*[F.lit(n).alias(n) for n, _ in kinds])))
    read = lines.select(line, F.from_csv(line, f"{schema}, `{_RECORD}` string", options).alias("r"))
    fits = F.col(f"r.{_RECORD}").isNull()
    texts = F.from_csv(line, as_text)
    reason = _unreadable(kinds, lambda n: texts[n], "wrong number of fields")
    return nan_to_null(read.where(fits).select("r.*").drop(_RECORD)), read.where(~fits).select(line.alias("record"), reason.alias("reason"))


def read_documents_checked(spark: SparkSession, path, fields: dict[str, str], pattern: str, key: str = "case", multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """:func:`read_documents` as two tables: documents whose fields are of their types, and (key, record, reason) of the others.

    An absent field and a null are no error. ``record`` is the text of a document that is
    no JSON, else its fields as they were read.
    """
    schema = ", ".join([*[f"`{f}` string" for f in fields], f"`{_RECORD}` string"])
    raw = spark.read.schema(schema).options(multiLine=multiline, mode="PERMISSIVE", columnNameOfCorruptRecord=_RECORD).json(path)
    text = F.coalesce(F.col(_RECORD), F.to_json(F.struct(*fields)))
    reason = F.when(F.col(_RECORD).isNotNull(), "unreadable").otherwise(_unreadable(list(fields.items()), lambda n: F.col(f"`{n}`"), ""))
    judged = raw.select(path_key(pattern).alias(key), *fields, text.alias("record"), reason.alias("reason"))
    good = judged.where("reason = ''").select(key, *[F.col(f).try_cast(t).alias(f) for f, t in fields.items()])
    return nan_to_null(good), judged.where("reason <> ''").select(key, "record", "reason")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Plan-time guard: the frame itself, or an error naming what is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Absent optional columns become NULL columns of the given type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def path_key(pattern: str, group: int = 1) -> Column:
    """Entity key taken from the file path, NULL where the pattern does not match."""
    return F.nullif(F.regexp_extract(F.col("_metadata.file_path"), pattern, group), F.lit(""))


def read_documents(
    spark: SparkSession, path, fields: dict[str, str], pattern: str, key: str = "case", multiline: bool = True, arrays: dict[str, str] | None = None,
) -> DataFrame:
    """JSON metric documents of all cases in one read, keyed by directory.

    A number may be stored as text; a case without a document has no row. ``arrays``
    are list fields given by element type.
    """
    arrays = arrays or {}
    schema = ", ".join([*[f"`{f}` string" for f in fields], *[f"`{f}` array<{t}>" for f, t in arrays.items()]])
    raw = spark.read.schema(schema).option("multiLine", multiline).json(path)
    return nan_to_null(raw.select(path_key(pattern).alias(key), *[F.col(f).try_cast(t).alias(f) for f, t in fields.items()], *arrays))


def read_reports(spark: SparkSession, path, pattern: str, key: str = "case", separator: str | None = None) -> DataFrame:
    """Text reports keyed by directory: a row per file, or with a ``separator`` a row per report of files that hold many."""
    read = spark.read.text(path, wholetext=True) if separator is None else spark.read.text(path, lineSep=separator)
    return read.select(path_key(pattern).alias(key), F.col("value").alias("body"))


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length) of every file below ``root``. Contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")
    )


def discover_entities(files: DataFrame, pattern: str, skip: tuple[str, ...] = (), key: str = "entity") -> DataFrame:
    """Entities with at least one member file, special folders left out."""
    e = files.select(F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).alias(key), "length").where(F.col(key).isNotNull())
    if skip:
        e = e.where(~F.col(key).isin(*skip))
    return e.groupBy(key).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def file_inventory(files: DataFrame) -> DataFrame:
    """Bytes and members per stem, so that a header and its raw data count together."""
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return files.groupBy(stem.alias("stem")).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def sample_positions(df: DataFrame, keys: list[str], seq: str, edge: int = 10, whole: int = 30) -> DataFrame:
    """All rows of groups up to ``whole``, else the first, middle and last ``edge``.

    The cut positions come from exact selection on ``seq`` (an integer, unique per
    key), so that a large group is filtered where it lies.
    """
    half = edge // 2
    mid = lambda n: F.floor(n / 2)
    cuts = select_ranks(df, keys, seq, {
        "__first": lambda n: F.least(F.lit(edge), n) - 1, "__last": lambda n: F.greatest(n - edge, F.lit(0)),
        "__m0": lambda n: F.greatest(mid(n) - half, F.lit(0)), "__m1": lambda n: F.least(mid(n) + half, n) - 1,
    }).select(*keys, F.col("n").alias("__n"), "__first", "__last", "__m0", "__m1")
    s = F.col(seq)
    keep = (F.col("__n") <= whole) | (s <= F.col("__first")) | (s >= F.col("__last")) | s.between(F.col("__m0"), F.col("__m1"))
    return join_groups(df, cuts, keys).where(keep).drop("__n", "__first", "__last", "__m0", "__m1")


def companion(items: DataFrame, candidates: list[DataFrame], key: str, column: str = "path") -> DataFrame:
    """First existing companion per item, in the order of ``candidates`` (each unique by key)."""
    out, found = items, []
    for i, c in enumerate(candidates):
        out = out.join(c.select(key, F.col(column).alias(f"__c{i}")), key, "left")
        found.append(f"__c{i}")
    return out.withColumn("companion", F.coalesce(*found) if len(found) > 1 else F.col(found[0])).drop(*found)


def copy_integrity(original: DataFrame, copy: DataFrame, key: str, content: str, expected_size: str | None = None) -> DataFrame:
    """Digest and size comparison of two copies, row by row on ``key``.

    ``content`` is binary or text. The digest is taken before the join, so contents
    are not moved. Checks: present in both, digest equal, size equal, size as expected.
    Keys that only the copy has are rows too.
    """
    def side(df, p, *extra):
        return df.select(key, F.md5(F.col(content).cast("binary")).alias(f"{p}_digest"), F.octet_length(F.col(content)).alias(f"{p}_size"), *extra)

    o = side(original, "original", *([F.col(expected_size).alias("expected")] if expected_size else []))
    j = o.withColumn("__o", F.lit(True)).join(side(copy, "copy").withColumn("__c", F.lit(True)), key, "full_outer")
    checks = {
        "original_present": F.col("__o").isNotNull(),
        "copy_present": F.col("__c").isNotNull(),
        "digest_equal": F.coalesce(F.col("original_digest") == F.col("copy_digest"), F.lit(False)),
        "size_equal": F.coalesce(F.col("original_size") == F.col("copy_size"), F.lit(False)),
        "size_expected": F.coalesce(F.col("copy_size") == F.col("expected"), F.lit(False)) if expected_size else F.lit(True),
    }
    j = j.withColumns(checks)
    return j.withColumn("all_checks_passed", F.col("original_present") & F.col("copy_present") & F.col("digest_equal") & F.col("size_equal") & F.col("size_expected")).drop("expected", "__o", "__c")


def read_binary(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(name, content, length) of files, for integrity checks of file copies."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    return b.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content", "length")
