"""Snapshot files as tables: header CSV, gzip, pandas' idea of missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from daybook.constants import FILE_SUFFIX, NULL_TOKENS
from daybook.functions.naming import part_number, scanned_day
from daybook.functions.text import present

CORRUPT = "_corrupt_record"

# What counts as a number. A cast alone is too generous, as it takes "1d", and
# one that fails is slow; these patterns keep it to cells that will pass.
_INTEGER = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$|^\s*[+-]?inf(inity)?\s*$"
_BOOLEAN = ("True", "TRUE", "true", "False", "FALSE", "false")


def csv_options(comment: str | None) -> dict:
    options = {
        "header": True,
        "escape": '"',
        "multiLine": True,
        "mode": "PERMISSIVE",
        "pathGlobFilter": f"*{FILE_SUFFIX}",
        "recursiveFileLookup": True,
    }
    return options | ({"comment": comment} if comment else {})


def csv_cells(
    reader: DataFrameReader | DataStreamReader,
    schema: T.StructType,
    comment: str | None = None,
    match_header: bool = True,
) -> DataFrameReader | DataStreamReader:
    """A reader set to give every cell as text, and broken rows in ``CORRUPT``."""
    cells = [T.StructField(f.name, T.StringType()) for f in schema]
    return reader.options(
        **csv_options(comment),
        enforceSchema=not match_header,
        columnNameOfCorruptRecord=CORRUPT,
    ).schema(T.StructType([*cells, T.StructField(CORRUPT, T.StringType())]))


def typed_columns(schema: T.StructType, null_tokens: Sequence[str] = NULL_TOKENS) -> list[Column]:
    """The caller's columns, ``snapshot_date`` and ``flagged`` from text cells."""
    tokens = [F.lit(token) for token in null_tokens]
    columns, flagged = [], F.col(CORRUPT).isNotNull()
    for field in schema:
        value = present(F.col(f"`{field.name}`"), tokens)
        if field.dataType != T.StringType():
            text, value = value, value.try_cast(field.dataType)
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                # A cast takes "1d" and "2f" for numbers.
                suffixed = F.lower(F.right(text, F.lit(1))).isin("d", "f")
                value = F.when(~suffixed | (F.lower(F.right(text, F.lit(3))) == "inf"), value)
            flagged |= text.isNotNull() & value.isNull()
        columns.append(value.alias(field.name))
    return [*columns, scanned_day().alias("snapshot_date"), flagged.alias("flagged")]


def read_snapshots(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType,
    null_tokens: Sequence[str] = NULL_TOKENS,
    comment: str | None = None,
    match_header: bool = True,
    positions: bool = False,
) -> DataFrame:
    """The snapshots at ``paths`` with the caller's columns and types.

    Adds ``snapshot_date`` from the file name, and ``flagged`` for a row with
    too many or too few fields or a cell that is not of its type. With
    ``positions`` also ``part`` and ``pos``, which sort in file order.
    """
    raw = csv_cells(spark.read, schema, comment, match_header).csv(list(paths))
    columns = typed_columns(schema, null_tokens)
    if positions:
        path = F.col("_metadata.file_path")
        part = F.struct(part_number(path).alias("number"), path.alias("path"))
        columns += [part.alias("part"), F.monotonically_increasing_id().alias("pos")]
    return raw.select(*columns)


def infer_schema(
    spark: SparkSession,
    paths: Sequence[str],
    null_tokens: Sequence[str] = NULL_TOKENS,
    comment: str | None = None,
) -> T.StructType:
    """Column names from the header, column types from every cell.

    One pass that ends in one row: whole numbers, numbers, true/false, else text.
    Dates stay text and a column without any value is a number, as in pandas;
    missing cells do not turn whole numbers or true/false into something else.
    """
    raw = spark.read.options(**csv_options(comment)).csv(list(paths))
    tokens = [F.lit(token) for token in null_tokens]
    kinds = raw.select(*[_kind(F.col(f"`{c}`"), tokens).alias(c) for c in raw.columns])
    cells = [F.col(f"`{c}`") for c in raw.columns]
    spans = kinds.agg(*[F.struct(F.min(c), F.max(c)) for c in cells]).first()
    return T.StructType(
        [T.StructField(c, _column_type(*span)) for c, span in zip(raw.columns, spans)]
    )


# What one cell could be. A whole number is a number, so their order matters.
_WHOLE, _DECIMAL, _TRUTH, _TEXT = range(4)


def _kind(cell: Column, tokens: Sequence[Column]) -> Column:
    value = present(cell, tokens)
    return (
        F.when(value.isNull(), F.lit(None))
        .when(value.rlike(_INTEGER) & value.try_cast("bigint").isNotNull(), _WHOLE)
        .when(value.rlike(_NUMBER), _DECIMAL)
        .when(value.isin(*_BOOLEAN), _TRUTH)
        .otherwise(_TEXT)
    )


def _column_type(low: int | None, high: int | None) -> T.DataType:
    """The type that holds every kind between the lowest and the highest seen."""
    if high is None or high == _DECIMAL:
        return T.DoubleType()
    if high == _WHOLE:
        return T.LongType()
    return T.BooleanType() if low == high == _TRUTH else T.StringType()
