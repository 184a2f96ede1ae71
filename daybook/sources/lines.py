"""Text by lines: gzip files, and text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.functions.intask import count_runs
from daybook.functions.naming import part_number
from daybook.functions.text import line_pieces, strip
from daybook.session import broadcast_if_small


def text_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Numbered, stripped lines of a text column. No shuffle: a text is one row."""
    split = rows.select(key, line_pieces(F.col(text)).alias("pieces"))
    # Outer, as a plain explode adds a filter that would cut every text twice.
    pieces = split.select(key, (F.size("pieces") - 1).alias("last"), F.posexplode_outer("pieces"))
    no_line = F.col("pos").isNull() | ((F.col("pos") == F.col("last")) & (F.col("col") == ""))
    return pieces.where(~no_line).select(
        key, (F.col("pos") + 1).cast("bigint").alias("line_no"), strip(F.col("col")).alias("line")
    )


def lines_of_file(spark: SparkSession, path: str) -> DataFrame:
    """Numbered, stripped lines of one gzip file: ``line_no, line``.

    A gzip file is never split, so its lines are the one partition's rows and
    their ids run from 0 without a gap.
    """
    line_no = F.monotonically_increasing_id() + 1
    return spark.read.text(path).select(
        line_no.alias("line_no"), strip(F.col("value")).alias("line")
    )


def lines_of_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines of many gzip files, numbered per file: ``file_path, line_no, line``.

    One task sees all lines of a file in order and counts them as they pass,
    so there is no shuffle and no sort, however large the file.
    """
    raw = spark.read.options(pathGlobFilter="*.gz", recursiveFileLookup=True).text(list(paths))
    path = F.col("_metadata.file_path")
    # Row order matters to the counter: nondeterministic keeps filters above it.
    number = F.arrow_udf(count_runs, "bigint").asNondeterministic()
    return raw.select(
        path.alias("file_path"),
        number(F.xxhash64(path)).alias("line_no"),
        strip(F.col("value")).alias("line"),
    )


def lines_across_parts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines with one numbering per directory of part files: ``folder, line_no, line``.

    Each part starts where the parts before it end. What moves is one count
    per part; the lines themselves stay where they were read.
    """
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]+$", 1)
    raw = spark.read.options(pathGlobFilter="*.gz", recursiveFileLookup=True).text(list(paths))
    counts = raw.groupBy(F.col("_metadata.file_path").alias("file_path")).count()
    order = Window.partitionBy(folder).orderBy(part_number(F.col("file_path")), "file_path")
    before = F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        "file_path", folder.alias("folder"), F.coalesce(before, F.lit(0)).alias("before")
    )
    return (
        lines_of_files(spark, paths)
        .join(broadcast_if_small(offsets), "file_path")
        .select("folder", (F.col("line_no") + F.col("before")).alias("line_no"), "line")
    )
