"""Look at one day's snapshot as it landed."""

from __future__ import annotations

import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.constants import FILE_SUFFIX, PREVIEW_ROWS
from daybook.feed import Feed
from daybook.functions.naming import part_number
from daybook.functions.text import line_label
from daybook.operators.preview import first_of_part
from daybook.plans.backfill import read_feed, snapshot_schema
from daybook.session import settle
from daybook.sources.landing import landing_files
from daybook.sources.lines import lines_across_parts, lines_of_file


class Inspection(NamedTuple):
    lines: DataFrame
    preview: DataFrame


def inspect_snapshot(
    spark: SparkSession, feed: Feed, day: datetime.date, n: int = PREVIEW_ROWS
) -> Inspection:
    """All numbered lines of the day's text, and its first ``n`` rows as a table.

    The lines are not sorted: their numbers say where they belong.
    """
    parts = _parts(spark, feed, day)
    path, file = parts.select("path", "file_path").first()
    if path == file:
        lines = lines_of_file(spark, path)
    else:
        lines = lines_across_parts(spark, [path])
    label = line_label(F.col("line_no"), F.col("line"))
    return Inspection(
        lines.select("line_no", "line", label.alias("label")), _preview(spark, feed, parts, n)
    )


def preview_snapshot(
    spark: SparkSession, feed: Feed, day: datetime.date, n: int = PREVIEW_ROWS
) -> DataFrame:
    """The first ``n`` rows of the day's snapshot, in file order."""
    return _preview(spark, feed, _parts(spark, feed, day), n)


def _parts(spark: SparkSession, feed: Feed, day: datetime.date) -> DataFrame:
    """Files of the day in their order; one unless the day is a directory of parts."""
    name = f"{feed.prefix}-{day.isoformat()}{FILE_SUFFIX}"
    found = landing_files(spark, feed.landing, feed.prefix, [name])
    if found.isEmpty():
        raise FileNotFoundError(f"{name} has not landed in {feed.landing}")
    return found.orderBy(part_number(F.col("file_path")), "file_path")


def _preview(spark: SparkSession, feed: Feed, parts: DataFrame, n: int) -> DataFrame:
    """Rows of the parts in order, each read once and only as far as rows are missing.

    A part is a gzip file and so one partition in file order, whose reading stops
    at the limit. Types are the feed's or the store's, else those that all of the
    day's cells allow, as the load has them.
    """
    paths = [r.file_path for r in parts.collect()]
    schema = snapshot_schema(spark, feed, paths)
    found, missing = None, n
    for path in paths:
        rows = settle(first_of_part(read_feed(spark, feed, schema, [path]), missing))
        found = rows if found is None else found.union(rows)
        missing -= rows.count()
        if missing <= 0:
            break
    return found
