"""Columns that turn a day into its names, and names back into a day."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.constants import DAY_PATTERN, FILE_SUFFIX, NOT_FOUND_TEXT


def day_key(day: Column) -> Column:
    """ISO text of a date."""
    return day.cast("date").cast("string")


def file_name(day: Column, prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}-"), day_key(day), F.lit(FILE_SUFFIX))


def address(name: Column, base_url: str) -> Column:
    return F.concat(F.lit(base_url.rstrip("/") + "/"), name)


def local_path(name: Column, folder: str) -> Column:
    return F.concat(F.lit(folder if folder.endswith("/") else folder + "/"), name)


def with_names(days: DataFrame, prefix: str, day: str = "snapshot_date") -> DataFrame:
    """Days plus the name their file is known by."""
    return days.select(day, file_name(F.col(day), prefix).alias("file_name"))


# Folders a day may lie in below the landing directory: none, its year, its month or its day.
DATE_FOLDERS = ("", "yyyy/", "yyyy/MM/", "yyyy/MM/dd/")


def lies_well(path: Column, landing: str, prefix: str) -> Column:
    """Whether a path is a snapshot's, or that of a part, where one of ``landing`` may lie.

    One rule for the listing, the check, the backfill and the stream: below the
    landing directory come at most the folders of the day's own year, month and
    day, then the snapshot.
    """
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", landing).strip("/")
    pattern = (rf"(?:^|/){re.escape(root)}/((?:\d{{4}}/(?:\d{{2}}/(?:\d{{2}}/)?)?)?)"
               rf"(?:file_name=)?{_named_part(prefix)}(?:/[^/]+)?$")
    folders = F.date_format(day_in(path), DATE_FOLDERS[-1])
    return path.rlike(pattern) & folders.startswith(F.regexp_extract(path, pattern, 1))


# A file inside a snapshot's directory is a part of it, whatever the file is called.
_BEFORE_NAME = rf"(?:^|(?<!{re.escape(FILE_SUFFIX)})[/=])"


def _named_part(prefix: str) -> str:
    return f"{re.escape(prefix)}-{DAY_PATTERN}{re.escape(FILE_SUFFIX)}"


def file_name_in(path: Column, prefix: str) -> Column:
    """The snapshot name inside a path, null where there is none.

    A day is either one file of that name, or a directory of part files with
    that name (also ``file_name=<name>``, as a partitioned write makes it).
    """
    found = F.regexp_extract(path, rf"{_BEFORE_NAME}({_named_part(prefix)})(?:/[^/]+)?$", 1)
    return F.nullif(found, F.lit(""))


def day_path(path: Column, prefix: str) -> Column:
    """The path cut after the snapshot name: the file, or the directory of parts."""
    pattern = rf"^(.*(?<!{re.escape(FILE_SUFFIX)})[/=]{_named_part(prefix)})(?:/[^/]+)?$"
    return F.regexp_extract(path, pattern, 1)


def day_in(path: Column) -> Column:
    """The date in a snapshot's name or path, null where there is none."""
    pattern = rf"({DAY_PATTERN}){re.escape(FILE_SUFFIX)}(?:/[^/]+)?$"
    return F.regexp_extract(path, pattern, 1).try_cast("date")


def scanned_day() -> Column:
    """The date in the name of the snapshot a row was read from.

    Evaluated for every row, so plain string functions try first: the pattern
    of ``day_in`` on a path column doubles the time of a load.
    """
    file = F.input_file_name()
    name = F.substring_index(F.substring_index(file, "/", -2), FILE_SUFFIX, 1)
    return F.coalesce(F.right(name, F.lit(10)).try_cast("date"), day_in(file))


def not_found_message(name: Column, base_url: str) -> Column:
    return F.concat(F.lit(NOT_FOUND_TEXT), address(name, base_url))


def http_code(error: Column) -> Column:
    """Leading three digits of an error text, null where it has none."""
    return F.regexp_extract(error, r"^(\d{3})", 1).try_cast("int")


def part_number(path: Column) -> Column:
    """Number of a ``part-<n>`` file, so that part 100000 follows part 99999."""
    return F.regexp_extract(path, r"/part-(\d+)[^/]*$", 1).try_cast("bigint")
