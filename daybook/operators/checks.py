"""Checks on loaded days and on the error log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.naming import day_key, file_name_in, http_code


def daily_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("rows"))


def sample_rows(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """The same rows every time: those whose key's md5 starts with ``prefix``."""
    return rows.where(F.md5(F.col(key).cast("string")).startswith(prefix))


def day_content(rows: DataFrame, columns: Sequence[str], by: str = "snapshot_date") -> DataFrame:
    """Row count, flagged rows and a checksum per day, whatever the row order.

    One row per day leaves each task, so a day holding most of the data is
    still reduced where it is read.
    """
    flagged = F.col("flagged") if "flagged" in rows.columns else F.lit(False)
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(flagged).alias("flagged"),
        F.sum(_row_number_hash(columns)).alias("checksum"),
    )


def _row_number_hash(columns: Sequence[str]) -> Column:
    # Null and not-null cells hash alike in places, so nullness is hashed too.
    cells = [F.col(f"`{c}`") for c in columns]
    nulls = [F.col(f"`{c}`").isNull() for c in columns]
    return F.xxhash64(*cells, *nulls).cast("decimal(20,0)")


def compare_days(landing: DataFrame, store: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Landing against store, day by day; days missing on one side show as null."""
    left = day_content(landing, columns).select(
        "snapshot_date",
        F.col("rows").alias("landing_rows"),
        F.col("flagged").alias("flagged_rows"),
        F.col("checksum").alias("landing_checksum"),
    )
    right = day_content(store, columns).select(
        "snapshot_date",
        F.col("rows").alias("store_rows"),
        F.col("checksum").alias("store_checksum"),
    )
    same = (F.col("landing_rows") == F.col("store_rows")) & (
        F.col("landing_checksum") == F.col("store_checksum")
    )
    return left.join(right, "snapshot_date", "full").select(
        "snapshot_date",
        "landing_rows",
        "store_rows",
        "flagged_rows",
        F.coalesce(same, F.lit(False)).alias("same_content"),
    )


def readable_days(checked: DataFrame, prefix: str) -> DataFrame:
    """File checks per day: parts, unreadable parts, lines of the others."""
    return checked.groupBy(
        file_name_in(F.col("file_path"), prefix).alias("file_name")
    ).agg(
        F.count(F.lit(1)).alias("parts"),
        F.count("error").alias("unreadable_parts"),
        F.sum("lines").alias("lines"),
        F.min("error").alias("error"),
    )


def error_summary(log: DataFrame, present: DataFrame, order: str = "run") -> DataFrame:
    """Per failed day: attempts, first and last position, last code, still missing?"""
    days = log.groupBy("date").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.min(order).alias("first_seen"),
        F.max(order).alias("last_seen"),
        F.max_by("error", order).alias("last_error"),
    )
    here = present.select(
        day_key(F.col("snapshot_date")).alias("date"), F.lit(True).alias("present")
    ).distinct()
    return days.join(here, "date", "left").select(
        "date",
        "attempts",
        "first_seen",
        "last_seen",
        http_code(F.col("last_error")).alias("http_code"),
        F.col("present").isNull().alias("still_pending"),
    )
