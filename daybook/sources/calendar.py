"""The calendar: one row per day of a closed range."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.constants import EARLIEST_DAY


def days_between(bounds: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every day from ``start`` to ``end``, both included; none if reversed."""
    # The guard sits inside explode: sequence() itself raises on a reversed range.
    days = F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day")))
    return bounds.select(F.explode(days).alias("snapshot_date"))


def calendar(
    spark: SparkSession,
    start: datetime.date = EARLIEST_DAY,
    end: datetime.date | None = None,
) -> DataFrame:
    """Days from ``start`` to ``end``; ``end`` defaults to today in the session zone."""
    last = F.current_date() if end is None else F.lit(end)
    return days_between(spark.range(1), F.lit(start), last)


def observed_days(rows: DataFrame, at: str) -> DataFrame:
    """Distinct days on which ``rows`` has data. Reduced per task before the shuffle."""
    return rows.select(F.col(at).cast("date").alias("snapshot_date")).distinct()


def spanned_days(days: DataFrame) -> DataFrame:
    """The calendar from the first to the last of ``days``."""
    bounds = days.agg(
        F.min("snapshot_date").alias("first"), F.max("snapshot_date").alias("last")
    )
    return days_between(bounds, F.col("first"), F.col("last"))
