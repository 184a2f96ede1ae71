"""The snapshot store: Parquet, one partition per day."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.session import read_or_empty, session_like

DAY = T.StructField("snapshot_date", T.DateType())


def write_days(
    rows: Callable[[SparkSession], DataFrame], spark: SparkSession, path: str
) -> set[datetime.date]:
    """Write whole days and tell which; days without rows are left alone.

    Replacing a day's partition makes a retry after a crash harmless. Rows of a
    file already belong to one day, so they are written where they were read:
    a shuffle by day would only gather a large day into one task. ``rows`` is
    made in a session of the write's own, as its setting is the session's.
    """
    seen = Observation()
    # A task reads files of a few days. With an open file for each of them its
    # rows need not be sorted by day first; beyond the limit Spark sorts the rest.
    own = session_like(spark, {"spark.sql.maxConcurrentOutputFileWriters": "100"})
    (
        rows(own).observe(seen, F.collect_set("snapshot_date").alias("days"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(path)
    )
    return set(seen.get["days"])


def read_store(
    spark: SparkSession, path: str, schema: T.StructType, loaded: DataFrame
) -> DataFrame:
    """The store's days that are ``loaded`` (the ledger's); a filter on ``snapshot_date`` prunes partitions.

    The ledger keeps out what a run that died before its entry left behind, and
    what is left of a day that was loaded again and has no rows now. It has a
    row per day, so it prunes partitions when the query runs.
    """
    full = T.StructType([*schema.fields, DAY])
    rows = read_or_empty(spark, full, lambda: spark.read.schema(full).parquet(path))
    days = loaded.where("NOT coalesce(no_rows, false)").select("snapshot_date").distinct()
    return rows.join(days, "snapshot_date", "left_semi").select(*(f"`{n}`" for n in full.names))


def stored_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """Snapshot columns of an existing store, ``None`` before the first load."""
    nothing = T.StructType([])
    found = read_or_empty(spark, nothing, lambda: spark.read.parquet(path)).schema
    fields = [f for f in found if f.name != DAY.name]
    return T.StructType(fields) if fields else None
