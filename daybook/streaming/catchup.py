"""Catch-up as a stream: the days of every file that has landed since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from daybook.constants import FILE_SUFFIX
from daybook.feed import Feed
from daybook.functions.naming import day_in, file_name_in, lies_well
from daybook.plans.backfill import bring_in


def landing_stream(spark: SparkSession, feed: Feed, files_per_batch: int) -> DataFrame:
    """Days (snapshot_date, file_name) of the feed's files as they arrive; the bytes are not read."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .options(
            recursiveFileLookup=True,
            pathGlobFilter=f"*{FILE_SUFFIX}",
            maxFilesPerTrigger=files_per_batch,
        )
        .load(feed.landing)
    )
    name = file_name_in(F.col("path"), feed.prefix)
    return files.where(name.isNotNull()).where(lies_well(F.col("path"), feed.landing, feed.prefix)).select(
        day_in(name).alias("snapshot_date"), name.alias("file_name")
    )


def catch_up(
    spark: SparkSession, feed: Feed, progress: str, files_per_batch: int = 10_000
) -> StreamingQuery:
    """Load the days that have landed since the last run, and stop.

    ``progress`` is the query's checkpoint directory; it remembers the files
    already seen, batch by batch. Each batch's days go through the same load of
    whole days as a backfill and into the same ledger, so stream and backfill
    can be mixed in any order: a loaded day is skipped, a broken one is logged
    as failed and left to the next backfill. The stream cannot report a day
    that never lands.
    """

    def load(batch: DataFrame, number: int) -> None:
        # One row per day of the batch; the batch's own session ends with it.
        days = [tuple(r) for r in batch.distinct().collect()]
        if days:
            bring_in(spark, feed, spark.createDataFrame(days, "snapshot_date date, file_name string"))

    return (
        landing_stream(spark, feed, files_per_batch)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
