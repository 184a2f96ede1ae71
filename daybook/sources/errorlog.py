"""The error log: JSON with exactly the keys ``date`` and ``error``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.naming import day_key
from daybook.session import read_or_empty

ENTRY = "date string, error string"
LOG = f"{ENTRY}, run string"
ARRAY = f"position bigint, {ENTRY}, unparsed string"


def error_entries(failed: DataFrame) -> DataFrame:
    """Log entries for failed days."""
    return failed.select(day_key(F.col("snapshot_date")).alias("date"), "error")


def append_errors(entries: DataFrame, path: str, run: str) -> None:
    """Add the entries of one run, days in order, below a directory of that run.

    At most one entry per calendar day. Nothing is read back or rewritten.
    """
    (
        entries.withColumn("run", F.lit(run))
        .coalesce(1)
        .sortWithinPartitions("run", "date")
        .write.mode("append")
        .partitionBy("run")
        .json(path)
    )


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """All entries with the run that wrote them; none if the log does not exist yet."""
    return read_or_empty(spark, LOG, lambda: spark.read.schema(LOG).json(path))


def read_error_array(spark: SparkSession, path: str) -> DataFrame:
    """A log kept as one JSON array: entries with their 1-based position.

    Text that does not parse comes back in ``unparsed`` instead of being lost.
    """

    def load() -> DataFrame:
        schema = f"{ENTRY}, unparsed string"
        rows = (
            spark.read.schema(schema)
            .options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="unparsed")
            .json(path)
        )
        # One array is one task's work, so its ids run from 0 without a gap.
        position = F.monotonically_increasing_id() + 1
        return rows.select(position.alias("position"), "date", "error", "unparsed")

    return read_or_empty(spark, ARRAY, load)


def import_error_array(spark: SparkSession, array_path: str, log_path: str, run: str) -> None:
    """Carry an array log over into the append-only log, duplicates and order kept.

    A log that does not parse raises: its history is not to be lost silently.
    """
    entries = read_error_array(spark, array_path)
    broken = entries.where(F.col("unparsed").isNotNull()).first()
    if broken is not None:
        raise ValueError(f"{array_path} does not parse: {broken.unparsed[:80]}")
    (
        entries.select("position", "date", "error", F.lit(run).alias("run"))
        .sortWithinPartitions("run", "position")
        .drop("position")
        .write.mode("append")
        .partitionBy("run")
        .json(log_path)
    )
