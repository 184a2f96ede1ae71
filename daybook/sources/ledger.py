"""The ledger: append-only outcome rows, the record of which days are present."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.constants import LOADED
from daybook.session import read_or_empty

OUTCOME = "snapshot_date date, file_name string, path string, status string, error string"
# ``no_rows`` marks a loaded day whose file has a header and nothing else.
LEDGER = f"{OUTCOME}, no_rows boolean, run string"


def append_outcomes(outcomes: DataFrame, path: str, run: str) -> None:
    """Add what a run did, days that were skipped left out. A small row per calendar day, so one file."""
    (
        outcomes.withColumn("run", F.lit(run))
        .coalesce(1)
        .write.mode("append")
        .partitionBy("run")
        .parquet(path)
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, LEDGER, lambda: spark.read.schema(LEDGER).parquet(path))


def loaded_days(ledger: DataFrame) -> DataFrame:
    """One row per present day: ``file_name, snapshot_date, path, no_rows`` of its latest load."""
    return (
        ledger.where(F.col("status") == LOADED)
        .groupBy("file_name", "snapshot_date")
        .agg(F.max_by("path", "run").alias("path"), F.max_by("no_rows", "run").alias("no_rows"))
    )
