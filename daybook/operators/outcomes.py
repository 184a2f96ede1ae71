"""What happens to each calendar day: skipped, loaded or failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.constants import FAILED, LOADED, SKIPPED
from daybook.functions.naming import not_found_message

# The joins below carry no broadcast hint. The sides that hold one row per day
# are measured at run time and broadcast only if they are below the session's
# limit; otherwise they are shuffled on the file name, which is unique per day.


def pending_days(names: DataFrame, present: DataFrame) -> DataFrame:
    """Days whose snapshot is not there yet."""
    return names.join(present, "file_name", "left_anti")


def present_days(names: DataFrame, present: DataFrame) -> DataFrame:
    """Days whose snapshot is there already."""
    return names.join(present, "file_name", "left_semi")


def day_outcomes(
    names: DataFrame, loaded: DataFrame, landed: DataFrame, base_url: str
) -> DataFrame:
    """One row per day of ``names``.

    A loaded day keeps its path and is not looked at again. A pending day that
    has landed will be loaded. Any other day failed, with the reason.
    """
    loaded = loaded.select("file_name", F.col("path").alias("loaded_path"))
    is_loaded = F.col("loaded_path").isNotNull()
    landed_once = F.col("landed_path").isNotNull() & ~F.col("ambiguous")
    status = F.when(is_loaded, SKIPPED).when(landed_once, LOADED).otherwise(FAILED)
    reason = F.when(
        F.col("ambiguous"), F.lit("more than one snapshot of this name has landed")
    ).otherwise(not_found_message(F.col("file_name"), base_url))
    return (
        names.join(loaded, "file_name", "left")
        .join(landed, "file_name", "left")
        .select(
            "snapshot_date",
            "file_name",
            F.when(is_loaded, F.col("loaded_path"))
            .when(landed_once, F.col("landed_path"))
            .alias("path"),
            status.alias("status"),
            F.when(status == FAILED, reason).alias("error"),
        )
    )
