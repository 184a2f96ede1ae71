"""The landing directory: which snapshot files are there, and are they readable."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.constants import FILE_SUFFIX
from daybook.functions.intask import check_raw
from daybook.functions.naming import day_in, day_path, file_name_in, lies_well
from daybook.session import read_or_empty

FILE_SCHEMA = "file_name string, snapshot_date date, path string, file_path string, length bigint"
CHECK_SCHEMA = "uri string, error string, header array<string>, lines bigint, bytes bigint"

# Files as they are, in pieces: Hadoop's codec that takes a suffix as not compressed. Its
# setting has another name in builds that Spark bundles.
AS_THEY_ARE = {
    "io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
    "io.compress.passthrough.extension": ".gz",
    "org.apache.hadoop.shaded.io.compress.passthrough.extension": ".gz",
}

# Tasks that list files; they do not read them, so the size of the files is no measure.
LISTING_TASKS = 64


def landing_files(
    spark: SparkSession, folder: str, prefix: str, names: Sequence[str] | None = None
) -> DataFrame:
    """One row per file of a snapshot; the bytes are not read.

    A snapshot lies in the folder itself or below it by year, month or day, see
    ``lies_well``. With ``names`` the folder is listed once, and of those below
    it the ones of the named days, so years of older days cost next to nothing.
    """
    if names is not None and not names:
        return spark.createDataFrame([], FILE_SCHEMA)
    path = folder.rstrip("/")
    if names is not None:
        path = f"{path}/{{{','.join(_date_folders(names))}}}{{,file_name=}}{{{','.join(names)}}}"

    def load() -> DataFrame:
        found = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", f"*{FILE_SUFFIX}")
            .option("recursiveFileLookup", True)
            .load(path)
        )
        # A filter on file metadata drops other files before tasks are planned.
        name = file_name_in(F.col("_metadata.file_path"), prefix)
        here = found.where(name.isNotNull()).where(lies_well(F.col("path"), folder, prefix))
        return here.coalesce(LISTING_TASKS).select(
            name.alias("file_name"),
            day_in(name).alias("snapshot_date"),
            day_path(F.col("path"), prefix).alias("path"),
            F.col("path").alias("file_path"),
            "length",
        )

    return read_or_empty(spark, FILE_SCHEMA, load)


def _date_folders(names: Sequence[str]) -> list[str]:
    days = {datetime.date.fromisoformat(name.removesuffix(FILE_SUFFIX)[-10:]) for name in names}
    folders = {"", *(f"{d:%Y}/" for d in days), *(f"{d:%Y/%m}/" for d in days), *(f"{d:%Y/%m/%d}/" for d in days)}
    return sorted(folders)


def landed_days(files: DataFrame) -> DataFrame:
    """One row per snapshot: where it lies, and in how many places.

    The sum per name is taken inside each task first, so a day of very many
    part files costs no more than a day of one.
    """
    return files.groupBy("file_name").agg(
        F.min("path").alias("landed_path"),
        (F.min("path") != F.max("path")).alias("ambiguous"),
        F.sum("length").alias("bytes"),
    )


def check_files(
    spark: SparkSession, paths: Sequence[str], comment: str | None = None
) -> DataFrame:
    """Decompress every file to its end; one row per file, ``error`` null if sound.

    ``lines`` are what line feeds separate, and ``bytes`` those of the lines. A
    file is sound if it consists of whole gzip members and nothing else, as the
    load has it. Its bytes stream through one task, whatever its size; if they
    cannot be had, that is no verdict on the file and is raised.
    """
    options = {"pathGlobFilter": f"*{FILE_SUFFIX}", "recursiveFileLookup": True}
    files = spark.read.format("binaryFile").options(**options).load(list(paths)).coalesce(LISTING_TASKS)
    pieces = spark.read.options(**options, **AS_THEY_ARE, lineSep="\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("value"))
    checked = pieces.mapInArrow(partial(check_raw, comment=comment), CHECK_SCHEMA)
    # Files without a byte have no pieces.
    counts = (F.coalesce(c, F.lit(0)).alias(c) for c in ("lines", "bytes"))
    return (
        files.select(F.col("path").alias("file_path"), F.col("_metadata.file_path").alias("uri"))
        .join(checked, "uri", "left").select("file_path", "error", "header", *counts)
    )
