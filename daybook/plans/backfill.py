"""Backfill: bring the store up to date with the landing directory."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.constants import EARLIEST_DAY, FAILED, LOADED, SKIPPED
from daybook.feed import Feed
from daybook.functions.naming import file_name, file_name_in, with_names
from daybook.operators.checks import day_content
from daybook.operators.outcomes import day_outcomes, pending_days
from daybook.session import settle
from daybook.sources import ledger as ledgers
from daybook.sources.calendar import calendar
from daybook.sources.errorlog import append_errors, error_entries
from daybook.sources.landing import check_files, landed_days, landing_files
from daybook.sources.snapshots import infer_schema, read_snapshots
from daybook.sources.store import stored_schema, write_days

#: Landed bytes, compressed, that are loaded and entered in the ledger together.
GROUP_BYTES = 1 << 40


def backfill(
    spark: SparkSession,
    feed: Feed,
    start: datetime.date = EARLIEST_DAY,
    end: datetime.date | None = None,
    run: str | None = None,
    verify: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Load every pending day of the range that has landed; log the others.

    Returns one outcome row per day. Safe to run again at any time: loaded days
    are skipped, failed days are tried again. Of each group of days the store is
    written first and the ledger last, so a run that dies half way leaves the
    rest pending, never wrongly present.

    Sound files are the rule, so by default they are read once, by the load
    itself; only if that fails is each file checked and the rest loaded.
    ``verify`` checks first, for sources that often deliver broken files.
    ``strict`` also fails a day that has flagged rows.
    """
    return bring_in(spark, feed, with_names(calendar(spark, start, end), feed.prefix), run, verify, strict)


def bring_in(
    spark: SparkSession,
    feed: Feed,
    names: DataFrame,
    run: str | None = None,
    verify: bool = False,
    strict: bool = False,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Load the pending ones of some days (snapshot_date, file_name); one outcome row per day.

    Days are loaded in groups of up to ``group_bytes`` of landed files, and each
    group enters the ledger when it is written: a run that dies keeps the groups
    before, and a broken file costs a second read of its own group only.
    """
    run = run or datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%S.%fZ")
    loaded = settle(ledgers.loaded_days(ledgers.read_ledger(spark, feed.ledger)))
    # At most one row per calendar day comes to the driver, never rows or files.
    pending = [r.file_name for r in pending_days(names, loaded).select("file_name").collect()]
    landed = landed_days(landing_files(spark, feed.landing, feed.prefix, pending))
    sizes = landed.select("file_name", "bytes")
    planned = day_outcomes(names, loaded, landed.drop("bytes"), feed.base_url).join(sizes, "file_name", "left")
    days = [Day(**r.asDict()) for r in planned.orderBy("snapshot_date").collect()]

    done = rest = [d for d in days if d.status != LOADED]
    for group in _groups([d for d in days if d.status == LOADED], group_bytes):
        if verify:
            group = _drop_unsound(spark, feed, group)
        group = _load(spark, feed, group, strict)
        _enter(spark, group, feed, run)
        done = done + group
    _enter(spark, rest, feed, run)
    return _outcomes(spark, sorted(done, key=lambda d: d.snapshot_date))


class Day(NamedTuple):
    """What happens to a day: a row of ``day_outcomes``, and the landed bytes."""

    snapshot_date: datetime.date
    file_name: str
    path: str | None
    status: str
    error: str | None
    bytes: int | None = None
    no_rows: bool = False

    def failed(self, reason: str) -> Day:
        return self._replace(path=None, status=FAILED, error=reason)


def _outcomes(spark: SparkSession, days: list[Day], no_rows: bool = False) -> DataFrame:
    rows = [(*d[:5], d.no_rows) for d in days]
    table = spark.createDataFrame(rows, f"{ledgers.OUTCOME}, no_rows boolean").coalesce(1)
    return table if no_rows else table.drop("no_rows")


def _enter(spark: SparkSession, days: list[Day], feed: Feed, run: str) -> None:
    """Log the failures, then record the outcomes: the ledger comes last."""
    new = [d for d in days if d.status != SKIPPED]
    failed = [d for d in new if d.status == FAILED]
    if failed:
        append_errors(error_entries(_outcomes(spark, failed)), feed.error_log, run)
    if new:
        ledgers.append_outcomes(_outcomes(spark, new, no_rows=True), feed.ledger, run)


def _groups(days: list[Day], group_bytes: int) -> list[list[Day]]:
    """The days to load in order, cut where a group has reached its size."""
    groups: list[list[Day]] = []
    size = group_bytes
    for day in days:
        if size >= group_bytes:
            groups.append([])
            size = 0
        groups[-1].append(day)
        size += day.bytes or 0
    return groups


def load_day(spark: SparkSession, feed: Feed, day: datetime.date, run: str | None = None) -> DataFrame:
    """Backfill of a single day."""
    return backfill(spark, feed, day, day, run)


def _load(spark: SparkSession, feed: Feed, days: list[Day], strict: bool) -> list[Day]:
    """Write the days to load; a day that cannot be loaded becomes a failure, and no other with it.

    If a load cannot read a file, unsound ones are found and left out. Where none
    is found, halves are loaded on their own until what cannot be read is alone.
    The check has read all bytes by then, so the content is at fault, not the way
    to it. Errors of any other kind are raised.
    """
    try:
        return _write(spark, feed, days, strict)
    except Exception as e:
        fault = reading_fault(e)
        if fault is None:
            raise
        rest = _drop_unsound(spark, feed, days)
        if rest != days:
            return _load(spark, feed, rest, strict)
        to_load = [d for d in days if d.status == LOADED]
        if len(to_load) == 1:
            return [d.failed(f"unreadable file: {fault}") if d.status == LOADED else d for d in days]
        half = len(to_load) // 2
        others = [d for d in days if d.status != LOADED]
        return others + _load(spark, feed, to_load[:half], strict) + _load(spark, feed, to_load[half:], strict)


def reading_fault(error: Exception) -> str | None:
    """Why a file could not be read, if that is what a job died of."""
    cause = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    found = text = None
    while cause is not None:
        if cause.getClass().getName() == "org.apache.spark.SparkException":
            found = found or (cause.getCondition() or "").startswith("FAILED_READ_FILE")
        first = (cause.getMessage() or "").strip().split("\n")[0]
        text = f"{cause.getClass().getName()}: {first}" if first else cause.getClass().getName()
        cause = cause.getCause()
    return text if found else None


def _drop_unsound(spark: SparkSession, feed: Feed, days: list[Day]) -> list[Day]:
    return _fail(days, unsound_days(spark, feed, [d.path for d in days if d.status == LOADED]))


def _fail(days: list[Day], bad: DataFrame) -> list[Day]:
    """The days with those of ``bad`` (file_name, reason) failed."""
    reasons = {r.file_name: r.reason for r in bad.collect()}
    return [d.failed(reasons[d.file_name]) if d.status == LOADED and d.file_name in reasons else d for d in days]


def _write(spark: SparkSession, feed: Feed, days: list[Day], strict: bool) -> list[Day]:
    paths = [d.path for d in days if d.status == LOADED]
    if not paths:
        return days
    schema = snapshot_schema(spark, feed, paths)
    if strict:
        days = _fail(days, flagged_days(spark, feed, schema, paths))
        paths = [d.path for d in days if d.status == LOADED]
        if not paths:
            return days
    written = write_days(
        lambda session: read_feed(session, feed, schema, paths).drop("flagged"), spark, feed.store)
    # A day without rows is present if its file has a header, and failed if it is empty. What an
    # earlier run may have left of it is kept out by the ledger's entry.
    days = [d._replace(no_rows=d.status == LOADED and d.snapshot_date not in written) for d in days]
    without = [d.path for d in days if d.no_rows]
    return _fail(days, unsound_days(spark, feed, without)) if without else days


def snapshot_schema(spark: SparkSession, feed: Feed, paths: Sequence[str]) -> T.StructType:
    """The caller's columns, else those of the store, else those the files show."""
    return (
        feed.schema
        or stored_schema(spark, feed.store)
        or infer_schema(spark, paths, feed.null_tokens, feed.comment)
    )


def read_feed(
    spark: SparkSession,
    feed: Feed,
    schema: T.StructType,
    paths: Sequence[str],
    positions: bool = False,
) -> DataFrame:
    return read_snapshots(
        spark, paths, schema, feed.null_tokens, feed.comment, feed.match_header, positions
    )


def flagged_days(
    spark: SparkSession, feed: Feed, schema: T.StructType, paths: Sequence[str]
) -> DataFrame:
    """Days with rows that do not fit the schema: ``file_name, reason``."""
    content = day_content(read_feed(spark, feed, schema, paths), schema.names)
    return content.where(F.col("flagged") > 0).select(
        file_name(F.col("snapshot_date"), feed.prefix).alias("file_name"),
        F.format_string("%d rows do not fit the schema", "flagged").alias("reason"),
    )


def unsound_days(spark: SparkSession, feed: Feed, paths: Sequence[str]) -> DataFrame:
    """Days with an unreadable part, no content or a foreign header: ``file_name, reason``."""
    if not paths:
        return spark.createDataFrame([], "file_name string, reason string")
    checked = settle(check_files(spark, paths, feed.comment))
    foreign = F.lit(False)
    names = _expected_names(spark, feed, checked) if feed.match_header else None
    if names:
        foreign = F.transform("header", F.lower) != F.array(*[F.lit(n.lower()) for n in names])
    parts = checked.select(
        file_name_in(F.col("file_path"), feed.prefix).alias("file_name"),
        "error",
        F.coalesce(F.col("header").isNull() & F.col("error").isNull(), F.lit(False)).alias("empty"),
        F.when(foreign, F.concat(F.lit("unexpected header: "), F.array_join("header", ","))).alias(
            "foreign"
        ),
    )
    days = parts.groupBy("file_name").agg(
        F.coalesce(
            F.min("error"),
            F.when(F.bool_and("empty"), F.lit("empty file")),
            F.min("foreign"),
        ).alias("reason")
    )
    return days.where(F.col("reason").isNotNull())


def _expected_names(spark: SparkSession, feed: Feed, checked: DataFrame) -> list[str] | None:
    """Header names of the given columns, else of the store, else of the first sound file."""
    schema = feed.schema or stored_schema(spark, feed.store)
    if schema is not None:
        return schema.names
    sound = checked.where(F.col("error").isNull() & F.col("header").isNotNull())
    first = sound.orderBy("file_path").first()
    return first and first.header
