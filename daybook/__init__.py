"""Daily snapshot files as Spark tables: calendar, ingest, ledger, error log, checks."""

from daybook.feed import Feed
from daybook.plans.backfill import backfill, load_day
from daybook.plans.inspection import inspect_snapshot

__all__ = ["Feed", "backfill", "inspect_snapshot", "load_day"]
