"""The first rows of something, in its own order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from daybook.constants import PREVIEW_ROWS


def first_rows(rows: DataFrame, *order: str, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows by ``order``. Each task keeps at most ``n`` rows."""
    return rows.orderBy(*order).limit(n)


def first_of_part(rows: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows of one part of a snapshot: a limit, which ends the reading; no sort."""
    return rows.drop("flagged").limit(n)
