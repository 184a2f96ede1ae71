"""Where one kind of daily snapshot lives and how it is parsed."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from daybook.constants import NULL_TOKENS


# The store's partition column, and what reading a snapshot adds to its columns.
RESERVED = {"snapshot_date", "flagged", "part", "pos", "_corrupt_record"}


@dataclass(frozen=True)
class Feed:
    """One family of files ``<prefix>-YYYY-MM-DD.csv.gz`` and its tables.

    ``landing``    directory the files arrive in
    ``store``      Parquet table, one partition per day
    ``ledger``     append-only table of day outcomes
    ``error_log``  append-only JSON lines, keys ``date`` and ``error``
    ``base_url``   address the files come from; used in messages only
    ``schema``     snapshot columns; ``None`` takes the store's, else infers
    """

    prefix: str
    landing: str
    store: str
    ledger: str
    error_log: str
    base_url: str
    schema: T.StructType | None = None
    null_tokens: tuple[str, ...] = NULL_TOKENS
    comment: str | None = None
    match_header: bool = True

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", self.prefix):
            raise ValueError(f"prefix {self.prefix!r} is not a plain file name part")
        if set(self.landing) & set("*?[]{}"):
            raise ValueError(f"landing {self.landing!r} has characters that stand for others in a path")
        taken = {n.lower() for n in self.schema.names} & RESERVED if self.schema else set()
        if taken:
            raise ValueError(f"columns {sorted(taken)} have a meaning of their own here")
