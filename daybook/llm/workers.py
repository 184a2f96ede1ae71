"""Memory of Python workers, which Spark uses again for the tasks of later stages."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

_FORGET: list[Callable[[], None]] = []


def keeps(forget: Callable[[], None]) -> None:
    """Name what empties a table that a module keeps from task to task."""
    if forget not in _FORGET:
        _FORGET.append(forget)


def make_room() -> None:
    """Drop what the tasks of other stages have left in this worker."""
    for forget in _FORGET:
        forget()
    give_back()


def give_back() -> None:
    """Return to the system what Arrow's allocator holds without use."""
    pa.default_memory_pool().release_unused()
