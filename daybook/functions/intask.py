"""The little Python that runs inside tasks, on Arrow batches.

These functions travel to the executors by value, so the package need not be
installed there; pyarrow and numpy must be.
"""

from __future__ import annotations

import codecs
import csv
import gzip
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that are taken out of a file at a time.
PIECE = 1 << 20

_CHECK_ARROW = pa.schema(
    [
        ("uri", pa.string()),
        ("error", pa.string()),
        ("header", pa.list_(pa.string())),
        ("lines", pa.int64()),
        ("bytes", pa.int64()),
    ]
)


def count_runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Count 1, 2, 3, ... along equal neighbours; runs go on across batches."""
    last_key, last_no = None, 0
    for keys in batches:
        runs = pc.run_end_encode(keys)
        numbers, start = [], 0
        for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            first = last_no + 1 if key == last_key else 1
            last_key, last_no = key, first + end - start - 1
            numbers.append(np.arange(first, last_no + 1))
            start = end
        yield pa.array(np.concatenate(numbers) if numbers else [], pa.int64())


def check_raw(batches: Iterator[pa.RecordBatch], comment: str | None) -> Iterator[pa.RecordBatch]:
    """Decompress files that come as the pieces (uri, size, value) line feeds cut them into.

    A task sees all pieces of a file in order, and keeps of it a window, the
    line that may be its header, and counts.
    """
    uri, size, fed, file = None, 0, 0, None

    def done() -> Iterator[pa.RecordBatch]:
        if file is not None:
            yield pa.RecordBatch.from_pylist([{"uri": uri, **file.end()}], schema=_CHECK_ARROW)

    for batch in batches:
        runs = pc.run_end_encode(batch["uri"])
        start = 0
        for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            if name != uri:
                yield from done()
                uri, size, fed, file = name, batch["size"][start].as_py(), 0, _GzipText(comment)
            # Each piece has lost a line feed, but for the last one if the file ends without.
            raw = b"\n".join(batch["value"].slice(start, end - start).to_pylist()) + b"\n"
            file.feed(raw[: size - fed])
            fed += len(raw)
            start = end
    yield from done()


def _header_in(line: bytes, comment: str | None) -> list[str] | None:
    """The names in a line, unless it is blank or a comment."""
    text = line.decode("utf-8-sig", "replace").rstrip("\r\n")
    if not text or (comment and text.startswith(comment)):
        return None
    return next(csv.reader([text]))


class _GzipText:
    """Reads the members of a gzip file one after another; what is no member is an error, as in a load."""

    def __init__(self, comment: str | None):
        self.comment = comment
        self.member = None
        self.error: str | None = None
        self.header: list[str] | None = None
        self.lines = self.bytes = 0
        self.begin: bytes | None = b""  # until it is known whether a byte order mark comes first
        self.head = b""  # the line so far that may be the header
        self.last = b"\n"

    def feed(self, data: bytes) -> None:
        while data and self.error is None:
            if self.member is None or self.member.eof:
                self.member = zlib.decompressobj(zlib.MAX_WBITS | 16)
            try:
                self._text(self.member.decompress(data, PIECE))
            except zlib.error as e:
                self.error = f"unreadable file: {e}"
            data = self.member.unused_data if self.member.eof else self.member.unconsumed_tail

    def _text(self, text: bytes, last: bool = False) -> None:
        if self.begin is not None:
            text = self.begin + text
            if len(text) < len(codecs.BOM_UTF8) and not last:
                self.begin = text
                return
            text, self.begin = text.removeprefix(codecs.BOM_UTF8), None
        feeds = text.count(b"\n")
        self.lines += feeds
        self.bytes += len(text) - feeds
        self.last = text[-1:] or self.last
        if self.header is None:
            *whole, self.head = (self.head + text).split(b"\n")
            for line in whole:
                if self.header is None:
                    self.header = _header_in(line, self.comment)

    def end(self) -> dict:
        if self.error is None and self.member is not None and not self.member.eof:
            try:
                self._text(self.member.flush())
            except zlib.error as e:
                self.error = f"unreadable file: {e}"
            if not self.member.eof:
                self.error = self.error or "unreadable file: it ends before its data does"
        self._text(b"", last=True)
        if self.error is not None:
            return {"error": self.error, "header": None, "lines": 0, "bytes": 0}
        if self.header is None:
            self.header = _header_in(self.head, self.comment)
        return {"error": None, "header": self.header, "lines": self.lines + (self.last != b"\n"), "bytes": self.bytes}
