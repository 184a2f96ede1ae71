"""Columns for lines and cells of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.constants import LINE_LABEL, NULL_TOKENS, STRIP_CHARS


def strip(text: Column) -> Column:
    """Remove leading and trailing white space, Unicode included.

    Most lines begin and end with a printable ASCII character. One look at the
    outer bytes leaves those alone; trimming walks through the whole line.
    """
    raw = text.cast("binary")
    bare = _printable(F.substring(raw, 1, 1)) & _printable(F.substring(raw, -1, 1))
    return F.when(bare, text).otherwise(F.btrim(text, F.lit(STRIP_CHARS)))


def _printable(byte: Column) -> Column:
    return (byte > F.lit(b"\x20")) & (byte < F.lit(b"\x7f"))


def line_label(line_no: Column, line: Column) -> Column:
    before, between = LINE_LABEL
    return F.concat(F.lit(before), line_no.cast("string"), F.lit(between), line)


def line_pieces(text: Column) -> Column:
    """A text cut at its line breaks; a break at the end leaves an empty last piece.

    Cut at plain line feeds, which is many times faster than at a pattern. A
    carriage return before a line feed stays on the piece for ``strip`` to take;
    only a text with single carriage returns has its breaks rewritten first.
    """
    single = F.contains(text, F.lit("\r")) & text.rlike("\r(?!\n)")
    unified = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.split(F.when(single, unified).otherwise(text), "\n")


def present(cell: Column, tokens: Sequence[str | Column] = NULL_TOKENS) -> Column:
    """The cell, or null where its text stands for a missing value."""
    return F.when(~cell.isin(*tokens), cell) if tokens else cell
