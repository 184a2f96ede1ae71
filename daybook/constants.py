"""Fixed values. Results depend on them, so they stay exactly as they are."""

import datetime

# First day of the calendar, rows shown by a preview.
EARLIEST_DAY = datetime.date(2021, 4, 14)
PREVIEW_ROWS = 100

# Shape of a snapshot file name, <prefix>-<yyyy-MM-dd>.csv.gz.
DAY_PATTERN = r"\d{4}-\d{2}-\d{2}"
FILE_SUFFIX = ".csv.gz"

# Text of a failed request, with the address at the end.
NOT_FOUND_TEXT = "404 Client Error: Not Found for url: "

# Line numbers start at 1 and a printed line reads "Line <n>: <text>".
LINE_LABEL = ("Line ", ": ")

# Cell texts that mean "missing" (the pandas.read_csv defaults).
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Characters that str.strip() removes.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Day outcomes.
LOADED = "LOADED"
SKIPPED = "SKIPPED"
FAILED = "FAILED"
