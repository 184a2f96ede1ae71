"""The same results in plain SQL over the given tables."""

from __future__ import annotations

BASE_URL = "https://snapshots.example.org"
NOT_FOUND = "404 Client Error: Not Found for url: "

_SPINE = """
    SELECT CAST(d AS DATE) AS snapshot_date
    FROM (SELECT unnest(generate_series(
              CAST(min(o_orderdate) AS DATE)::TIMESTAMP,
              CAST(max(o_orderdate) AS DATE)::TIMESTAMP,
              INTERVAL 1 DAY)) AS d
          FROM orders)
"""

_ORDER_DAYS = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders"

_MISSING = f"""
    SELECT snapshot_date,
           'orders-' || strftime(snapshot_date, '%Y-%m-%d') || '.csv.gz' AS file_name
    FROM ({_SPINE}) AS s
    WHERE NOT EXISTS (SELECT 1 FROM ({_ORDER_DAYS}) AS o WHERE o.d = s.snapshot_date)
"""

_EVENT_DAYS = """
    SELECT DISTINCT CAST(ts AS DATE) AS snapshot_date,
           'events-' || strftime(ts, '%Y-%m-%d') || '.csv.gz' AS file_name
    FROM events
"""

# The days that have not landed at first, counted from the first day of the events.
_MISSING_DAY = "(SELECT CAST(CAST(min(ts) AS DATE) + 3 AS DATE) FROM events)"
_LATE_DAY = "(SELECT CAST(CAST(min(ts) AS DATE) + 16 AS DATE) FROM events)"

_STORE = """
    SELECT event_id, ts, user_id, event_type, value, props, CAST(ts AS DATE) AS snapshot_date
    FROM events
"""


def _outcomes(cases: str, days: str = _EVENT_DAYS) -> str:
    return f"""
        SELECT snapshot_date, file_name,
               CASE WHEN status <> 'FAILED' THEN 'file_name=' || file_name END AS landing_path,
               status,
               CASE WHEN status = 'FAILED' THEN '{NOT_FOUND}{BASE_URL}/' || file_name END AS error
        FROM (SELECT snapshot_date, file_name, {cases} AS status FROM ({days}) AS d) AS o
    """


_LINES = r"""
    SELECT doc_id,
           CAST(line_no AS BIGINT) AS line_no,
           trim(raw, E'\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ' || chr(133) || chr(160) || chr(5760)
               || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197)
               || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232)
               || chr(8233) || chr(8239) || chr(8287) || chr(12288)) AS line
    FROM (SELECT doc_id, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS line_no,
                 len(parts) AS n
          FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS parts FROM documents))
    WHERE NOT (line_no = n AND raw = '')
"""

_ERRORS = f"""
    SELECT run, strftime(day, '%Y-%m-%d') AS date,
           '{NOT_FOUND}{BASE_URL}/events-' || strftime(day, '%Y-%m-%d') || '.csv.gz' AS error
    FROM (SELECT 'run-1' AS run, {_MISSING_DAY} AS day UNION ALL SELECT 'run-1', {_LATE_DAY}
          UNION ALL SELECT 'run-2', {_MISSING_DAY}) AS failures
"""

ORACLES: dict[str, str] = {
    "spine": _SPINE,
    "days_to_date": """
        SELECT CAST(d AS DATE) AS snapshot_date, n AS orders
        FROM (SELECT unnest(generate_series(
                  DATE '2021-04-14'::TIMESTAMP, current_date::TIMESTAMP, INTERVAL 1 DAY)) AS d) AS c
        JOIN (SELECT day(o_orderdate) AS date, count(*) AS n FROM orders GROUP BY 1) AS o ON day(d) = o.date
    """,
    "snapshot_names": f"""
        SELECT snapshot_date,
               strftime(snapshot_date, '%Y-%m-%d') AS day_key,
               'orders-' || strftime(snapshot_date, '%Y-%m-%d') || '.csv.gz' AS file_name,
               '{BASE_URL}/orders-' || strftime(snapshot_date, '%Y-%m-%d') || '.csv.gz' AS url,
               'data/raw/orders-' || strftime(snapshot_date, '%Y-%m-%d') || '.csv.gz' AS path
        FROM ({_SPINE}) AS s
    """,
    "pending_days": _MISSING,
    "present_days": f"""
        SELECT snapshot_date,
               'orders-' || strftime(snapshot_date, '%Y-%m-%d') || '.csv.gz' AS file_name
        FROM ({_SPINE}) AS s
        WHERE EXISTS (SELECT 1 FROM ({_ORDER_DAYS}) AS o WHERE o.d = s.snapshot_date)
    """,
    "error_entries": f"""
        SELECT strftime(snapshot_date, '%Y-%m-%d') AS date,
               '{NOT_FOUND}{BASE_URL}/' || file_name AS error,
               CAST(404 AS INTEGER) AS http_code
        FROM ({_MISSING}) AS m
    """,
    "landing_files": f"SELECT file_name, snapshot_date FROM ({_EVENT_DAYS}) AS d",
    "ingest_outcomes": _outcomes(
        f"CASE WHEN snapshot_date = {_MISSING_DAY} OR snapshot_date = {_LATE_DAY} "
        "THEN 'FAILED' ELSE 'LOADED' END"
    ),
    "rerun_outcomes": _outcomes(
        f"CASE WHEN snapshot_date = {_MISSING_DAY} THEN 'FAILED' "
        f"WHEN snapshot_date = {_LATE_DAY} THEN 'LOADED' ELSE 'SKIPPED' END"
    ),
    "rerun_rows": f"{_STORE} WHERE CAST(ts AS DATE) <> {_MISSING_DAY}",
    "ingest_rows": _STORE,
    "stream_rows": _STORE,
    "stream_after_backfill": f"""
        SELECT CAST(ts AS DATE) AS snapshot_date,
               CASE WHEN CAST(ts AS DATE) < {_LATE_DAY} THEN 'SKIPPED' ELSE 'LOADED' END AS status,
               count(*) AS rows
        FROM events GROUP BY 1
    """,
    "single_day_outcome": _outcomes(
        "'LOADED'",
        f"SELECT * FROM ({_EVENT_DAYS}) AS e WHERE snapshot_date = {_LATE_DAY}",
    ),
    "store_one_day": f"{_STORE} WHERE CAST(ts AS DATE) = {_LATE_DAY}",
    "inferred_types": """
        SELECT column_name,
               CASE WHEN bool_and(regexp_matches(cell, '^[+-]?[0-9]+$')) THEN 'bigint'
                    WHEN bool_and(try_cast(cell AS DOUBLE) IS NOT NULL) THEN 'double'
                    ELSE 'string' END AS column_type
        FROM (SELECT 'event_id' AS column_name, CAST(event_id AS VARCHAR) AS cell FROM events
              UNION ALL SELECT 'ts', CAST(ts AS VARCHAR) FROM events
              UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events
              UNION ALL SELECT 'event_type', event_type FROM events
              UNION ALL SELECT 'value', CAST(value AS VARCHAR) FROM events
              UNION ALL SELECT 'props', props FROM events)
        GROUP BY column_name
    """,
    "error_log_append": _ERRORS,
    "error_summary": f"""
        SELECT date, count(*) AS attempts, min(run) AS first_seen, max(run) AS last_seen,
               CAST(404 AS INTEGER) AS http_code, CAST(date AS DATE) = {_MISSING_DAY} AS still_pending
        FROM ({_ERRORS}) AS e GROUP BY date
    """,
    "imported_log": f"""
        SELECT strftime(snapshot_date, '%Y-%m-%d') AS date,
               '{NOT_FOUND}{BASE_URL}/' || file_name AS error
        FROM ({_MISSING} UNION ALL {_MISSING}) AS m
    """,
    "line_scan": _LINES,
    "line_labels": f"""
        SELECT doc_id, 'Line ' || line_no || ': ' || line AS label FROM ({_LINES}) AS l
    """,
    "file_lines": r"""
        SELECT strftime(ts, '%Y-%m-%d') AS day,
               row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS line_no,
               event_id || chr(9) || event_type || chr(9) || props AS line
        FROM events
    """,
    "snapshot_preview": f"""
        {_STORE} WHERE CAST(ts AS DATE) = (SELECT CAST(min(ts) AS DATE) FROM events)
        ORDER BY event_id LIMIT 100
    """,
    "inspect_lines": """
        SELECT row_number() OVER (ORDER BY event_id) AS row_no, event_id FROM events
        WHERE CAST(ts AS DATE) = (SELECT CAST(min(ts) AS DATE) FROM events)
    """,
    "inspect_labels": """
        SELECT row_no, line, ': ' || line AS label_text, TRUE AS numbered
        FROM (SELECT row_number() OVER (ORDER BY event_id) AS row_no,
                     event_id || ',' || user_id || ',' || event_type || ',"' || replace(props, '"', '""') || '"' AS line
              FROM events WHERE CAST(ts AS DATE) = (SELECT CAST(min(ts) AS DATE) FROM events)) AS l
    """,
    "inspect_preview": """
        SELECT event_id, user_id, event_type, props, CAST(ts AS DATE) AS snapshot_date
        FROM events WHERE CAST(ts AS DATE) = (SELECT CAST(min(ts) AS DATE) FROM events)
        ORDER BY event_id LIMIT 100
    """,
    "preview": "SELECT * FROM events ORDER BY event_id LIMIT 100",
    "daily_counts": """
        SELECT CAST(ts AS DATE) AS snapshot_date, count(*) AS rows FROM events GROUP BY 1
    """,
    "sample_check": f"{_STORE} WHERE md5(CAST(event_id AS VARCHAR)) LIKE '0%'",
    "day_check": f"""
        SELECT CAST(ts AS DATE) AS snapshot_date, count(*) AS landing_rows,
               count(*) AS store_rows, CAST(0 AS BIGINT) AS flagged_rows, TRUE AS same_content
        FROM events WHERE CAST(ts AS DATE) <> {_MISSING_DAY} GROUP BY 1
    """,
    "readable_files": """
        SELECT 'events-' || strftime(CAST(ts AS DATE), '%Y-%m-%d') || '.csv.gz' AS file_name,
               CAST(0 AS BIGINT) AS unreadable_parts, count(*) AS lines
        FROM events GROUP BY CAST(ts AS DATE)
    """,
    "flagged_rows": """
        SELECT source, count(*) AS rows, count(*) FILTER (WHERE contains(text, ',')) AS flagged
        FROM documents GROUP BY source
    """,
}
