import json

import pytest
from pyspark.sql import functions as F

from daybook.operators.checks import error_summary
from daybook.sources.errorlog import (
    append_errors,
    import_error_array,
    read_error_array,
    read_errors,
)

# A log as four catch-up runs over the same failing days leave it.
EARLY = [f"2021-04-{d}" for d in (22, 23, 24, 25, 26)]
DATES = [*EARLY, *EARLY, *EARLY, "2021-06-07", "2021-06-18", *EARLY, "2021-06-07", "2021-06-18",
         "2022-07-14", "2024-12-01"]


def entry(date):
    return {"date": date, "error": f"404 Client Error: Not Found for url: https://x.example/{date}"}


@pytest.fixture
def array(tmp_path):
    path = tmp_path / "errors.json"
    path.write_text(json.dumps([entry(d) for d in DATES], indent=2) + "\n")
    return str(path)


def test_array_log(spark, array):
    rows = read_error_array(spark, array).orderBy("position").collect()
    assert [(r.position, r.date, r.error) for r in rows] == [
        (i, d, entry(d)["error"]) for i, d in enumerate(DATES, 1)
    ]
    assert all(r.unparsed is None for r in rows)


def test_array_log_summary(spark, array):
    present = spark.createDataFrame([("2022-07-14",)], "d string").select(
        F.col("d").cast("date").alias("snapshot_date")
    )
    rows = error_summary(read_error_array(spark, array), present, order="position").collect()
    found = {r.date: r for r in rows}
    assert {d: r.attempts for d, r in found.items()} == {d: DATES.count(d) for d in DATES}
    assert {r.http_code for r in rows} == {404}
    assert (found["2021-04-22"].first_seen, found["2021-04-22"].last_seen) == (1, 18)
    assert [d for d, r in found.items() if not r.still_pending] == ["2022-07-14"]


def test_absent_log_is_empty(spark, tmp_path):
    assert read_error_array(spark, str(tmp_path / "none.json")).isEmpty()
    assert read_errors(spark, str(tmp_path / "none")).columns == ["date", "error", "run"]


def test_broken_array_is_reported(spark, tmp_path):
    path = tmp_path / "errors.json"
    text = json.dumps([entry(d) for d in DATES], indent=2)
    path.write_text(text[:200])
    rows = read_error_array(spark, str(path)).collect()
    assert [r for r in rows if r.unparsed is not None]


def test_append_keeps_duplicates_and_the_two_keys(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([tuple(entry(d).values()) for d in EARLY], "date string, error string")
    append_errors(rows, log, "run-1")
    append_errors(rows, log, "run-2")
    assert read_errors(spark, log).groupBy("date").count().where("count = 2").count() == 5
    lines = [json.loads(line) for p in (tmp_path / "log").rglob("*.json")
             for line in p.read_text().splitlines()]
    assert len(lines) == 10
    assert all(line == entry(line["date"]) and list(line) == ["date", "error"] for line in lines)


def test_appending_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    append_errors(spark.createDataFrame([], "date string, error string"), log, "run-1")
    assert read_errors(spark, log).isEmpty()


def test_import_keeps_order(spark, array, tmp_path):
    log = tmp_path / "log"
    import_error_array(spark, array, str(log), "before")
    written = [json.loads(line)["date"] for p in sorted((log / "run=before").glob("*.json"))
               for line in p.read_text().splitlines()]
    assert written == DATES
