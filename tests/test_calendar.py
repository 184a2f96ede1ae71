import datetime

from pyspark.sql import functions as F

from daybook.constants import EARLIEST_DAY
from daybook.functions.naming import (
    address,
    day_in,
    day_path,
    file_name_in,
    http_code,
    local_path,
    part_number,
    with_names,
)
from daybook.sources.calendar import calendar

D = datetime.date


def days(spark, start, end):
    return [r.snapshot_date for r in calendar(spark, start, end).collect()]


def test_both_ends_in_order(spark):
    found = days(spark, D(2024, 2, 27), D(2024, 3, 1))
    assert found == [D(2024, 2, 27), D(2024, 2, 28), D(2024, 2, 29), D(2024, 3, 1)]


def test_one_day_and_no_day(spark):
    assert days(spark, D(2024, 1, 1), D(2024, 1, 1)) == [D(2024, 1, 1)]
    assert days(spark, D(2024, 1, 2), D(2024, 1, 1)) == []


def test_defaults_run_from_the_earliest_day_to_today(spark):
    found = calendar(spark).agg(F.min("snapshot_date"), F.max("snapshot_date")).first()
    assert found[0] == EARLIEST_DAY == D(2021, 4, 14)
    assert found[1] == spark.range(1).select(F.current_date()).first()[0]


def test_whole_range_of_the_sample_log(spark):
    assert calendar(spark, EARLIEST_DAY, D(2024, 12, 1)).count() == 1328


def test_names(spark):
    name = F.col("file_name")
    row = (
        with_names(calendar(spark, D(2024, 3, 5), D(2024, 3, 5)), "scores")
        .select("file_name", address(name, "https://x.example/"), local_path(name, "data/raw"),
                local_path(name, "data/raw/"))
        .first()
    )
    assert tuple(row) == (
        "scores-2024-03-05.csv.gz",
        "https://x.example/scores-2024-03-05.csv.gz",
        "data/raw/scores-2024-03-05.csv.gz",
        "data/raw/scores-2024-03-05.csv.gz",
    )


def test_names_back_to_days(spark):
    paths = {
        "file:/l/s-2024-03-05.csv.gz": ("s-2024-03-05.csv.gz", D(2024, 3, 5)),
        "file:/l/s-2024-03-05.csv.gz/part-00001-x.csv.gz": ("s-2024-03-05.csv.gz", D(2024, 3, 5)),
        "/l/file_name=s-2024-03-05.csv.gz/part-1.csv.gz": ("s-2024-03-05.csv.gz", D(2024, 3, 5)),
        "s-2024-03-05.csv.gz": ("s-2024-03-05.csv.gz", D(2024, 3, 5)),
        "/l/other-s-2024-03-05.csv.gz": (None, D(2024, 3, 5)),
        "/l/s-2024-03-05.csv": (None, None),
        "/l/s-2024-13-05.csv.gz": ("s-2024-13-05.csv.gz", None),
        "/l/s-2024-03-05.csv.gz/deep/part-1.csv.gz": (None, None),
        "/2020-01-01/s-2024-03-05.csv.gz": ("s-2024-03-05.csv.gz", D(2024, 3, 5)),
        "/o-2020-01-01.csv.gz/s-2024-03-05.csv.gz": (None, D(2020, 1, 1)),
    }
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    found = rows.select("path", file_name_in(F.col("path"), "s"), day_in(F.col("path"))).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == paths


def test_day_path_and_part_number(spark):
    paths = ["file:/l/s-2024-03-05.csv.gz", "file:/l/file_name=s-2024-03-05.csv.gz/part-100000-a.csv.gz"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    found = rows.select(day_path(F.col("path"), "s"), part_number(F.col("path"))).collect()
    assert [tuple(r) for r in found] == [
        ("file:/l/s-2024-03-05.csv.gz", None),
        ("file:/l/file_name=s-2024-03-05.csv.gz", 100000),
    ]


def test_http_code(spark):
    rows = spark.createDataFrame([("404 Client Error: x",), ("timed out",), (None,)], "error string")
    assert [r[0] for r in rows.select(http_code(F.col("error"))).collect()] == [404, None, None]
