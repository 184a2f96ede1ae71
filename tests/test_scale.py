"""Plans and skew: what must hold when the data is a thousand times larger."""

import datetime
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from daybook import backfill, queries
from daybook.operators import checks, outcomes
from daybook.plans.backfill import read_feed
from daybook.session import broadcast_if_small, scratch, setting, settle, shared_folder
from daybook.sources import calendar, landing, ledger, lines, store

SF_DIR = "/root/testdata/sf0.01"
HOT = datetime.date(2024, 1, 9)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """Events with half of all rows on one day, as snapshot files."""
    hot = F.when(F.col("event_id") % 2 == 0, F.lit(HOT)).otherwise(F.col("snapshot_date"))
    events = settle(queries._events(spark, SF_DIR).withColumn("snapshot_date", hot))
    feed = queries._feed(spark, "skewed")
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        queries._publish(events, feed.landing)
    return feed, events


def test_hot_day_is_many_parts_and_arrives_whole(spark, skewed):
    feed, events = skewed
    result = backfill(spark, feed, *queries._range(spark, SF_DIR), run="r").collect()
    assert {r.status for r in result} == {"LOADED"}
    rows = queries._stored(spark, feed)
    parts = landing.landing_files(spark, feed.landing, feed.prefix)
    assert parts.where(F.col("snapshot_date") == HOT).count() > 2
    names = queries.EVENTS.names
    found = checks.compare_days(events, rows, names).collect()
    assert len(found) == 30 and all(r.same_content for r in found)
    assert rows.exceptAll(events.select(*rows.columns)).isEmpty()


def test_lines_of_a_hot_day_are_numbered_through(spark, skewed):
    feed, events = skewed
    numbered = lines.lines_across_parts(spark, [feed.landing])
    hot = numbered.where(F.col("folder").endswith(f"events-{HOT}.csv.gz"))
    ids = [r.line.split(",")[0] for r in hot.orderBy("line_no").collect()]
    assert [r.line_no for r in hot.select("line_no").orderBy("line_no").collect()] == list(
        range(1, len(ids) + 1)
    )
    ids = [int(i) for i in ids if i != "event_id"]  # each part has a header
    assert ids == sorted(ids)
    assert len(ids) == events.where(F.col("snapshot_date") == HOT).count()


def test_load_does_not_shuffle(spark, skewed):
    feed, _ = skewed
    rows = read_feed(spark, feed, queries.EVENTS, [feed.landing])
    assert "Exchange" not in plan(rows)
    assert "Python" not in plan(rows)


def test_load_reads_no_columns_it_does_not_need(spark, skewed):
    feed, _ = skewed
    one = read_feed(spark, feed, queries.EVENTS, [feed.landing]).select("user_id")
    assert re.search(r"ReadSchema: struct<user_id:string>", plan(one))


def test_line_scans_do_not_shuffle(spark, skewed):
    feed, _ = skewed
    assert "Exchange" not in plan(queries.line_scan(spark, SF_DIR))
    assert "Python" not in plan(queries.line_scan(spark, SF_DIR))
    assert "Exchange" not in plan(lines.lines_of_files(spark, [feed.landing]))


def test_line_scan_cuts_each_text_once(spark):
    assert plan(queries.line_scan(spark, SF_DIR)).count("split(") == 1


def test_aggregates_reduce_before_the_shuffle(spark, skewed):
    feed, _ = skewed
    rows = read_feed(spark, feed, queries.EVENTS, [feed.landing])
    text = plan(checks.day_content(rows, queries.EVENTS.names))
    assert text.index("partial_count") > text.index("Exchange hashpartitioning")
    observed = calendar.observed_days(spark.read.parquet(f"{SF_DIR}/orders.parquet"), "o_orderdate")
    assert plan(observed).count("HashAggregate") >= 2


def test_joins_are_hash_or_merge_joins_without_hints(spark):
    names, present = queries._order_names(spark, SF_DIR)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        text = plan(outcomes.pending_days(names, present))
    assert "SortMergeJoin" in text and "LeftAnti" in text
    assert not re.search("Cartesian|NestedLoop|Broadcast", text)


def test_broadcast_stops_at_the_limit(spark, monkeypatch):
    monkeypatch.setattr("daybook.session.SMALL_ROWS", 10)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        big = spark.range(1000)
        assert "Broadcast" in plan(big.join(broadcast_if_small(spark.range(10)), "id"))
        assert "Broadcast" not in plan(big.join(broadcast_if_small(spark.range(11)), "id"))


def test_broadcast_stops_at_so_many_bytes(spark, monkeypatch):
    monkeypatch.setattr("daybook.session.SMALL_BYTES", 1000)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        big = spark.range(1000)
        few = spark.range(10).selectExpr("id", "repeat('x', 80) AS path")
        assert "Broadcast" in plan(big.join(broadcast_if_small(few), "id"))
        assert "Broadcast" not in plan(big.join(broadcast_if_small(few.selectExpr("id", "path || path AS path")), "id"))


def test_top_rows_are_kept_per_task(spark):
    assert "TakeOrderedAndProject" in plan(queries.preview(spark, SF_DIR))


def test_outcomes_do_not_change_after_the_run(spark, skewed):
    feed = replace(skewed[0], store=scratch(spark, "s"), ledger=scratch(spark, "l"))
    result = backfill(spark, feed, HOT, HOT, run="r")
    assert [r.status for r in result.collect()] == ["LOADED"]
    assert [r.status for r in result.collect()] == ["LOADED"]
    present = ledger.loaded_days(ledger.read_ledger(spark, feed.ledger)).collect()
    assert [r.snapshot_date for r in present] == [HOT]


def test_scratch_lies_in_the_folder_the_session_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch(spark, "x").startswith(shared_folder(spark) + "/daybook/")
    assert spark.sparkContext.getCheckpointDir() is not None


def test_setting_is_put_back(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), setting(spark, key, "1t"):
        assert spark.conf.get(key) == "1t"
        1 / 0
    assert spark.conf.get(key) == before
