"""Groups of days, the store and its ledger, stream and backfill on one feed."""

import pytest
from test_backfill import END, SCHEMA, START, Site, day, rows_of, statuses

from daybook.feed import Feed
from daybook.functions.naming import with_names
from daybook.plans import backfill as plans
from daybook.sources.calendar import calendar
from daybook.sources.errorlog import import_error_array
from daybook.sources.ledger import loaded_days, read_ledger
from daybook.sources.store import read_store
from daybook.streaming.catchup import catch_up


@pytest.fixture
def site(spark, tmp_path):
    return Site(spark, tmp_path)


def seen(site):
    known = loaded_days(read_ledger(site.spark, site.feed.ledger))
    rows = read_store(site.spark, site.feed.store, SCHEMA, known).collect()
    return sorted(((r.snapshot_date.day, r.id, r.score, r.n) for r in rows), key=str)


def test_a_run_that_dies_keeps_the_groups_before(site, monkeypatch):
    for n in (1, 2, 3):
        site.land(n)
    write, calls = plans.write_days, []

    def dies(*args):
        calls.append(1)
        if len(calls) > 2:
            raise RuntimeError("lost")
        return write(*args)

    names = with_names(calendar(site.spark, START, END), site.feed.prefix)
    with monkeypatch.context() as patch:
        patch.setattr("daybook.plans.backfill.write_days", dies)
        with pytest.raises(RuntimeError):
            plans.bring_in(site.spark, site.feed, names, "r1", group_bytes=1)
    assert seen(site) == rows_of(1, 2)
    assert statuses(site.run("r2")) == "SSLFFF"
    assert seen(site) == rows_of(1, 2, 3)


def test_store_shows_what_the_ledger_has(site, monkeypatch):
    site.land(1)
    site.land(2)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr("daybook.sources.ledger.append_outcomes", crash)
        with pytest.raises(RuntimeError):
            site.run("r1")
    assert seen(site) == []
    site.land(1, "id,score,n\n")
    (site.root / "land ing" / f"scores-{day(2)}.csv.gz").unlink()
    assert statuses(site.run("r2")) == "LFFFFF"
    assert seen(site) == []


def test_stream_and_backfill_share_a_feed(site, tmp_path):
    progress = str(tmp_path / "progress")
    site.land(1)
    assert statuses(site.run("r1")) == "LFFFFF"
    site.land(2)
    site.land(3, raw=b"\x1f\x8b broken")
    catch_up(site.spark, site.feed, progress).awaitTermination()
    assert seen(site) == rows_of(1, 2)
    site.land(4)
    assert statuses(site.run("r2")) == "SSFLFF"
    catch_up(site.spark, site.feed, progress).awaitTermination()
    assert seen(site) == rows_of(1, 2, 4)


def test_numbers_with_a_suffix_are_flagged(site):
    site.land(1, "id,score,n\na,1d,1\nb,2F,2\nc,-inf,3\nd,1e3,4\n")
    rows = plans.read_feed(site.spark, site.feed, SCHEMA, [site.feed.landing]).collect()
    assert {r.id: (r.score, r.flagged) for r in rows} == {
        "a": (None, True), "b": (None, True), "c": (float("-inf"), False), "d": (1000.0, False)}


def test_parts_are_read_from_the_landing_root_too(site):
    site.land(1, part="part-00000.csv.gz")
    site.land(2)
    rows = plans.read_feed(site.spark, site.feed, SCHEMA, [site.feed.landing])
    assert sorted({r.snapshot_date for r in rows.collect()}) == [day(1), day(2)]


def test_a_broken_log_is_not_imported_in_silence(spark, tmp_path):
    (tmp_path / "log.json").write_text('[{"date": "2024-01-01", "err')
    with pytest.raises(ValueError, match="does not parse"):
        import_error_array(spark, str(tmp_path / "log.json"), str(tmp_path / "out"), "r")


def test_landing_with_wildcards_is_refused():
    with pytest.raises(ValueError, match="stand for others"):
        Feed("p", "/land[1]", "/s", "/l", "/e", "https://x.example")


def test_load_neither_moves_nor_sorts_rows(site):
    site.land(1)
    site.run("r1")
    store = site.spark._jsparkSession.sharedState().statusStore()
    plans_ = [e.physicalPlanDescription() for e in _executions(store)]
    written = [p for p in plans_ if "InsertIntoHadoopFsRelationCommand" in p and "snapshot_date" in p
               and "Scan csv" in p]
    assert written and not any("Exchange" in p for p in written)
    assert not any("Sort [snapshot_date" in p for p in written)


def _executions(store):
    listed = store.executionsList()
    return [listed.apply(i) for i in range(listed.size())]
