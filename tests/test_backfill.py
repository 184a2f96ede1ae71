import datetime
import gzip
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import daybook.functions.intask as intask
import daybook.plans.backfill as backfill_module
from daybook import Feed, backfill, inspect_snapshot, load_day
from daybook.operators.checks import compare_days, daily_counts
from daybook.plans import inspection
from daybook.plans.backfill import read_feed, unsound_days
from daybook.sources import landing
from daybook.sources.errorlog import read_errors
from daybook.sources.ledger import loaded_days, read_ledger
from daybook.sources.snapshots import infer_schema
from daybook.sources.store import read_store
from daybook.streaming.catchup import catch_up

SCHEMA = T.StructType().add("id", T.StringType()).add("score", T.DoubleType()).add("n", T.LongType())
START, END = datetime.date(2024, 1, 1), datetime.date(2024, 1, 6)


def day(n):
    return datetime.date(2024, 1, n)


class Site:
    """A landing directory and the tables of one feed."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        self.feed = Feed(
            prefix="scores",
            landing=f"{root}/land ing",
            store=f"{root}/store",
            ledger=f"{root}/ledger",
            error_log=f"{root}/errors",
            base_url="https://x.example",
            schema=SCHEMA,
        )

    def land(self, n, text=None, part=None, raw=None):
        name = f"scores-{day(n)}.csv.gz"
        path = os.path.join(self.feed.landing, name if part is None else f"{name}/{part}")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        text = f"id,score,n\na{n},0.{n},{n}\nb{n},1.5,\n" if text is None else text
        with open(path, "wb") as f:
            f.write(gzip.compress(text.encode()) if raw is None else raw)

    def run(self, run, **options):
        rows = backfill(self.spark, self.feed, START, END, run, **options).collect()
        assert [r.snapshot_date for r in rows] == [day(n) for n in range(1, 7)]
        return {r.snapshot_date.day: r for r in rows}

    def stored(self):
        known = loaded_days(read_ledger(self.spark, self.feed.ledger))
        return read_store(self.spark, self.feed.store, SCHEMA, known)

    def store(self):
        rows = self.stored().collect()
        return sorted(((r.snapshot_date.day, r.id, r.score, r.n) for r in rows), key=str)

    def errors(self):
        return sorted((r.run, r.date) for r in read_errors(self.spark, self.feed.error_log).collect())


@pytest.fixture
def site(spark, tmp_path):
    return Site(spark, tmp_path)


def statuses(outcomes):
    return "".join(outcomes[n].status[0] for n in sorted(outcomes))


def rows_of(*days):
    return sorted(
        (r for n in days for r in [(n, f"a{n}", n / 10, n), (n, f"b{n}", 1.5, None)]), key=str
    )


def test_absent_landing_fails_every_day(site):
    found = site.run("r1")
    assert statuses(found) == "FFFFFF"
    assert found[1].path is None
    assert found[1].error == (
        "404 Client Error: Not Found for url: https://x.example/scores-2024-01-01.csv.gz"
    )
    assert site.store() == []
    assert len(site.errors()) == 6


def test_runs_skip_loaded_days_and_retry_failed_ones(site):
    for n in (1, 2, 5):
        site.land(n)
    first = site.run("r1")
    assert statuses(first) == "LLFFLF"
    assert first[5].path.endswith("/land ing/scores-2024-01-05.csv.gz")
    assert site.store() == rows_of(1, 2, 5)

    site.land(3)
    site.land(1, "id,score,n\nchanged,0,0\n")  # a loaded day is not looked at again
    second = site.run("r2")
    assert statuses(second) == "SSLFSF"
    assert second[5].path == first[5].path
    assert site.store() == rows_of(1, 2, 3, 5)
    assert site.errors() == [
        ("r1", "2024-01-03"), ("r1", "2024-01-04"), ("r1", "2024-01-06"),
        ("r2", "2024-01-04"), ("r2", "2024-01-06"),
    ]
    assert statuses(site.run("r3")) == "SSSFSF"


def test_bad_files_fail_alone(site):
    sound = gzip.compress(b"id,score,n\n" + b"x,0.5,1\n" * 50_000)
    site.land(1)
    site.land(2, raw=b"")                     # no bytes: not seen as landed
    site.land(3, raw=sound[:40])              # cut off
    site.land(4, raw=b"not gzip at all")
    site.land(5, raw=sound[:-6] + b"\0\0\0\0\0\0")   # wrong checksum
    site.land(6)
    found = site.run("r1")
    assert statuses(found) == "LFFFFL"
    assert "404" in found[2].error
    assert all(found[n].error.startswith("unreadable file") for n in (3, 4, 5))
    assert site.store() == rows_of(1, 6)

    for n in (2, 3, 4, 5):
        site.land(n)
    assert statuses(site.run("r2")) == "SLLLLS"
    assert site.store() == rows_of(*range(1, 7))


def test_checks_name_what_is_wrong_at_any_size(site, monkeypatch):
    """Whole, joined, padded, cut and foreign files, in pieces of a few bytes and of many."""
    noise = os.urandom(5000).hex()
    texts = ["id,score,n\na,1,1\n", "#c\n\n\ufeffid,n\na\r\n\nno end", "\ufeffid\né\n", "\n", "", '"a,b",c\n', noise]
    for n, text in enumerate(texts):
        site.land(1, part=f"a b{n}.csv.gz", text=text)
    member = gzip.compress(b"id\n1\n2\n")
    site.land(2, part="joined.csv.gz", raw=member + gzip.compress(b"3\n") + gzip.compress(b""))
    site.land(2, part="no bytes.csv.gz", raw=b"")  # not listed
    broken = {"padded": member + b"\0" * 700, "tail": member + b"\n\n", "text": b"not gzip at all",
              "cut": gzip.compress(noise.encode())[:900], "header only": member[:10], "one more": member + b"\x1f",
              "checksum": member[:-8] + b"\0" * 8}
    for name, raw in broken.items():
        site.land(3, part=f"{name}.csv.gz", raw=raw)

    def checked():
        rows = landing.check_files(site.spark, [site.feed.landing], "#").collect()
        return {os.path.basename(r.file_path): (r.error, r.header, r.lines, r.bytes) for r in rows}

    whole = checked()
    monkeypatch.setattr(intask, "PIECE", 3)
    site.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert checked() == whole
    finally:
        site.spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sound = {k: v[1:] for k, v in whole.items() if v[0] is None}
    assert sound == {
        "a b0.csv.gz": (["id", "score", "n"], 2, 15), "a b1.csv.gz": (["id", "n"], 6, 17), "a b2.csv.gz": (["id"], 2, 4),
        "a b3.csv.gz": (None, 1, 0), "a b4.csv.gz": (None, 0, 0), "a b5.csv.gz": (["a,b", "c"], 1, 7),
        "a b6.csv.gz": ([noise], 1, 10000), "joined.csv.gz": (["id"], 4, 5)}
    errors = {k.removesuffix(".csv.gz"): v for k, v in whole.items() if v[0] is not None}
    assert errors.keys() == broken.keys()
    assert all(v[0].startswith("unreadable file: ") and v[1:] == (None, 0, 0) for v in errors.values())


def test_what_the_check_finds_unsound_the_load_cannot_read(site):
    """Hadoop's reader and the check agree about what a gzip file is."""
    member = gzip.compress(b"id,score,n\nx,0.5,1\n" * 2000)
    files = [member, member * 3, member + b"\0" * 512, member + b"\n", member[:-9], b"id,score,n\n", member + gzip.compress(b"")]
    for n, raw in enumerate(files):
        path = f"{site.root}/one{n}/scores-{day(1)}.csv.gz"
        os.makedirs(os.path.dirname(path))
        with open(path, "wb") as f:
            f.write(raw)
        error = landing.check_files(site.spark, [path]).first().error
        try:
            site.spark.read.text(path).count()
            assert error is None, n
        except Exception as e:
            assert error is not None and backfill_module.reading_fault(e), n


def test_errors_outside_the_files_are_no_verdict_on_them(site, monkeypatch):
    site.land(1)

    def lost(*_, **__):
        raise RuntimeError("lost executor")

    monkeypatch.setattr(landing, "check_raw", lost)
    with pytest.raises(Exception, match="lost executor"):
        landing.check_files(site.spark, [site.feed.landing]).collect()


@pytest.mark.parametrize("verify", [False, True])
def test_a_padded_file_fails_alone(site, verify):
    """Zeros behind the data, as tapes and block devices leave them: the reader of the load refuses them."""
    site.land(1)
    site.land(2, raw=gzip.compress(b"id,score,n\nx,0.5,1\n") + b"\0" * 512)
    site.land(3, raw=gzip.compress(b"id,score,n\n" + os.urandom(3000).hex().encode())[:900])
    site.land(4)
    found = site.run("r1", verify=verify)
    assert statuses(found) == "LFFLFF"
    assert all(found[n].error.startswith("unreadable file: ") for n in (2, 3))
    assert site.store() == rows_of(1, 4)


@pytest.mark.parametrize("verify", [False, True])
def test_days_only_the_load_cannot_read_fail_alone(site, verify):
    """Sound files, but no reader of the load's kind takes a row of so many cells."""
    for n in range(1, 7):
        site.land(n)
    for n in (2, 5):
        site.land(n, "id,score,n\n" + "," * 30_000 + "\n")
    found = site.run("r1", verify=verify)
    assert statuses(found) == "LFLLFL"
    assert all(found[n].error.startswith("unreadable file: ") and "Exception" in found[n].error for n in (2, 5))
    assert site.store() == rows_of(1, 3, 4, 6)
    site.land(2)
    assert statuses(site.run("r2")) == "SLSSFS"


def test_a_load_that_fails_for_other_reasons_is_not_halved(site, monkeypatch):
    for n in (1, 2, 3):
        site.land(n)
    calls = []

    def lost(*_):
        calls.append(1)
        raise RuntimeError("ExecutorLostFailure")

    with monkeypatch.context() as patch:
        patch.setattr(backfill_module, "write_days", lost)
        with pytest.raises(RuntimeError, match="ExecutorLost"):
            site.run("r1")
    assert calls == [1] and read_ledger(site.spark, site.feed.ledger).isEmpty()


@pytest.mark.parametrize("folder", ["2024", "2024/01", "2024/01/02", "file_name="])
def test_days_below_their_date(site, folder, tmp_path):
    """Listing, check, backfill and stream see the same days."""
    name = f"scores-{day(2)}.csv.gz"
    path = f"{site.feed.landing}/{folder}{'' if folder[-1] == '=' else '/'}{name}"
    os.makedirs(path)
    with open(f"{path}/part-0.csv.gz", "wb") as f:
        f.write(gzip.compress(b"id,score,n\na2,0.2,2\nb2,1.5,\n"))
    site.land(1)
    listed = landing.landing_files(site.spark, site.feed.landing, "scores").collect()
    assert {r.snapshot_date for r in listed} == {day(1), day(2)}
    assert statuses(site.run("r1")) == "LLFFFF"
    assert site.store() == rows_of(1, 2)
    site.feed = replace(site.feed, store=f"{site.root}/s2", ledger=f"{site.root}/l2")
    catch_up(site.spark, site.feed, str(tmp_path / "progress")).awaitTermination()
    assert site.store() == rows_of(1, 2)


@pytest.mark.parametrize("folder", ["old", "2023/01", "2024/02", "01", "2024/01/03", "a/2024"])
def test_days_in_other_folders_have_not_landed(site, folder, tmp_path):
    os.makedirs(f"{site.feed.landing}/{folder}")
    with open(f"{site.feed.landing}/{folder}/scores-{day(2)}.csv.gz", "wb") as f:
        f.write(gzip.compress(b"id,score,n\na2,0.2,2\n"))
    assert landing.landing_files(site.spark, site.feed.landing, "scores").isEmpty()
    assert statuses(site.run("r1")) == "FFFFFF"
    catch_up(site.spark, site.feed, str(tmp_path / "progress")).awaitTermination()
    assert read_ledger(site.spark, site.feed.ledger).where("status <> 'FAILED'").isEmpty()


def test_a_run_leaves_the_session_as_it_was(site):
    site.land(1)
    seen = []
    listed = site.spark.conf.getAll
    write = backfill_module.write_days
    try:
        backfill_module.write_days = lambda *a: (seen.append(site.spark.conf.getAll), write(*a))[1]
        site.run("r1")
    finally:
        backfill_module.write_days = write
    assert seen == [listed] and site.spark.conf.getAll == listed


def test_every_day_unreadable(site):
    for n in range(1, 7):
        site.land(n, raw=b"junk")
    assert statuses(site.run("r1")) == "FFFFFF"
    assert site.store() == []


def test_empty_snapshot_fails_but_header_only_is_present(site):
    site.land(1)
    site.land(2, text="")
    site.land(3, text="id,score,n\n")
    assert statuses(site.run("r1")) == "LFLFFF"
    assert site.run("r2")[2].error == "empty file"
    assert statuses(site.run("r3")) == "SFSFFF"
    assert site.store() == rows_of(1)


def test_header_of_another_schema_fails_that_day(site):
    site.land(1)
    site.land(2, text="id,n,score\na,1,0.5\n")
    site.land(3, text="id,score\na,0.5\n")
    found = site.run("r1")
    assert statuses(found) == "LFFFFF"
    assert found[2].error == "unexpected header: id,n,score"
    assert site.store() == rows_of(1)


def test_headers_are_compared_without_a_given_schema_too(site):
    site.feed = replace(site.feed, schema=None)
    site.land(1)
    site.land(2, text="id,n\na,1\n")
    found = site.run("r1")
    assert statuses(found) == "LFFFFF"
    assert found[2].error == "unexpected header: id,n"
    site.land(3, text="x,y,z\na,1,1\n")
    assert statuses(site.run("r2")) == "SFFFFF"
    assert len(site.spark.read.parquet(site.feed.store).collect()) == 2


def test_verify_checks_before_the_load(site, monkeypatch):
    site.land(1)
    site.land(2, raw=b"junk")
    loads = []
    write = backfill_module.write_days
    monkeypatch.setattr(backfill_module, "write_days", lambda *a: loads.append(1) or write(*a))
    assert statuses(site.run("r1", verify=True)) == "LFFFFF"
    assert loads == [1]
    site.land(2, raw=b"junk again")
    site.land(3)
    assert statuses(site.run("r2")) == "SFLFFF"
    assert loads == [1, 1, 1]


def test_header_names_can_be_ignored(site):
    site.feed = replace(site.feed, match_header=False)
    site.land(1, text="a,b,c\na1,0.1,1\nb1,1.5,\n")
    assert statuses(site.run("r1")) == "LFFFFF"
    assert site.store() == rows_of(1)


def test_only_header_only_days(site):
    site.land(1, text="id,score,n\n")
    assert statuses(site.run("r1")) == "LFFFFF"
    assert statuses(site.run("r2")) == "SFFFFF"


def test_byte_order_mark(site):
    site.land(1, text="\ufeffid,score,n\na1,0.1,1\nb1,1.5,\n")
    site.land(2)
    assert statuses(site.run("r1")) == "LLFFFF"
    assert site.store() == rows_of(1, 2)


def test_header_with_other_quoting_and_line_ends(site):
    site.land(1, text='"id","score",N\r\na1,0.1,1\r\nb1,1.5,\r\n')
    assert statuses(site.run("r1")) == "LFFFFF"
    assert site.store() == rows_of(1)


def test_several_gzip_members_in_a_file(site):
    parts = ["id,score,n\n", "a1,0.1,1\n", "b1,1.5,\n"]
    site.land(1, raw=b"".join(gzip.compress(p.encode()) for p in parts))
    site.land(2, raw=b"junk")
    assert statuses(site.run("r1")) == "LFFFFF"
    assert site.store() == rows_of(1)


def test_any_column_name(site):
    schema = T.StructType().add("a.b", T.LongType()).add("c d", T.StringType()).add("É(x)", T.DoubleType())
    text = "a.b,c d,É(x)\n1,x,0.5\n"
    site.land(1, text=text)
    for given in (schema, None):
        feed = replace(site.feed, schema=given, store=f"{site.root}/s{given is None}",
                       ledger=f"{site.root}/l{given is None}")
        assert load_day(site.spark, feed, day(1), "r1").first().status == "LOADED"
        assert tuple(site.spark.read.parquet(feed.store).first()) == (1, "x", 0.5, day(1))
        _, preview = inspect_snapshot(site.spark, feed, day(1))
        assert preview.columns == ["a.b", "c d", "É(x)", "snapshot_date"]
        strict = replace(feed, ledger=feed.ledger + "2")
        assert backfill(site.spark, strict, day(1), day(1), "r", strict=True).first().status == "LOADED"


def test_comment_line_before_the_header(site):
    text = "#v:1,date:2024-01-01\nid,score,n\na1,0.1,1\nb1,1.5,\n"
    site.land(1, text=text)
    assert statuses(site.run("r1")) == "FFFFFF"
    site.feed = replace(site.feed, comment="#")
    site.land(2, raw=b"junk")
    assert statuses(site.run("r2")) == "LFFFFF"
    assert site.store() == rows_of(1)


def test_parts_of_a_day(site):
    for n in range(3):
        site.land(1, part=f"part-0000{n}-u.csv.gz", text=f"id,score,n\na,{n},{n}\n")
    site.land(2, part="part-00000-u.csv.gz")
    site.land(2, part="part-00001-u.csv.gz", raw=b"junk")
    found = site.run("r1")
    assert statuses(found) == "LFFFFF"
    assert found[1].path.endswith("scores-2024-01-01.csv.gz")
    assert [r[3] for r in site.store()] == [0, 1, 2]


def test_two_places_for_one_day(site):
    site.land(1)
    os.makedirs(f"{site.feed.landing}/file_name=scores-2024-01-01.csv.gz")
    with open(f"{site.feed.landing}/file_name=scores-2024-01-01.csv.gz/part-0.csv.gz", "wb") as f:
        f.write(gzip.compress(b"id,score,n\nx,1,1\n"))
    found = site.run("r1")
    assert statuses(found) == "FFFFFF"
    assert "more than one" in found[1].error


def test_cells(site):
    site.land(1, text='id,score,n\n"a ""q"", b",NA,null\n"x\r\ny",NaN,None\n"",0.5,\n\nz, 7 ,7\n')
    assert statuses(site.run("r1")) == "LFFFFF"
    assert {r[1:] for r in site.store()} == {
        ('a "q", b', None, None), ("x\r\ny", None, None), (None, 0.5, None), ("z", 7.0, 7),
    }


def test_ragged_rows_are_kept_and_flagged(site):
    site.land(1, text="id,score,n\nok,1,1\nlong,2,2,2\nshort,3\nword,x,4\n")
    site.land(2)
    assert statuses(site.run("r1")) == "LLFFFF"
    assert [r[1:] for r in site.store()][:4] == [
        ("long", 2.0, 2), ("ok", 1.0, 1), ("short", 3.0, None), ("word", None, 4),
    ]
    rows = read_feed(site.spark, site.feed, SCHEMA, [site.feed.landing])
    store = site.stored()
    found = {r.snapshot_date.day: r for r in compare_days(rows, store, SCHEMA.names).collect()}
    assert (found[1].landing_rows, found[1].flagged_rows, found[1].same_content) == (4, 3, True)
    assert (found[2].landing_rows, found[2].flagged_rows, found[2].same_content) == (2, 0, True)


def test_strict_fails_days_with_flagged_rows(site):
    site.land(1, text="id,score,n\nlong,2,2,2\nshort,3\n")
    site.land(2)
    site.land(3, raw=b"junk")
    found = site.run("r1", strict=True)
    assert statuses(found) == "FLFFFF"
    assert found[1].error == "2 rows do not fit the schema"
    assert site.store() == rows_of(2)


def test_compare_days_sees_any_difference(site):
    for n in (1, 2, 3, 4):
        site.land(n)
    site.run("r1")
    site.land(1, text="id,score,n\na1,0.1,1\nb1,1.25,\n")  # a cell
    site.land(2, text="id,score,n\na2,0.2,2\n")            # a row
    site.land(5)                                           # a day
    rows = read_feed(site.spark, site.feed, SCHEMA, [site.feed.landing])
    store = site.stored()
    found = compare_days(rows, store, SCHEMA.names).collect()
    assert {r.snapshot_date.day: r.same_content for r in found} == {
        1: False, 2: False, 3: True, 4: True, 5: False,
    }


def test_single_day(site):
    site.land(2)
    row = load_day(site.spark, site.feed, day(2), "r1").collect()
    assert [(r.snapshot_date, r.status) for r in row] == [(day(2), "LOADED")]
    assert load_day(site.spark, site.feed, day(2), "r2").first().status == "SKIPPED"
    assert load_day(site.spark, site.feed, day(3), "r3").first().status == "FAILED"
    assert statuses(site.run("r4")) == "FSFFFF"


def test_reversed_range_does_nothing(site):
    assert backfill(site.spark, site.feed, END, START, "r1").isEmpty()
    assert site.errors() == []


def test_crash_before_the_ledger_leads_to_a_clean_retry(site, monkeypatch):
    site.land(1)
    site.land(2)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr("daybook.sources.ledger.append_outcomes", crash)
        with pytest.raises(RuntimeError):
            site.run("r1")
    assert loaded_days(read_ledger(site.spark, site.feed.ledger)).isEmpty()
    assert statuses(site.run("r2")) == "LLFFFF"
    assert site.store() == rows_of(1, 2)


def test_errors_that_are_no_fault_of_the_files_surface(site, monkeypatch):
    site.land(1)

    def broken(*_):
        raise RuntimeError("store is down")

    monkeypatch.setattr("daybook.plans.backfill.write_days", broken)
    with pytest.raises(RuntimeError):
        site.run("r1")
    assert read_ledger(site.spark, site.feed.ledger).isEmpty()


def test_store_prunes_partitions(site):
    for n in range(1, 7):
        site.land(n)
    site.run("r1")
    one = site.stored().where(F.col("snapshot_date") == day(3))
    assert len(one.inputFiles()) >= 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan
    assert {r.snapshot_date: r.rows for r in daily_counts(one).collect()} == {day(3): 2}


def test_listing_prunes_files_before_tasks(site):
    for n in range(1, 7):
        site.land(n)
    every = landing.landing_files(site.spark, site.feed.landing, "scores")
    one = landing.landing_files(
        site.spark, site.feed.landing, "scores", ["scores-2024-01-03.csv.gz"]
    )
    assert every.count() == 6
    assert [r.snapshot_date for r in one.collect()] == [day(3)]
    assert one.rdd.getNumPartitions() == 1


def test_other_files_in_the_landing_are_ignored(site):
    site.land(1)
    for name in ("notes.txt", "scores-2024-01-02.csv", "other-2024-01-03.csv.gz",
                 "xscores-2024-01-04.csv.gz"):
        with open(f"{site.feed.landing}/{name}", "wb") as f:
            f.write(gzip.compress(b"id,score,n\nz,1,1\n"))
    assert statuses(site.run("r1")) == "LFFFFF"


def test_types_are_inferred_from_all_cells(site):
    site.feed = replace(site.feed, schema=None)
    site.land(1, text="i,f,b,s,d,e,t\n1,1,True,x,2024-01-01,,1d\n-2,.5,,1,2024-01-02,NA,2\n")
    site.land(2, text="i,f,b,s,d,e,t\n,1e3,True,2,2024-01-03,,3\n+3,inf,False,,2024-01-04,,4\n")
    schema = infer_schema(site.spark, [site.feed.landing])
    assert {f.name: f.dataType.simpleString() for f in schema} == {
        "i": "bigint", "f": "double", "b": "boolean", "s": "string", "d": "string",
        "e": "double", "t": "string",
    }
    found = backfill(site.spark, site.feed, day(1), day(2), "r1").collect()
    assert [r.status for r in found] == ["LOADED", "LOADED"]
    # Later days follow the store's columns, whatever they would infer to alone.
    site.land(3, text="i,f,b,s,d,e,t\n1,1,True,2,2024-01-01,,5\n")
    backfill(site.spark, site.feed, day(3), day(3), "r2").collect()
    stored = site.spark.read.parquet(site.feed.store)
    assert stored.where("t = '5' and i = 1").count() == 1


def test_inspect(site):
    body = "".join(f"r{i},{i}.5,{i}\n" for i in range(250))
    site.land(1, text="id,score,n\n" + body)
    lines, preview = inspect_snapshot(site.spark, site.feed, day(1))
    labels = [r.label for r in lines.orderBy("line_no").collect()]
    assert labels[:2] == ["Line 1: id,score,n", "Line 2: r0,0.5,0"]
    assert len(labels) == 251
    rows = preview.collect()
    assert [r.id for r in rows] == [f"r{i}" for i in range(100)]
    assert preview.columns == ["id", "score", "n", "snapshot_date"]


def test_inspect_a_day_of_parts(site):
    for part in ("00001", "00000", "100000"):
        site.land(1, part=f"part-{part}-u.csv.gz", text=f"id,score,n\n{part},1,1\n")
    lines, preview = inspect_snapshot(site.spark, site.feed, day(1), n=2)
    assert [r.line.split(",")[0] for r in lines.orderBy("line_no").collect()] == [
        "id", "00000", "id", "00001", "id", "100000",
    ]
    assert [r.id for r in preview.collect()] == ["00000", "00001"]


def test_preview_reads_on_until_it_has_enough(site):
    for part in range(12):
        rows = "".join(f"{part}-{i},1,1\n" for i in range(part % 3))
        site.land(1, part=f"part-{part:05d}-u.csv.gz", text="id,score,n\n" + rows)
    _, preview = inspect_snapshot(site.spark, site.feed, day(1), n=4)
    assert [r.id for r in preview.collect()] == ["1-0", "2-0", "2-1", "4-0"]
    _, preview = inspect_snapshot(site.spark, site.feed, day(1), n=99)
    assert preview.count() == 12


def test_preview_is_a_limit_and_reads_each_part_once(site, monkeypatch):
    """No sort, no second pass, and no further part than the rows need."""
    for part in range(5):
        rows = "".join(f"{part}-{i},1,1\n" for i in range(3))
        site.land(1, part=f"part-{part:05d}-u.csv.gz", text="id,score,n\n" + rows)
    read, plans = [], []
    once, settle = inspection.read_feed, inspection.settle

    def settled(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df)

    monkeypatch.setattr(inspection, "read_feed", lambda *a: (read.append(a[3]), once(*a))[1])
    monkeypatch.setattr(inspection, "settle", settled)
    preview = inspection.preview_snapshot(site.spark, site.feed, day(1), n=7)
    assert [r.id for r in preview.collect()] == ["0-0", "0-1", "0-2", "1-0", "1-1", "1-2", "2-0"]
    assert [len(p) for p in read] == [1, 1, 1] and len({p[0] for p in read}) == 3
    assert all("Limit" in p and "Sort" not in p and "TakeOrdered" not in p for p in plans)


def test_preview_has_the_types_of_the_load(site):
    """Also where the first part alone would show others."""
    site.feed = replace(site.feed, schema=None)
    site.land(1, part="part-00000-u.csv.gz", text="id,v\na,1\nb,2\n")
    site.land(1, part="part-00001-u.csv.gz", text="id,v\nc,x\n")
    _, preview = inspect_snapshot(site.spark, site.feed, day(1), n=1)
    before = preview.dtypes
    assert site.run("r1")[1].status == "LOADED"
    assert before == site.spark.read.parquet(site.feed.store).dtypes == [
        ("id", "string"), ("v", "string"), ("snapshot_date", "date")]


def test_inspect_an_absent_day(site):
    with pytest.raises(FileNotFoundError):
        inspect_snapshot(site.spark, site.feed, day(1))


def test_stream_takes_each_file_once(site, tmp_path):
    progress = str(tmp_path / "progress")
    for n in (1, 2):
        site.land(n)
    for _ in range(2):
        catch_up(site.spark, site.feed, progress).awaitTermination()
        assert site.store() == rows_of(1, 2)
    site.land(3)
    site.land(4, part="part-00000-u.csv.gz")
    catch_up(site.spark, site.feed, progress).awaitTermination()
    assert site.store() == rows_of(1, 2, 3, 4)


def test_unsound_days_of_nothing(site):
    assert unsound_days(site.spark, site.feed, []).isEmpty()


def test_feed_is_checked():
    with pytest.raises(ValueError):
        Feed("a/b", "l", "s", "g", "e", "u")
    with pytest.raises(ValueError):
        Feed("a", "l", "s", "g", "e", "u", T.StructType().add("snapshot_date", T.DateType()))
