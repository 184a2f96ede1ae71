import gzip
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daybook.constants import NULL_TOKENS
from daybook.functions.text import line_label, present, strip
from daybook.sources.lines import lines_across_parts, lines_of_file, lines_of_files, text_lines


def python_lines(text):
    return [line.strip() for line in io.StringIO(text, newline=None)]


def spark_lines(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = [[] for _ in texts]
    for r in text_lines(rows, "id", "text").orderBy("id", "line_no").collect():
        found[r.id].append(r.line)
        assert r.line_no == len(found[r.id])
    return found


def test_strip_agrees_with_python_on_every_character(spark):
    # Surrogates are not characters of a file.
    chars = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame(
        [(f"{chr(c)}a{chr(c)}b{chr(c)}",) for c in chars if c < 0x3100 or c % 997 == 0],
        "text string",
    )
    wrong = [r for r in rows.select("text", strip(F.col("text")).alias("s")).collect()
             if r.text.strip() != r.s]
    assert wrong == []


def test_line_breaks(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\rb\r\nc\nd", "\r\n\r\n", "a\r", " \t a\xa0\x1c \n\x0b"]
    assert spark_lines(spark, texts) == [python_lines(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\r\n\x0b\x0c\x85 　", max_size=40), min_size=20, max_size=60))
def test_lines_agree_with_python(spark, texts):
    assert spark_lines(spark, texts) == [python_lines(t) for t in texts]


def test_null_text_has_no_lines(spark):
    rows = spark.createDataFrame([(1, None)], "id int, text string")
    assert text_lines(rows, "id", "text").count() == 0


def test_label(spark):
    row = spark.range(1).select(line_label(F.lit(3), F.lit("x"))).first()
    assert row[0] == "Line 3: x"


def test_missing_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in (*NULL_TOKENS, "0", "na", " ")], "c string")
    kept = rows.select(present(F.col("c")).alias("c")).where("c is not null").collect()
    assert [r.c for r in kept] == ["0", "na", " "]
    assert rows.select(present(F.col("c"), ()).alias("c")).where("c is null").isEmpty()


@pytest.fixture
def gz(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(gzip.compress(text.encode()))
        return str(path)

    return write


def test_file_lines_number_each_file_from_one(spark, gz):
    texts = {f"f{i}.csv.gz": "".join(f" {i}-{n}\t\n" for n in range(i * 7)) for i in range(12)}
    texts["long.csv.gz"] = "".join(f"{n}\r\n" for n in range(25_000))
    texts["mixed.csv.gz"] = "a\rb\r\n\r\n c \nd"
    paths = {gz(name, text): text for name, text in texts.items()}
    found = {}
    for r in lines_of_files(spark, list(paths)).collect():
        found.setdefault(r.file_path.removeprefix("file:"), {})[r.line_no] = r.line
    for path, text in paths.items():
        expected = dict(enumerate(python_lines(text), 1))
        assert found.get(path, {}) == expected


def test_lines_of_one_file(spark, gz):
    text = "".join(f" {n}\r\n" for n in range(25_000))
    rows = lines_of_file(spark, gz("one.csv.gz", text)).collect()
    assert [tuple(r) for r in rows] == list(enumerate(python_lines(text), 1))


def test_filters_do_not_change_the_numbers(spark, gz):
    paths = [gz(f"f{i}.csv.gz", "x\n\n" * 30) for i in range(3)]
    kept = lines_of_files(spark, paths).where("line = ''").collect()
    assert sorted(r.line_no for r in kept) == sorted(list(range(2, 61, 2)) * 3)


def test_numbering_goes_on_across_parts(spark, gz, tmp_path):
    # part-100000 comes after part-99999, which text order would not give.
    for part, text in (("99999", "a\nb\n"), ("100000", "c\n"), ("00002", "x\ny\nz\n")):
        gz(f"s-2024-01-01.csv.gz/part-{part}-u.csv.gz", text)
    gz("s-2024-01-02.csv.gz/part-00000-u.csv.gz", "only\n")
    folders = [str(tmp_path / f"s-2024-01-0{i}.csv.gz") for i in (1, 2)]
    rows = lines_across_parts(spark, folders).collect()
    days = [sorted((r.line_no, r.line) for r in rows if r.folder.endswith(f)) for f in folders]
    assert days == [list(enumerate("xyzabc", 1)), [(1, "only")]]
