"""Spelling variants against a comparison of all words with all others."""

import random
import re
import zlib
from collections import Counter

import pytest

from daybook.llm import spelling

SF_DIR = "/root/testdata/sf0.001"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(rows, least=7):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= least and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def grouped(n):
    words = sorted(n, key=len)
    near = {w: [] for w in n}
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if len(b) > len(a) + 1:
                break
            if one_apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    assert dict(df.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint",
                               "n_near": "bigint", "form_n": "bigint"}
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.fixture(scope="module")
def texts():
    """Misspellings of misspellings, ties, anagrams, words that only differ at an end, long words."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 11))) for _ in range(60)]
    base += ["necessary", "aaaaaaaa", "aaaaaaa", "abababab", "x" * 300, "ÀÉÎÕÜßÿ", "listens", "silents"]
    rows = []
    for w in base:
        many = rng.choice([2, 3, 40, 200])
        rows += [w] * many
        for _ in range(6):
            i, k = rng.randrange(len(w)), rng.randrange(3)
            v = w[:i] + (rng.choice("abcxyzéÀ×") if k else "") + w[i + (k < 2):]
            rows += [v] * rng.choice([1, 2, 2, 4, 20])
    rows += ["chainword"] * 600 + ["chainwordx"] * 50 + ["chainwordxy"] * 3
    rng.shuffle(rows)
    docs = [(i, " ".join(rows[i::90])) for i in range(90)]
    docs += [(None, "Necessary NECESSARY, necessry necessry"), (None, None), (7, ""), (7, docs[7][1]), (3, "ΝΕ日 short")]
    return docs


def frame(spark, rows):
    # Extra columns with names that the operator uses for its own.
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows],
                                 "doc_id bigint, text string, n int, word string, key int").repartition(6)


def test_groups_are_those_of_all_pairs(spark, texts):
    want = grouped(counted(texts))
    assert any(r[2] != r[0] and r[2] != r[1] for r in want)  # a form's form
    assert result(spelling.group_spellings(frame(spark, texts))) == want


def test_hot_signatures_lose_nothing(spark, texts, monkeypatch):
    monkeypatch.setattr(spelling, "HOT", 2)
    monkeypatch.setattr(spelling, "LETTERS", 50)
    assert result(spelling.group_spellings(frame(spark, texts))) == grouped(counted(texts))


def test_keys_may_run_over_batches(spark, texts, monkeypatch):
    words = spelling.count_words(frame(spark, texts)).where("n >= 2").cache()
    once = spelling.near_words(words).count()
    rows = words.mapInArrow(spelling._sign, spelling.SIGNED).toPandas().sort_values(["key", "shorter", "word"])
    monkeypatch.setattr(spelling, "ROWS", 5)
    import pyarrow as pa

    table = pa.Table.from_pandas(rows, preserve_index=False)
    found = list(spelling._verify(iter(table.to_batches(max_chunksize=3))))
    assert sum(b.num_rows for b in found) == once
    pairs = [(r["word"], r["near"]) for b in found for r in b.to_pylist()]
    assert len(pairs) == len(set(pairs))


def test_many_words_with_one_third_in_common(spark):
    """A third of all words share all but a third of their letters."""
    rng = random.Random(1)
    words = {"international" + "".join(rng.choice("abcd") for _ in range(6)) for _ in range(900)}
    words |= {"".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(900)}
    rows = [(i, f"{w} {w}") for i, w in enumerate(sorted(words))]
    assert result(spelling.group_spellings(frame(spark, rows))) == grouped(counted(rows))


def test_tables_without_words(spark):
    for rows in ([], [(1, None), (2, ""), (3, "short 123")]):
        assert result(spelling.group_spellings(frame(spark, rows))) == []


def test_query_is_the_comparison_of_all_words(spark):
    from daybook.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert result(QUERIES["op11_spelling_variants"](spark, SF_DIR)) == grouped(counted(docs))
