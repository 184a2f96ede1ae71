"""Scores of the suffix tree against a model counted in one dictionary."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from daybook.llm import suffixtree
from daybook.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, held boolean, chunk int, row string, score int"
SF_DIR = "/root/testdata/sf0.001"


def tokens_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lower) + [None]


def by_hand(rows, settings=suffixtree.Settings()):
    """doc_id, held out, n_tokens, n_known, train_tokens, base_score, score by counting every context."""
    texts = [(doc, bool(held), tokens_of(text)) for doc, text, held in rows]
    counts = Counter()  # of the n-grams of training texts
    for _, held, tokens in texts:
        if not held:
            for n in range(1, settings.depth + 2):
                counts.update(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))
    words = {g[0]: c for g, c in counts.items() if len(g) == 1}
    total, distinct = sum(words.values()), len(words)
    bound = math.log(max(total, 2))
    kept: set[tuple] = set()  # retained contexts

    def unigram(w):
        return (words.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))

    def chance(history, w, longest):
        """Probability of w after the words of history, by retained contexts of up to ``longest`` words."""
        p = unigram(w)
        for n in range(1, min(longest, len(history)) + 1):
            context = tuple(history[-n:])
            if context in kept:
                weight = settings.weights[n - 1]
                p = (counts[(*context, w)] + weight * p) / (counts[context] + weight)
        return p

    def grown(context):
        """Whether the last word of a context of two or more comes more often than its suffix says."""
        if len(context) == 1:
            return True
        *head, w = context
        count = counts[context]
        return (count >= 2 and grown(tuple(head)) and count * math.log(
            count / (counts[tuple(head)] * chance(head, w, len(head) - 1))) >= settings.grow * bound)

    for n in range(1, settings.depth + 1):
        weight, gains = settings.weights[n - 1], Counter()
        for gram, count in counts.items():
            context, w = gram[:-1], gram[-1]
            if len(context) == n and grown(context):
                p = chance(context, w, n - 1)
                gain = math.log((count - 1 + weight * p) / (counts[context] - 1 + weight) / p)
                gains[context] += count * round(gain * suffixtree.STEPS)
        kept |= {c for c, g in gains.items() if g > settings.retain * bound * suffixtree.STEPS}
    out = []
    for doc, held, tokens in texts:
        base = sum(math.log10(unigram(w)) for w in tokens)
        score = sum(math.log10(chance(tokens[:i], w, settings.depth)) for i, w in enumerate(tokens))
        out.append((doc, held, len(tokens), sum(w in words for w in tokens), total, base, score))
    return out, kept


def order(r):
    return r[0] is not None, r[0] or 0, r[2:]


def alike(df, rows, settings=suffixtree.Settings()):
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"),
                         ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    want, kept = by_hand(rows, settings)
    got = sorted((tuple(r) for r in df.collect()), key=order)
    want = sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-6)
    return kept


@pytest.fixture(scope="module")
def rows():
    """A language with dependent words, copies, held-out copies, odd white space, unknown words, empty texts."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("An", "be", "çà", "do") for b in ("x", "y", "z", "é", "")]

    def text(n):
        out = [rng.choice(words)]
        for _ in range(n):
            out.append(words[(words.index(out[-1]) * 3 + 1) % 20] if rng.random() < 0.6 else rng.choice(words))
        return rng.choice([" ", "  ", "\n", "\t\x0b"]).join(out)

    texts = [text(rng.randint(1, 120)) for _ in range(70)]
    texts += [texts[0]] * 8 + [texts[1] + " unknown" + str(i) for i in range(5)]
    texts += ["", None, " \n ", "x", "   ", "ABC abc ÀÉ àé", "word " * 300]
    out = [(i, t, i % 5 == 1) for i, t in enumerate(texts)]
    return out + [(None, texts[2], None), (None, "unknown only", True), (3, texts[4], False), (3, texts[4], False)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "r", 2) for r in rows], SCHEMA).repartition(4)


SMALL = suffixtree.Settings(weights=(4.0, 2.0), grow=0.3, retain=0.5)


def test_scores_are_those_by_hand(spark, rows):
    kept = alike(suffixtree.suffix_tree_scores(frame(spark, rows), F.col("held"), SMALL), rows, SMALL)
    assert {len(c) for c in kept} == {1, 2}  # of either length some, and not all
    assert len(kept) < 400


@pytest.mark.parametrize("weights", [(), (3.0,), (4.0, 2.0, 1.0)])
def test_other_depths(spark, rows, weights):
    settings = suffixtree.Settings(weights, 0.3, 0.5)
    alike(suffixtree.suffix_tree_scores(frame(spark, rows), F.col("held"), settings), rows, settings)


def test_cutting_texts_changes_nothing(spark, rows, monkeypatch):
    """Texts longer than a chunk, and chunks in several ranges of keys."""
    import pyarrow as pa

    class Place:
        partitionId = staticmethod(lambda: 0)
        get = classmethod(lambda cls: cls)

    monkeypatch.setattr(suffixtree, "TaskContext", Place)
    monkeypatch.setattr(suffixtree, "CHUNK", 200)
    monkeypatch.setattr(suffixtree, "SLICE", 60)
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "held": [bool(r[2]) for r in rows],
                                        "text": [r[1] for r in rows]})
    cut = list(suffixtree._cut(iter([batch]), 2))
    assert len(cut) > 50 and any(not w for b in cut for w in b.column("whole").to_pylist()[0])
    # The same steps as in the query, chunk by chunk.
    chunks = [b.to_pylist()[0] for b in cut]

    def exchange(blocks):
        by = {}
        for row in blocks:
            by.setdefault(row[:2], []).append(row)
        return [r for rows in by.values() for r in suffixtree._sum_range(suffixtree._asked_rows(rows)).to_pylist()]

    def known(answers, chunk):
        return suffixtree._Answers(pa.Table.from_pylist([r for r in answers if r["chunk"] == chunk["chunk"]]))

    asked = []
    for chunk in chunks:
        local = suffixtree._Local(chunk, SMALL)
        asked += suffixtree._blocks(0, chunk["chunk"], *local.asked(), 3)
        local.grow()
        local.climb()
        asked += suffixtree._blocks(2, chunk["chunk"], *local.asked(), 4)
    answers = exchange(asked)
    corpus = tuple(sum(r[c] for r in answers if r["kind"] == 0) for c in ("present", "amount"))
    for level in (1, 2):
        asked = []
        for chunk in chunks:
            local = suffixtree._climbed(chunk, known(answers, chunk), level, SMALL, corpus)
            asked += suffixtree._blocks(2 * level + 1, chunk["chunk"], *local.divergences(), 2)
            if level == 1:
                local.grow()
                local.climb()
                asked += suffixtree._blocks(4, chunk["chunk"], *local.asked(), 1)
        answers += exchange(asked)
    found = {}
    for chunk in chunks:
        local = suffixtree._climbed(chunk, known(answers, chunk), 2, SMALL, corpus)
        local.retain(known(answers, chunk).of(5))
        got = local.scores(chunk)
        for row, *values in zip(got["row"], got["n_tokens"], got["n_known"], got["base_score"], got["score"], strict=True):
            found[row] = [a + b for a, b in zip(found.get(row, [0, 0, 0, 0]), values, strict=True)]
    want, _ = by_hand(rows, SMALL)
    for row, w in zip(sorted(found), want, strict=True):
        assert found[row][:2] == [w[2], w[3]]
        assert found[row][2:] == pytest.approx(list(w[5:]), rel=1e-6)


def test_nothing_to_learn_from(spark):
    held = [(1, "some words", True), (2, None, True)]
    alike(suffixtree.suffix_tree_scores(frame(spark, held), F.col("held")), held)
    assert suffixtree.suffix_tree_scores(frame(spark, []), F.col("held")).count() == 0


def test_query_counts_and_predicts(spark):
    name = "op12_suffix_tree_scores"
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
            for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES[name](spark, SF_DIR)
    alike(got, rows)
    held = got.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]
