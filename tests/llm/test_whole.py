"""Cases in which an operator once did less than the whole job."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from daybook.llm import language, neighbours


def vectors(spark, v):
    return spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id bigint, embedding array<float>")


def recall(df, v, step, k=5):
    """Share of the true neighbours found, and the fewest found of a query."""
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % step == 0, k).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    x = v.astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    hit = []
    for q in range(0, len(v), step):
        s = x @ x[q]
        s[q] = -3
        hit.append(len(set(np.argsort(-s)[:k].tolist()) & found.get(q, set())) / k)
    return np.mean(hit), min(len(found.get(q, ())) for q in range(0, len(v), step))


def test_neighbours_among_near_copies(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.standard_normal(32) + noise * rng.standard_normal((300, 32)) for noise in (1e-2, 1e-3)])
    v = v.astype(np.float32)
    share, _ = recall(vectors(spark, v), v, 10)
    assert share >= 0.95


def test_neighbours_of_lone_vectors(spark, monkeypatch):
    """Vectors off the centre share their side of most planes; one opposite is in no cell with another."""
    monkeypatch.setattr(neighbours, "BLOCK", 8)  # cells as fine as in a large table
    rng = np.random.default_rng(6)
    v = (rng.standard_normal((640, 32)) + 10).astype(np.float32)
    v[0] *= -1
    _, fewest = recall(vectors(spark, v), v, 20)
    assert fewest == 5
    few = vectors(spark, v[:4])
    assert neighbours.nearest(few, F.lit(True)).groupBy("query_id").count().where("count = 3").count() == 4


def test_copies_leave_a_label_its_sample(spark):
    """Copies, null and letterless texts take nothing of the share of a label's distinct texts."""
    copies = spark.range(40_000).select(F.lit("a").alias("lang"), F.when(F.col("id") % 3 > 0, "one text").when(
        F.col("id") % 2 == 0, "1 2").alias("text"))
    others = spark.range(600).select(F.lit("a").alias("lang"), F.concat(F.lit("text no "), "id").alias("text"))
    got = language.sample(copies.union(others))
    assert len(got["a"]) == len(set(got["a"])) == language.SAMPLE_DOCS


def test_documents_stay_if_no_language_is_learned(spark):
    docs = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "1 2", None, "s", 3), (3, None, "en", "s", 0)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r.doc_id for r in corpus_pipeline.keep_languages(spark, docs, "").collect()] == [1]


def test_no_task_has_more_than_a_block_of_the_cells_that_hold_all(spark, monkeypatch):
    """Vectors are dealt by the number of their block, not by cells that any number may share."""
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    rng = np.random.default_rng(4)
    near = rng.standard_normal(16) + 1e-3 * rng.standard_normal((600, 16))  # one cell in every table
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "vec_id bigint, embedding array<double>")
    points = neighbours._sketched(neighbours._points(neighbours.usable(df), 2).where("vec_id = node"), 4, "f8").cache()
    blocks = neighbours._blocks(points)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.index("hashpartitioning(dim") < plan.index("Join")  # the outermost exchange
    first = plan[plan.index("hashpartitioning(dim"):].split("\n")[0]
    assert all(name in first for name in ("dim", "t#", "code", "part"))
    sizes = blocks.groupBy("dim", "t", "code", "part").count().collect()
    assert max(r["count"] for r in sizes) <= 4 * 8
    assert {r.t for r in sizes} == set(range(16))
    assert blocks.groupBy("node", "t").count().where("count <> 1").isEmpty() and blocks.count() == 600 * 16


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_language_stage_goes_by_the_model(spark, monkeypatch):
    """Labels are filled in and put right, and what no language explains goes, though it has letters."""
    rng = np.random.default_rng(8)
    words = {"a": ["anba", "cada", "beda", "dacan"], "b": ["xyzu", "wuvy", "zuwx", "vyxu"]}
    rows = [(i, " ".join(rng.choice(words[k], 40)), k) for i, k in enumerate("ab" * 300)]
    rows += [(1000, " ".join(rng.choice(words["a"], 20)), None), (1001, " ".join(rng.choice(words["b"], 20)), "a")]
    rows += [(1002, "".join(rng.choice(list("abcdenuvwxyz"), 300)), None), (1003, None, "a"), (1004, "12 34", "b")]
    # A sample of some of the texts, as in a corpus, so that a text is not among what it is held against.
    sample = language.sample
    monkeypatch.setattr(language, "sample", lambda docs: sample(docs, 15))
    docs = spark.createDataFrame([(d, t, k, "s", len(t or "")) for d, t, k in rows], DOCS)
    got = corpus_pipeline.keep_languages(spark, docs, "")
    assert got.columns == docs.columns
    labels = {r.doc_id: r.lang for r in got.collect()}
    assert labels == {**{i: k for i, k in enumerate("ab" * 300)}, 1000: "a", 1001: "b"}


def test_near_copies_of_rows_that_share_a_doc_id(spark):
    """Only copies go, whatever the doc_ids; of rows equal in doc_id and text one stays."""
    text = [f"text {c} " + " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(1, text[0], "x"), (1, text[1], "x"), (2, text[2], "x"), (3, text[3], "x"), (3, text[2], "x"),
            (1, text[0], "w"), (None, text[0], "x"), (None, text[0], "x")]
    docs = spark.createDataFrame([(d, t, k, "s", len(t)) for d, t, k in rows], DOCS).repartition(4)
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    found = sorted((r.doc_id or 0, r.text, r.lang) for r in got.collect())
    assert found == sorted([(1, text[0], "w"), (1, text[1], "x"), (2, text[2], "x"), (3, text[3], "x"),
                            (0, text[0], "x"), (0, text[0], "x")])
    assert corpus_pipeline.keep_one_of_near_copies(spark, docs.limit(0), "").count() == 0
