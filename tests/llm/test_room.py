"""What stages leave behind: shuffle files on disk, tables in the workers that Spark uses again."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from daybook.llm import bpe, language, neighbours


def shuffle_files(spark):
    """Names and bytes of the shuffle files that there are."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}


def test_rounds_leave_no_shuffle_files(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, x) for i, x in enumerate(rng.standard_normal((600, 16)).astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, old, seen = spark.conf.get(key), shuffle_files(spark), set()

    def watched(frame, settle=neighbours.settle):
        settled = settle(frame)
        seen.update(shuffle_files(spark).keys() - old.keys())
        return settled

    monkeypatch.setattr(neighbours, "settle", watched)
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0)
    for _ in range(20):  # files are removed beside the next step
        left = shuffle_files(spark).keys() - old.keys()
        if not left:
            break
        time.sleep(0.2)
    assert not left, (len(left), len(seen))
    assert got.count() == 12 * 5 and spark.conf.get(key) == before


def test_language_task_drops_the_tokenizers_tables(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")

    def held(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([bpe.codec.cache_info().currsize] * part.num_rows)], names=["n"])

    docs = spark.range(64).repartition(64).select(
        F.col("id").alias("doc_id"), F.lit("the cat sat on the mat").alias("text"))
    assert bpe.encode_decode(docs, path).where("n_tokens > 0").count() == 64
    ids = docs.select("doc_id")
    assert ids.mapInArrow(held, "n bigint").agg(F.max("n")).first()[0] > 0
    model = language.build({"en": ["the cat and the dog"], "xx": ["zyx wvu tsr"]})
    assert language.identify(docs, model).where("lang_pred = 'en'").count() == 64
    assert ids.mapInArrow(held, "n bigint").agg(F.max("n")).first()[0] == 0
