"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes its result as
Parquet in the shared folder and hands what it reads back to the next. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import language, lines, packing, repeats, simhash
from daybook.session import scratch, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame, text: Column) -> DataFrame:
    return df.withColumn("text", text).withColumn(
        "n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


#: Lead over the second language from which the label that a text came with gives way.
SURE = 0.2


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found, labelled with it.

    A document goes if its text is null, has no letter, or takes as many bits a
    character in every language as letters drawn at random. A missing label
    becomes the language found, and so does another one that it leads by
    ``SURE``. Where no label teaches a language, all documents with letters stay.
    """
    model = language.learn(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language.identify(docs, model, keep=COLUMNS).where(
        (F.col("lang_pred") != language.UNKNOWN) & (F.col("bits") < model.letter_bits))
    label = F.when(F.col("lang").isNull() | (F.col("score") >= SURE), F.col("lang_pred")).otherwise(F.col("lang"))
    return found.withColumn("lang", label).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier one repeats; documents that lose all of them go."""
    left = lines.dedup_lines(docs, max_edits=1, min_chars=20, counts=("__lines", "__dropped"))
    emptied = (F.col("__dropped") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    return _documents(left.where(~emptied), F.col("text"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id, and then hash of its text, once.

    Rows that share a doc_id are documents of their own if their texts differ.
    Of rows equal in both the one stays whose other columns order first.
    Documents without doc_id cannot be told apart and stay.
    """
    docs = docs.select(*COLUMNS).withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = settle(simhash.near_duplicates(
        docs.where("doc_id IS NOT NULL"), radius=3, shingle=3, keep=("doc_id", "__th")))
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "__th")).alias("f")).select("f.doc_id", "f.__th")
    again = found.groupBy("doc_id", "__th").count().where("count > 1").select("doc_id", "__th")
    kept = docs.join(settle(first), ["doc_id", "__th"], "left_semi")
    once = kept.join(again, ["doc_id", "__th"], "left_anti").select(*COLUMNS)
    row = F.min(F.struct("lang", "source", "n_chars", "text")).alias("r")
    of_many = kept.join(again, ["doc_id", "__th"], "left_semi").groupBy("doc_id", "__th").agg(row).select(
        "doc_id", "r.*").select(*COLUMNS)
    return once.union(of_many).union(docs.where("doc_id IS NULL").select(*COLUMNS))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the stretches of 200 bytes and more that start elsewhere, too.

    Bytes of a character that is cut in the middle go with it. Documents that
    nothing is left of go.
    """
    cut = repeats.cut_repeats(docs, length=200, keep=COLUMNS)
    whole = F.size("begins") == 0
    text = F.when(whole, F.col("text")).otherwise(_valid(F.col("kept")))
    left = cut.withColumn("text", text)
    return _documents(left.where(whole | F.col("text").rlike(r"\S")), F.col("text"))


def _valid(data: Column) -> Column:
    """Bytes as text, without those that belong to no whole character."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("\ufffd"), F.lit(""))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens in as few sequences of 4096 as best fit finds."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), packing.Capacity(tokens=4096), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", keep_languages),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("suffix-array dedup", cut_passages),
    ("best-fit packing", pack_sequences),
]

#: Language ID, SimHash's hash, suffix arrays and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
