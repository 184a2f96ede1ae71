"""Removal of byte strings that start at more than one place, by suffix arrays.

Equal strings of ``length`` bytes have equal least hashes of the ``GRAM``-byte
pieces inside them, so they meet under the same key whichever documents they are
in. A run of neighbouring starts with one key is a segment of text. Keys that
occur once in all documents have no partner and go no further; the segments of
the others are sorted as suffix arrays, each distinct one once, some megabytes of
whole keys at a time, and neighbours whose common prefix is long enough are
repeats. Where a segment lies is joined to what was found in it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.shipping import ship
from daybook.llm.suffixes import repeated_starts
from daybook.session import settle

#: Bytes of the pieces that are hashed.
GRAM = 32
#: Starts of one segment at most; a longer run is cut into several with its key.
RUN = 4096
#: A key of more runs is hot: its windows are first counted one by one, by their whole content.
HOT = 20_000
#: Bytes of text that are hashed, or sorted, at once.
BLOCK, SORTED = 2_000_000, 1_000_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    return (x ^ (x >> np.uint64(29))) * _M2


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes (a multiple of 8) from each position that has so many."""
    n = len(data) - size + 1
    view = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    words = np.ascontiguousarray(view).view("<u8").ravel()
    out = _mix(words[:n] + _M2)
    for k in range(8, size, 8):
        out = _mix(out + words[k:k + n])
    return out ^ (out >> np.uint64(31))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def runs_of(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, first start, last start, whether the key's piece occurs again in ``data``, of each run.

    Starts are looked at some millions at a time; a run ends with its block, too.
    """
    starts = len(data) - length + 1
    whole = np.frombuffer(data, np.uint8)
    width = length - GRAM + 1
    keys, begins, ends, places, pieces = [], [], [], [], []
    for first in range(0, starts, BLOCK):
        until = min(first + BLOCK, starts)
        grams = _hashes(whole[first:until + length - 1], GRAM)
        least = _sliding(grams, width, np.minimum)
        begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        # A piece is an anchor if some string it lies in has no lesser one.
        none = np.zeros(width - 1, np.uint64)
        anchor = np.flatnonzero(_sliding(np.concatenate([none, least, none]), width, np.maximum) == grams)
        keys.append(least[begin])
        begins.append(first + begin)
        ends.append(first + np.r_[begin[1:] - 1, len(least) - 1])
        places.append(first + anchor)
        pieces.append(grams[anchor])
    if not keys:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, bool)
    # An anchor near the end of a block is one of the next block, too.
    _, once = np.unique(np.concatenate(places), return_index=True)
    found, many = np.unique(np.concatenate(pieces)[once], return_counts=True)
    key = np.concatenate(keys)
    return (key.view(np.int64), np.concatenate(begins), np.concatenate(ends),
            many[np.searchsorted(found, key)] > 1)


_OWN = "id bigint, th bigint"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(),
             "array<bigint>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)],
        names=[n for n, _ in fields])


def _runs(texts: DataFrame, length: int) -> DataFrame:
    schema = f"{_OWN}, key bigint, a bigint, b bigint, again boolean"

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for part in parts:
            for i, t, data in zip(*part.columns, strict=True):
                run = runs_of(data.as_py(), length)
                n = len(run[0])
                if n:
                    held.append((np.full(n, i.as_py()), np.full(n, t.as_py()), *run))
                    size += n
                if size > 100_000:
                    yield _batch(schema, [np.concatenate(c) for c in zip(*held, strict=True)])
                    held, size = [], 0
        if held:
            yield _batch(schema, [np.concatenate(c) for c in zip(*held, strict=True)])

    return texts.mapInArrow(scan, schema)


def _lists(runs: DataFrame) -> DataFrame:
    """A row for each document with the runs (key, a, b) that are looked at in it."""
    return runs.groupBy("id", "th").agg(F.collect_list(F.struct("key", "a", "b")).alias("runs"))


def _loaded(texts: DataFrame, runs: DataFrame) -> DataFrame:
    return texts.join(_lists(runs), ["id", "th"]).select(
        "id", "th", "data", F.col("runs.key").alias("key"), F.col("runs.a").alias("a"),
        F.col("runs.b").alias("b"))


def _windows(loaded: DataFrame, length: int) -> DataFrame:
    """Each start in the runs given, with a hash of the string that starts there."""
    schema = f"{_OWN}, key bigint, a bigint"

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                i, t, data, _, a, b = (c[k].as_py() for c in part.columns)
                whole = np.frombuffer(data, np.uint8)
                for x, y in zip(a, b, strict=True):
                    hashes = _hashes(whole[x:y + length], length // 8 * 8)
                    if length % 8:  # the bytes behind the last whole word
                        tail = _hashes(whole[x + length % 8:y + length], length // 8 * 8)
                        hashes = _mix(hashes[:y - x + 1] + tail)
                    n = y - x + 1
                    yield _batch(schema, [[i] * n, [t] * n, hashes[:n].view(np.int64).tolist(),
                                          list(range(x, y + 1))])

    return loaded.mapInArrow(scan, schema)


def _cut(keys: list, a: list, b: list, data: bytes, length: int) -> Iterator[tuple[int, int, bytes]]:
    """key, first start and bytes of the segments of one text."""
    for key, x, y in zip(keys, a, b, strict=True):
        for s in range(x, y + 1, RUN):
            yield key, s, data[s:min(s + RUN - 1, y) + length]


def _named(data: bytes) -> tuple[int, int]:
    """128 bits that stand for a segment."""
    return struct.unpack("<qq", xxhash.xxh128_digest(data))


def _segments(loaded: DataFrame, length: int) -> DataFrame:
    """key, data, n: the segments, and how often each was met; equal ones of a batch are one row."""
    schema = "key bigint, data binary, n bigint"

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], int] = {}
        size = 0

        def emit() -> pa.RecordBatch:
            return _batch(schema, [[k for k, _ in held], [d for _, d in held], list(held.values())])

        for part in parts:
            for k in range(part.num_rows):
                _, _, data, keys, a, b = (c[k].as_py() for c in part.columns)
                for key, _, segment in _cut(keys, a, b, data, length):
                    met = held.get((key, segment), 0)
                    held[key, segment] = met + 1
                    size += 0 if met else len(segment) + 300
                    if size > 16_000_000:
                        yield emit()
                        held, size = {}, 0
        yield emit()

    return loaded.mapInArrow(scan, schema)


def _places(loaded: DataFrame, length: int) -> DataFrame:
    """x, y (the name of a segment), id, th, s: where each segment begins."""
    schema = f"x bigint, y bigint, {_OWN}, s bigint"

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for k in range(part.num_rows):
                i, t, data, keys, a, b = (c[k].as_py() for c in part.columns)
                rows += [(*_named(segment), i, t, s) for _, s, segment in _cut(keys, a, b, data, length)]
                if len(rows) > 100_000:
                    yield _batch(schema, list(zip(*rows, strict=True)))
                    rows = []
            if rows:
                yield _batch(schema, list(zip(*rows, strict=True)))

    return loaded.mapInArrow(scan, schema)


def _hits(segments: DataFrame, length: int) -> DataFrame:
    """x, y, begins, ends: what repeats cover in each distinct segment that has any.

    ``segments`` has whole keys in each partition, in order. Of a key there are
    at most so many segments as it has runs, which a hot one has been cut into
    windows for; where they lie does not come here.
    """
    schema = "x bigint, y bigint, begins array<bigint>, ends array<bigint>"

    def sort(held: dict[tuple[int, bytes], int]) -> pa.RecordBatch:
        rows = []
        for ((_, data), n), hit in zip(held.items(), repeated_starts([d for _, d in held], length), strict=True):
            if n > 1:
                hit = np.arange(len(data) - length + 1)
            if not len(hit):
                continue
            cut = np.flatnonzero(np.diff(hit) > length)  # further apart than they cover
            rows.append((*_named(data), hit[np.r_[0, cut + 1]], hit[np.r_[cut, len(hit) - 1]] + length))
        return _batch(schema, list(zip(*rows, strict=True)) or [[], [], [], []])

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], int] = {}
        size, last = 0, None
        for part in parts:
            for key, data, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if key != last and size > SORTED:
                    yield sort(held)
                    held, size = {}, 0
                last = key
                met = held.get((key, data), 0)
                held[key, data] = met + n
                size += 0 if met else len(data)
        yield sort(held)

    return segments.mapInArrow(scan, schema)


def _merged(spans: DataFrame) -> DataFrame:
    """id, th, spans, rest: a document's spans joined where they touch, and what lies before each."""
    schema = f"{_OWN}, begins array<bigint>, ends array<bigint>"

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            begins, ends = [], []
            for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                a, b = np.array(a), np.array(b)
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
                begins.append(a[new].tolist())
                ends.append(b[np.r_[new[1:] - 1, len(b) - 1]].tolist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(begins, pa.list_(pa.int64())),
                 pa.array(ends, pa.list_(pa.int64()))], names=["id", "th", "begins", "ends"])

    grouped = spans.groupBy("id", "th").agg(F.collect_list(F.struct("a", "b")).alias("s"))
    return grouped.select("id", "th", F.col("s.a").alias("a"), F.col("s.b").alias("b")).mapInArrow(scan, schema)


def cut_repeats(
    docs: DataFrame, length: int = 200, keep: tuple[str, ...] = ("doc_id",), hot: int = HOT
) -> DataFrame:
    """``keep``, n_bytes, begins, ends, kept: every row with its text less what is repeated.

    A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else, in the same text or another, all as they are in the input;
    strings overlap but do not cross texts. ``begins`` and ``ends`` are the
    byte spans cut (empty: none), in order and apart; ``kept`` is the rest,
    as bytes, since a span may begin or end within a character. A null text is
    an empty one. Equal texts, in rows with the same or different or null
    doc_ids, repeat each other: they go whole if they are long enough.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    names = [f"__k{i}" for i in range(len(keep))]
    base = docs.select(
        *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("id"), data.alias("data"))
    base = base.withColumn("th", F.xxhash64("data"))
    texts = base.select("id", "th", "data")

    # Copies of a whole text: all go, and only one of them is looked at further.
    known = settle(texts.select("id", "th", F.md5("data").alias("md5"), F.octet_length("data").alias("n")))
    copied = (known.groupBy("md5").agg(F.count("*").alias("rows"), F.min("id").alias("first"))
              .where("rows > 1"))
    copies = settle(known.join(copied, "md5").select("id", "th", "n", "first"))

    # Keys that have a partner: in another text, or in the same one.
    runs = _runs(texts, length)
    keys = runs.groupBy("key").agg(
        F.min("th").alias("x"), F.max("th").alias("y"), F.max("again").alias("again"),
        F.count("*").alias("runs")).where("x <> y OR again").select("key", "runs")
    others = copies.where("id <> first").select("id", "th").distinct()
    met = settle(runs.join(keys, "key").join(others, ["id", "th"], "left_anti")
                 .select("id", "th", "key", "a", "b", (F.col("runs") > hot).alias("hot")))
    texts = texts.repartition(parts, "id", "th")
    looked_at = met.where("NOT hot").select("id", "th", "key", "a", "b")
    if met.where("hot").limit(1).count():
        # Windows that are one of a kind go; copies of the others are one row for each task.
        windows = settle(_windows(_loaded(texts, met.where("hot")), length))
        again = windows.groupBy("key").count().where("count > 1").select("key")
        looked_at = looked_at.union(
            windows.join(again, "key").select("id", "th", "key", "a", F.col("a").alias("b")))
    loaded = _loaded(texts, looked_at)
    dealt = _segments(loaded, length).repartition(parts, "key").sortWithinPartitions("key")
    # A segment that very many texts share is a skewed key of this join, which Spark splits.
    placed = _places(loaded, length).join(_hits(dealt, length), ["x", "y"]).select(
        "id", "th", "s", F.explode(F.arrays_zip("begins", "ends")).alias("span"))
    spans = placed.select("id", "th", (F.col("s") + F.col("span.begins")).alias("a"),
                          (F.col("s") + F.col("span.ends")).alias("b")).union(
        copies.where(F.col("n") >= length).select(
            "id", "th", F.lit(0).cast("bigint"), F.col("n").cast("bigint")))
    merged = settle(_merged(spans))
    none = F.array().cast("array<bigint>")
    found = base.join(merged, ["id", "th"], "left").select(
        *(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)),
        F.octet_length("data").cast("bigint").alias("n_bytes"),
        F.coalesce("begins", none).alias("begins"), F.coalesce("ends", none).alias("ends"), "data")
    # The stretches between the spans.
    since = F.concat(F.array(F.lit(0).cast("bigint")), F.col("ends"))
    until = F.concat(F.col("begins"), F.array("n_bytes"))
    rest = F.aggregate(
        F.arrays_zip(since.alias("x"), until.alias("y")), F.lit(b""),
        lambda kept, s: F.concat(kept, F.substring("data", (s["x"] + 1).cast("int"), (s["y"] - s["x"]).cast("int"))))
    return found.select(*keep, "n_bytes", "begins", "ends",
                        F.when(F.size("begins") == 0, F.col("data")).otherwise(rest).alias("kept"))


def removed_bytes():
    """Column: bytes cut, of the spans that ``cut_repeats`` gives."""
    return F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"),
                       lambda x, y: x + y)
