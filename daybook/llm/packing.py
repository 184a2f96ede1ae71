"""Packing of tokenised documents into sequences by vector best fit.

Every open sequence has residual capacities for tokens, documents and attention
cost (the sum of squared piece lengths). A piece goes to the open sequence that
can take it under every constraint and scores best: the largest weighted
dot-product of piece and residuals, or the smallest weighted norm of what would
be left. Pieces come longest first; one that fits nowhere opens a sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.bpe import TOGETHER, batches, byte_codec
from daybook.llm.shipping import ship
from daybook.llm.workers import give_back
from daybook.session import settle


@dataclass(frozen=True)
class Capacity:
    """Of one sequence. By default documents and cost never bind before the tokens do, but weigh in the score."""

    tokens: int = 4096
    documents: int = 4096
    cost: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    score: str = "norm"  # or "dot"


#: Pieces packed together; the work of a group grows with the square, its memory with the number.
GROUP = 20_000


def fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; lengths in descending order."""
    limit = np.array([capacity.tokens, capacity.documents, capacity.cost], np.float64)
    weight = np.array(capacity.weights) / limit
    n = len(lengths)
    number, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    left = np.empty((3, 1024))  # residuals of the open sequences
    name = np.empty(1024, np.int64)
    open_, made = 0, 0
    least = int(lengths[-1]) if n else 0
    for i, length in enumerate(lengths.tolist()):
        size = np.array([length, 1, length * length], np.float64)
        if (size > limit).any():
            raise ValueError(f"a piece of {length} tokens is beyond the capacity of a sequence")
        rest = left[:, :open_] - size[:, None]
        can = np.flatnonzero((rest >= 0).all(axis=0))
        if len(can):
            if capacity.score == "dot":
                score = -(weight * weight * size) @ left[:, can]
            else:
                score = ((weight[:, None] * rest[:, can]) ** 2).sum(axis=0)
            j = can[np.argmin(score)]
        else:
            if open_ == left.shape[1]:
                left = np.concatenate([left, np.empty_like(left)], axis=1)
                name = np.concatenate([name, np.empty_like(name)])
            j = open_
            left[:, j], name[j] = limit, made
            open_, made = open_ + 1, made + 1
        number[i], offset[i] = name[j], capacity.tokens - left[0, j]
        left[:, j] -= size
        if left[0, j] < least or left[1, j] < 1:  # nothing to come fits
            open_ -= 1
            left[:, j], name[j] = left[:, open_], name[open_]
    return number, offset


def pieces_of(docs: DataFrame, path: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and ``end_id``, cut at ``limit``."""
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = byte_codec(path), np.array([end_id], "<u4").tobytes()
        kind = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
        for part in parts:
            ids = part.column(0).to_pylist()
            at = 0
            for texts in batches(part.column(1), 2 * TOGETHER):
                rows = []
                for doc, joined in zip(ids[at:at + len(texts)], own.joined(texts), strict=True):
                    data = joined + last
                    for k, start in enumerate(range(0, len(data) // 4, limit)):
                        piece = data[4 * start:4 * (start + limit)]
                        rows.append((doc, k, start, len(piece) // 4, zlib.crc32(piece)))
                at += len(texts)
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], part.schema.field(0).type),
                     *(pa.array(c, t) for c, t in zip(columns[1:], kind.values(), strict=True))],
                    names=["doc_id", *kind])
            give_back()

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, path: str, capacity: Capacity = Capacity(), end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A null text is an empty one, whose piece is ``end_id`` alone; null or
    repeated doc_ids are packed like any others. A full piece is a sequence of
    its own. The others are dealt at random, by their content, to groups of some
    20,000, and each group is packed on its own: at most a sequence or so per
    group stays short, and no group depends on another. Equal pieces are
    interchangeable, so a repeated task may at most swap rows that are equal.
    No documents give no rows.
    """
    pieces = settle(pieces_of(docs, path, capacity.tokens, end_id))
    groups = max(1, round(pieces.count() / GROUP))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"],
                                ascending=[False, True, True, True], kind="stable")
        number, offset = fit(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="__group").assign(
            sequence_id=number * groups + int(key[0]), offset=offset)

    # The salt spreads copies of a document; rows equal in all of these are few.
    dealt = pieces.withColumn(
        "__group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("__group").applyInPandas(
        place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
               "sequence_id bigint, offset bigint")
