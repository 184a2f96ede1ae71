"""SimHash fingerprints, exact links between near ones, and the groups they make.

Fingerprints are compared in tiles. A tile holds fingerprints of one population
count, and tile pairs whose counts differ beyond the radius are skipped; within
a tile pair the same is done by the population counts of the four quarters.
What is left is compared by numpy exclusive-or and bit count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.components import components
from daybook.llm.shipping import ship
from daybook.session import settle

SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text whose words are hashed at once.
SLICE = 300_000
#: Fingerprints of a tile, and comparisons held at once.
TILE, BLOCK = 65_536, 2_000_000


def fingerprint(text: str, shingle: int = 3) -> int:
    """Of a text's words: bit i is set if it is in over half the shingles' hashes.

    The words of some hundred thousand bytes are held at a time.
    """
    counts, n = np.zeros(64, np.int64), 0
    words: list[bytes] = []
    for piece in _slices(text.encode().translate(LOWER)):
        words += piece.split()
        if len(words) >= shingle:
            n += len(words) - shingle + 1
            counts += _counted(words, shingle)
            words = words[len(words) - shingle + 1:]
    if not n and words:
        n = 1
        counts += _counted(words, len(words))
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def _slices(data: bytes) -> Iterator[bytes]:
    """Slices that end at white space."""
    at = 0
    while at < len(data):
        space = SPACE.search(data, at + SLICE)
        end = space.start() if space else len(data)
        yield data[at:end]
        at = end


def _counted(words: list[bytes], shingle: int) -> np.ndarray:
    """How many of the shingles' hashes have each bit."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words])[:len(words) - shingle + 1]
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED)
                       for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist(), strict=True)], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, fp (the 64 bits as a signed long), a row for each of ``docs``; a null text is empty."""
    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = np.array([fingerprint(t.as_py() or "", shingle) for t in part.columns[-1]], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(values.view(np.int64))], names=[*keep, "fp"])

    ship(docs.sparkSession)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(hashed, f"{kinds}, fp bigint")


def _cells(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values ordered by the population counts of their quarters; the counts, and where each begins."""
    quarters = np.bitwise_count(values.view(np.uint16).reshape(-1, 4)).astype(np.int64)
    code = quarters @ np.array([17**3, 17**2, 17, 1])
    order = np.argsort(code, kind="stable")
    code = code[order]
    begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return values[order], quarters[order][begin], np.r_[begin, len(values)]


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked entries the least label of their group."""
    while True:
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        apart = low < high
        if not apart.any():
            return
        np.minimum.at(label, high[apart], low[apart])
        while (shorter := label[label]).tobytes() != label.tobytes():
            label[:] = shorter


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links within a tile, or between two tiles, connect.

    Fewer than fingerprints, however many of them are near each other.
    """
    same = b is None
    va, qa, ba = _cells(a)
    vb, qb, bb = (va, qa, ba) if same else _cells(b)
    values = va if same else np.concatenate([va, vb])
    shift = 0 if same else len(va)
    label = np.arange(len(values))
    sizes = np.diff(bb)
    for k in range(len(qa)):
        near = np.abs(qb - qa[k]).sum(axis=1) <= radius
        if same:
            near[:k] = False
        columns = np.flatnonzero(np.repeat(near, sizes))
        if not len(columns):
            continue
        other = vb[columns]
        step = max(1, BLOCK // len(columns))
        for at in range(ba[k], ba[k + 1], step):
            rows = va[at:min(at + step, ba[k + 1])]
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ other[None, :]) <= radius)
            if len(i):
                _unite(label, i + at, columns[j] + shift)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return values[moved], values[label[moved]]


def near_links(fps: DataFrame, radius: int) -> DataFrame:
    """u, v: edges between distinct fingerprints (column fp) that connect all within ``radius`` bits."""
    counted = fps.withColumn("pc", F.bit_count("fp").cast("int"))
    # At most 65 rows.
    parts = {r["pc"]: -(-r["count"] // TILE) for r in counted.groupBy("pc").count().collect()}
    many = F.lit(1)
    for pc, n in parts.items():
        many = F.when(F.col("pc") == pc, n).otherwise(many) if n > 1 else many
    tiles = settle(counted.withColumn("part", F.pmod(F.xxhash64("fp"), many).cast("int"))
                   .groupBy("pc", "part").agg(F.collect_list("fp").alias("fps")))
    names = tiles.select("pc", "part")
    pairs = (names.withColumn("pc_b", F.explode(F.sequence("pc", F.col("pc") + radius)))
             .join(names.select(F.col("pc").alias("pc_b"), F.col("part").alias("part_b")), "pc_b")
             .where("pc_b > pc OR part_b >= part"))
    loaded = (pairs.join(tiles, ["pc", "part"])
              .join(tiles.select(F.col("pc").alias("pc_b"), F.col("part").alias("part_b"),
                                 F.col("fps").alias("fps_b")), ["pc_b", "part_b"])
              .select("fps", F.when((F.col("pc") < F.col("pc_b")) | (F.col("part") < F.col("part_b")),
                                    F.col("fps_b")).alias("fps_b")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (None if c[k].as_py() is None else c[k].values.to_numpy().view(np.uint64)
                        for c in batch.columns)
                u, v = tile_forest(a, b, radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)) for x in (u, v)], names=["u", "v"])

    return loaded.mapInArrow(compare, "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, radius: int = 3, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep``, fp, group, component_id: the least doc_id reachable over links of at most ``radius`` bits.

    Equal fingerprints are linked, and so are the zero fingerprints of empty and
    null texts. ``group`` is a fingerprint of the component and tells components
    apart also where rows share a doc_id. Every row gives a row; one whose doc_id
    is null lends its fingerprint to no link and is in no component (null),
    unless documents of the same fingerprint have one. ``keep`` has doc_id.
    """
    prints = settle(fingerprints(docs, shingle, keep))
    nodes = settle(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(near_links(nodes.select("fp"), radius))
    rooted = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("group"))
    least = rooted.groupBy("group").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(least, "group").select("fp", "group", "component_id"), "fp", "left").select(
        *keep, "fp", "group", "component_id")
