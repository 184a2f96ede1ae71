"""K-d tree sharding: split at distributed weighted medians until leaves reach the target bytes.

Only DataFrame functions run on the rows. The driver holds the tree, which has
fewer nodes than there are shards, and per pass one row for each open node.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.session import settle

#: Order keys: the coordinate's place between its bounds, then a hash that orders equal coordinates.
#: It is that of the text, and behind it, for copies that may be parted, one of the doc_id.
COORDINATE_BITS, TIE_BITS, COPY_BITS = 22, 40, 14
#: Copies of a text stay together if they are no larger than this share of a shard.
TOGETHER = 1 / 100
#: Parts of a span whose weights a pass of the median search adds up.
SPANS = 4096
#: A cut may miss its weight by this share of a shard.
TOLERANCE = 1 / 2000
#: Rows numbered by one task.
NUMBERED = 200_000


@dataclass
class Node:
    """A leaf of ``shards`` shards, or a cut: rows whose key is below ``at`` go left."""

    first: int
    shards: int
    key: str = ""
    at: int = 0
    sides: list[Node] = field(default_factory=list)


def _number(column: Column, kind: str) -> Column:
    """An order-preserving number; of strings the first six bytes. Null comes first."""
    if kind == "string":
        six = F.rpad(F.hex(F.substring(column.cast("binary"), F.lit(1), F.lit(6))), 12, "0")
        column = F.conv(six, 16, 10)
    column = column.cast("double")
    return F.when(column.isNull() | F.isnan(column), None).otherwise(column)


def _route(node: Node, leaf) -> Column:
    if not node.sides:
        return leaf(node)
    left, right = (_route(side, leaf) for side in node.sides)
    return F.when(F.col(node.key) < node.at, left).otherwise(right)


def _leaves(node: Node) -> list[Node]:
    return [x for side in node.sides for x in _leaves(side)] if node.sides else [node]


@dataclass
class Search:
    """For a cut: the order key, the weight wanted on the left, and the span of keys it lies in."""

    key: int
    wanted: float
    tolerance: float
    low: int
    high: int
    below: int = 0  # weight before the span


def _cuts(rows: DataFrame, keys: list[str], node: Column, open_: dict[int, Search]) -> dict[int, int]:
    """For each open node the key to cut at.

    Each pass adds up the weights of ``SPANS`` equal parts of the span that is
    left and goes on with the part that the wanted weight falls into, trimmed to
    the keys that occur in it.
    """
    done: dict[int, int] = {}
    noded = rows.select("size", *keys, node.alias("__node"))
    one = rows.sparkSession.range(1)
    while open_:
        # One row for each open node, fewer than there are shards.
        state = one.select(F.inline(F.array(*[F.struct(
            F.lit(n).alias("__node"), F.lit(x.key + 1).alias("__which"),
            F.lit(x.low).cast("bigint").alias("__low"), F.lit(x.high).cast("bigint").alias("__high"),
            F.lit((x.high - x.low) // SPANS + 1).cast("bigint").alias("__step"),
            F.lit(round(x.wanted) - x.below).cast("bigint").alias("__wanted"))
            for n, x in open_.items()])))
        key = F.element_at(F.array(*keys), F.col("__which"))
        sums = (noded.join(F.broadcast(state), "__node")
                .where((key >= F.col("__low")) & (key <= F.col("__high")))
                .groupBy("__node", "__wanted", "__low",
                         F.floor((key - F.col("__low")) / F.col("__step")).alias("__span"))
                .agg(F.sum("size").alias("w"), F.min(key).alias("low"), F.max(key).alias("high")))
        order = Window.partitionBy("__node").orderBy("__span")
        first = (sums.withColumn("upto", F.sum("w").over(order)).where("upto >= __wanted").groupBy("__node")
                 .agg(F.min_by(F.struct("low", "high", "w", "upto"), "__span").alias("s")))
        for row in first.collect():
            n, s = row["__node"], row["s"]
            x = open_[n]
            below = x.below + s["upto"] - s["w"]
            if s["w"] <= x.tolerance or s["low"] == s["high"]:
                closer = below + s["w"] - x.wanted <= x.wanted - below
                done[n] = s["high"] + 1 if closer else s["low"]
                del open_[n]
            else:
                x.low, x.high, x.below = s["low"], s["high"], below
    return done


def grow(rows: DataFrame, keys: list[str], shards: int) -> Node:
    """The tree over rows with ``size`` and order keys: cut along the widest key, level by level."""
    root = Node(0, shards)
    while True:
        open_ = [x for x in _leaves(root) if x.shards > 1]
        if not open_:
            return root
        node = _route(root, lambda x: F.lit(x.first))
        ends = [f(k).alias(f"{f.__name__}{i}") for i, k in enumerate(keys) for f in (F.min, F.max)]
        found = {r["__node"]: r for r in rows.groupBy(node.alias("__node")).agg(
            F.sum("size").alias("__size"), *ends).collect()}
        searches = {}
        for x in open_:
            if row := found.get(x.first):
                share = row["__size"] / x.shards
                spread = [(row[f"max{i}"] >> TIE_BITS) - (row[f"min{i}"] >> TIE_BITS) for i in range(len(keys))]
                i = spread.index(max(spread))
                searches[x.first] = Search(i, share * (x.shards // 2), share * TOLERANCE,
                                           row[f"min{i}"], row[f"max{i}"])
        which = {n: keys[x.key] for n, x in searches.items()}
        at = _cuts(rows, keys, node, searches)
        cut = {x.first: (which.get(x.first, keys[0]), at.get(x.first, 0)) for x in open_}
        for x in open_:
            half = x.shards // 2
            x.key, x.at = cut[x.first]
            x.sides = [Node(x.first, half), Node(x.first + half, x.shards - half)]


def shard_by_tree(
    docs: DataFrame, shards: int = 40, dimensions: tuple[str, ...] = ("size", "source", "lang")
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row in one of ``shards`` shards of near equal bytes.

    ``size`` is the text's UTF-8 bytes plus 16, and a null text has no bytes (its
    checksum is 0). A node is cut along the metadata dimension whose values
    spread widest in it, measured against the spread of the whole table, at its
    weighted median (for an odd number of shards at the like quantile), down to
    one shard of the target size, total bytes over ``shards``. Equal texts are a
    group: they have the least values that any of them has, and stay in one
    shard. Groups larger than ``TOGETHER`` of a shard, which would keep shards
    from being equal, may be cut, but are not scattered: their rows are
    neighbours, ordered by a hash of doc_id. Rows with equal values are ordered
    by a hash of the text. Null values order first. ``slot`` numbers a shard's
    rows from 0 without gaps. With fewer groups than shards some shards stay
    empty; no rows give no rows.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 16
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [d for d in dimensions if d == "size" or d in docs.columns]
    plain = docs.select(
        "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__th"),
        *(_number(size if d == "size" else F.col(d), "bigint" if d == "size" else docs.schema[d].dataType.simpleString())
          .alias(f"__x{i}") for i, d in enumerate(names)))
    rows = settle(plain)
    bounds = rows.agg(F.sum("size").alias("bytes"), *(f(f"__x{i}").alias(f"{f.__name__}{i}")
                                                      for i in range(len(names)) for f in (F.min, F.max))).first()
    groups = settle(rows.groupBy("__th").agg(
        F.count("*").alias("__rows"), F.sum("size").alias("__bytes"),
        *(F.min(f"__x{i}").alias(f"__g{i}") for i in range(len(names)))).where("__rows > 1"))
    rows = rows.join(groups, "__th", "left")
    parted = F.coalesce(F.col("__bytes") > (bounds["bytes"] or 0) / shards * TOGETHER, F.lit(False))
    copy = F.when(parted, F.xxhash64("doc_id").bitwiseAND(F.lit(2**COPY_BITS - 1))).otherwise(0)
    scaled = []
    for i in range(len(names)):
        low, high = bounds[f"min{i}"], bounds[f"max{i}"]
        spread = (high - low) if low is not None and high > low else 1.0
        place = F.coalesce(
            F.floor((F.coalesce(f"__g{i}", f"__x{i}") - (low or 0.0)) / spread * (2**COORDINATE_BITS - 2)) + 1,
            F.lit(0)).cast("bigint")
        of_text = F.xxhash64(F.lit(i), "__th").bitwiseAND(F.lit(2**(TIE_BITS - COPY_BITS) - 1))
        tie = F.shiftleft(of_text, COPY_BITS).bitwiseOR(copy.cast("bigint"))
        scaled.append((F.shiftleft(place, TIE_BITS).bitwiseOR(tie)).alias(f"__k{i}"))
    keyed = settle(rows.select("doc_id", "size", "text_crc32", *scaled))
    tree = grow(keyed, [f"__k{i}" for i in range(len(names))], shards)
    placed = keyed.select("doc_id", "size", "text_crc32",
                          _route(tree, lambda x: F.lit(x.first)).cast("int").alias("shard"))
    return _numbered(placed, max(1, -(-keyed.count() // (shards * NUMBERED))))


def _numbered(placed: DataFrame, parts: int) -> DataFrame:
    """Slots without gaps: each shard is numbered in parts, after the rows of the parts before."""
    own = placed.withColumn("__part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    upto = Window.partitionBy("shard").orderBy("__part")
    start = own.groupBy("shard", "__part").agg(F.count("*").alias("__n")).select(
        "shard", "__part", (F.sum("__n").over(upto) - F.col("__n")).alias("__start"))
    inner = Window.partitionBy("shard", "__part").orderBy("doc_id", "text_crc32", "size")
    return own.withColumn("__i", F.row_number().over(inner)).join(start, ["shard", "__part"]).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("__start") + F.col("__i") - 1).cast("bigint").alias("slot"))
