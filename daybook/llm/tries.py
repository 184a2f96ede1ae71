"""Prefix trie of conversations by van Emde Boas recursion.

Sequences are cut at half their depth and the prefixes up to the cut are named,
equal ones alike. What lies before the cut belongs to the upper trie, what lies
behind it to a forest below the named prefix; all of these are cut in half
again, at once, until each piece is one turn. So the number of rounds is the
logarithm of the longest sequence. Totals then go back the same way: from each
forest the totals are grafted onto all that lie above it in the piece before,
single turns first, halves last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.shipping import ship
from daybook.session import settle

#: Conversations that end at a node are joined into texts by 2^9 neighbouring ids.
TOGETHER = 9


def _hashes(*columns: Column) -> list[Column]:
    """128 bits that stand for the columns."""
    return [F.xxhash64(F.lit(seed), *columns).alias(name) for seed, name in ((11, "a"), (13, "b"))]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos, a, b, bytes: each conversation's turns numbered from 0, a and b being role and text.

    Turns are ordered by ``turn`` (null first) and within one turn by a hash of
    role and text. Rows are counted where they are sorted, and a conversation
    that lies in several partitions goes on from the counts of those before, so
    none has to fit in a task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    sorted_ = settle(
        conversations.where("conv_id IS NOT NULL")
        .select(F.col("conv_id").cast("bigint").alias("conv"), "turn", *_hashes(role, text),
                F.octet_length(text).cast("bigint").alias("bytes"))
        .groupBy("conv", "turn", "a", "b").agg(F.max("bytes").alias("bytes"), F.count("*").alias("times"))
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("row", F.monotonically_increasing_id()).withColumn("place", F.shiftright("row", 33)))
    before = Window.partitionBy("conv").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # A partition holds at most one conversation that began before it.
    carried = (sorted_.groupBy("conv", "place").agg(F.sum("times").alias("times"))
               .select("conv", "place", F.sum("times").over(before).alias("carried")).where("carried IS NOT NULL"))
    so_far = Window.partitionBy("conv", "place").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    ends = (F.sum("times").over(so_far) - 1).alias("last")
    first = F.coalesce("carried", F.lit(0))
    numbered = sorted_.select("conv", "place", "a", "b", "bytes", "times", ends).join(
        F.broadcast(carried), ["conv", "place"], "left")
    return numbered.select(
        "conv", F.explode(F.sequence(first + F.col("last") - F.col("times") + 1, first + F.col("last"))).alias("pos"),
        "a", "b", "bytes")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, a, b, bytes) and (conv, size) of conversations that begin as another one does.

    Conversation c takes the first h turns of conversation c - c % 5 for its own
    first h, with h the unsigned crc32 of c in decimals, modulo 9.
    """
    sizes = settle(turns.groupBy("conv").agg((F.max("pos") + 1).alias("size")))
    other = F.col("conv") % 5 != 0
    heads = sizes.select(
        "conv", "size", (F.col("conv") - F.col("conv") % 5).alias("base"),
        F.when(other, F.crc32(F.col("conv").cast("string").cast("binary")) % 9).otherwise(0).alias("skip"))
    heads = settle(heads.join(sizes.select(F.col("conv").alias("base"), F.col("size").alias("there")), "base", "left")
                   .withColumn("take", F.least("skip", F.coalesce("there", F.lit(0)))))
    own = turns.join(heads, "conv").where("pos >= skip").select(
        "conv", (F.col("pos") - F.col("skip") + F.col("take")).alias("pos"), "a", "b", "bytes")
    taken = (turns.where("pos < 8").withColumnRenamed("conv", "base")
             .join(heads.where("take > 0").select("base", "conv", "take"), "base")
             .where("pos < take").select("conv", "pos", "a", "b", "bytes"))
    size = F.col("take") + F.greatest(F.col("size") - F.col("skip"), F.lit(0))
    return settle(own.union(taken)), heads.select("conv", size.alias("size"))


def _name_prefixes(turns: DataFrame, sizes: DataFrame, rounds: int) -> DataFrame:
    """conv, depth, a, b: a name for each prefix, equal for equal prefixes."""
    mixed = turns.select("conv", "pos", *_hashes(F.col("pos"), F.col("a"), F.col("b")))
    named = sizes.select("conv", F.lit(0).cast("bigint").alias("depth"),
                         *(F.lit(0).cast("bigint").alias(c) for c in "ab"))
    for k in reversed(range(rounds)):
        half = 1 << k
        upper = (mixed.where(F.col("pos").bitwiseAND(half) == 0)
                 .groupBy("conv", (F.shiftright("pos", k + 1) * (2 * half)).alias("depth"))
                 .agg(F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"), F.count("*").alias("n"))
                 .where(F.col("n") == half))
        cut = named.join(upper, ["conv", "depth"]).select(
            "conv", (F.col("depth") + half).alias("depth"),
            *(F.xxhash64(c, z, F.lit(k)).alias(c) for c, z in zip("ab", "xy", strict=True)))
        named = named.union(settle(cut))
    return named


def _graft(weights: DataFrame, paths: DataFrame, rounds: int) -> DataFrame:
    """Node (top, depth) with its columns ``leaves`` and ``saved`` summed over its subtree."""
    totals = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    now = weights
    for k in range(rounds):
        half = 1 << k
        cut = now.where(F.col("depth").bitwiseAND(2 * half - 1) == half).select(
            F.col("top").alias("conv"), (F.shiftright("depth", k) - 1).alias("piece"), "leaves", "saved")
        above = paths.select("conv", F.shiftright("depth", k).alias("piece"), "top", "depth")
        moved = cut.join(above, ["conv", "piece"]).select("top", "depth", "leaves", "saved")
        now = settle(now.union(moved).groupBy("top", "depth").agg(*totals))
    return now


def _digests(ends: DataFrame) -> DataFrame:
    """top, depth, digest: SHA-256 of the ids (column conv) that end at each node.

    A digest is made in order and so in one place; ids go there as joined texts,
    and a node with many of them is read in sorted batches.
    """
    ship(ends.sparkSession)
    joined = settle(
        ends.groupBy("top", "depth", F.shiftright("conv", TOGETHER).alias("chunk"))
        .agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")))
    chunks = joined.groupBy("top", "depth").agg(F.count("*").alias("chunks"))
    several = chunks.where("chunks > 1").select("top", "depth")
    whole = joined.join(several, ["top", "depth"], "left_anti").select(
        "top", "depth", F.sha2("ids", 256).alias("digest"))
    parts = joined.join(several, ["top", "depth"], "left_semi").repartition("top", "depth").sortWithinPartitions(
        "top", "depth", "chunk")
    return whole.union(parts.select("top", "depth", "ids").mapInArrow(
        _digest_in_order, "top bigint, depth bigint, digest string"))


def _digest_in_order(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["top", "depth", "digest"]
    at, digest = None, hashlib.sha256()
    for part in parts:
        done = []
        for top, depth, ids in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if at != (top, depth):
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = (top, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield _rows(done, names)
    yield _rows([] if at is None else [(*at, digest.hexdigest())], names)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def build_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences: see ``conversation_trie``.

    ``turns`` (conv, pos, a, b, bytes) has position 0 and up of each sequence
    once, ``sizes`` (conv, size) every sequence, those without turns included.
    """
    turns, sizes = settle(turns), settle(sizes)
    rounds = int(sizes.agg(F.max("size")).first()[0] or 0).bit_length()
    names = _name_prefixes(turns, sizes, rounds)
    nodes = settle(names.groupBy("depth", "a", "b").agg(F.min("conv").alias("top"), F.count("*").alias("n_convs")))
    paths = settle(names.join(nodes, ["depth", "a", "b"]).select("conv", "depth", "top"))
    # The smallest member and the depth identify a node.
    last = turns.select(F.col("conv").alias("top"), (F.col("pos") + 1).alias("depth"), "bytes")
    above = paths.select(F.col("conv").alias("top"), (F.col("depth") + 1).alias("depth"), F.col("top").alias("parent"))
    nodes = settle(nodes.join(last, ["top", "depth"], "left").join(above, ["top", "depth"], "left").select(
        "top", "depth", "parent", "n_convs", F.coalesce("bytes", F.lit(0)).alias("bytes")))
    children = nodes.where("parent IS NOT NULL").groupBy(
        F.col("parent").alias("top"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = settle(nodes.join(children, ["top", "depth"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))))
    weights = nodes.select("top", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias(
        "leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    totals = _graft(weights, paths, rounds)
    ends = paths.join(sizes.select("conv", F.col("size").alias("depth")), ["conv", "depth"]).select(
        "top", "depth", "conv")
    return (nodes.join(totals, ["top", "depth"]).join(_digests(ends), ["top", "depth"], "left").select(
        F.col("top").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    One row per node of the trie of ``conversations`` (conv_id, turn, role, text)
    as ``rebuilt_turns`` makes them. A node is a distinct sequence of turns (role
    and text; null is empty), from the root without turns; ``conv_id`` is its
    smallest member. Rows without conv_id belong to no conversation. Rows that
    are repeated are turns of their own, ordered as ``ordered_turns`` says. No
    conversations give no rows. Other columns are not looked at.
    """
    return build_trie(*rebuilt_turns(settle(ordered_turns(conversations))))
