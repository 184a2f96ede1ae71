"""Approximate nearest neighbours by NN-descent and greedy search of the graph it builds.

The graph holds for every distinct vector its nearest others found so far. A
round joins each vector's neighbours, and those it is a neighbour of, with each
other: neighbours of neighbours are likely neighbours. The first graph comes
from vectors that lie on the same side of random planes. A search starts at the
query's place in the graph and goes on from the best vectors that it has not
gone on from, until there is none among the best.

Copies of a vector are one point of the graph, so that a vector that a third of
all rows share is not everybody's neighbour many times over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.shipping import ship
from daybook.session import broadcast_if_small, settle, tidy_shuffles

#: Neighbours kept of a vector, and of those it is a neighbour of (a bounded choice by hash).
DEGREE = 24
#: Sets of random planes, vectors of a block that are compared at the start, and neighbours taken from it.
TABLES, BLOCK, FIRST = 12, 1024, 12
#: Tables of half the planes, and of none: there a block holds any vectors.
COARSE, ONE_CELL = 2, 2
#: Rounds of NN-descent at most; they end when the graph hardly improves.
ROUNDS, SETTLED = 6, 0.002
#: Vectors a search keeps, how many it goes on from at once, and rounds at most.
KEPT, BEAM, STEPS = 160, 40, 12
SEED = 17


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, e (array<double>): without vectors null, zero or holding null or non-finite components."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where("vec_id IS NOT NULL").select("vec_id", e.alias("e")).where(
        F.col("e").isNotNull() & ~bad & F.exists("e", lambda x: x != 0))


def _points(rows: DataFrame, copies: int) -> DataFrame:
    """vec_id, e, h1, h2, node: the ``copies`` least ids of each distinct vector; node is the least."""
    keyed = rows.select("vec_id", "e", F.xxhash64("e").alias("h1"), F.xxhash64(F.lit(7), "e").alias("h2"))
    # The filter on the rank is applied before the rows are dealt, so many copies stay few rows.
    by = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = settle(keyed.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= copies))
    nodes = few.where("rank = 1").select("h1", "h2", F.col("vec_id").alias("node"))
    return few.join(nodes, ["h1", "h2"]).select("vec_id", "e", "h1", "h2", "node").dropDuplicates(["vec_id", "node"])


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # keeps squares finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _codes(vectors: np.ndarray, bits: int) -> np.ndarray:
    """For each vector and table the sides of ``bits`` planes it is on, as a number.

    The tables behind the first ``TABLES`` are coarser, and the last ones have
    all vectors in one cell, so that nobody is alone in all of them.
    """
    rng = np.random.default_rng(SEED)
    planes = rng.standard_normal((TABLES, max(bits, 1), vectors.shape[1]))
    sides = np.einsum("nd,tbd->ntb", vectors, planes) > 0
    if not bits:
        return np.zeros((len(vectors), TABLES), np.int64)
    fine = (sides[:, :, :bits] @ (1 << np.arange(bits))).astype(np.int64)
    return np.concatenate([fine, fine[:, :COARSE] >> (bits - bits // 2), np.zeros((len(vectors), ONE_CELL), np.int64)],
                          axis=1)


def _sketched(nodes: DataFrame, bits: int, kind: str) -> DataFrame:
    """node, dim, vec (the components as given, of numpy type ``kind``), codes of each point (node, e)."""
    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            dims = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                own = part.filter(pa.array(dims == dim))
                v = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array(np.full(len(v), dim, np.int32)),
                     pa.array([x.tobytes() for x in v.astype(kind)], pa.binary()),
                     pa.array(_codes(_unit(v), bits).tolist(), pa.list_(pa.int64()))],
                    names=["node", "dim", "vec", "codes"])

    return nodes.select("node", "e").mapInArrow(scan, "node bigint, dim int, vec binary, codes array<bigint>")


_NEAR = "u bigint, near array<struct<s:double,v:bigint>>"


def _matrix(data: list[bytes], kind: str) -> np.ndarray:
    """Vectors of length 1, one for each of ``data``, in double precision."""
    return _unit(np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64))


def _best_of(u: np.ndarray, v: np.ndarray, s: np.ndarray, keep: int) -> pa.RecordBatch:
    """A row for each u with its ``keep`` best pairs, each pair once, though its sums may differ in the last bits."""
    order = np.lexsort((-s, v, u))
    u, v, s = u[order], v[order], s[order]
    once = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])][:len(u)]
    u, v, s = u[once], v[once], s[once]
    order = np.lexsort((v, -s, u))
    u, v, s = u[order], v[order], s[order]
    begin = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])[:len(u)]
    rank = np.arange(len(u)) - np.repeat(begin, np.diff(np.r_[begin, len(u)]))
    first = rank < keep
    u, v, s = u[first], v[first], s[first]
    begin = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])[:len(u)]
    lists = pa.ListArray.from_arrays(
        pa.array(np.r_[begin, len(u)].astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(s), pa.array(v)], names=["s", "v"]))
    return pa.RecordBatch.from_arrays([pa.array(u[begin]), lists], names=["u", "near"])


def _merge(lists: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` best of the lists of each u."""
    def best(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = part.column(1).value_lengths().to_numpy()
            s, v = (c.to_numpy() for c in part.column(1).flatten().flatten())
            yield _best_of(np.repeat(part.column(0).to_numpy(), sizes), v, s, degree)

    return lists.groupBy("u").agg(F.flatten(F.collect_list("near")).alias("near")).mapInArrow(best, _NEAR)


def _blocks(points: DataFrame) -> DataFrame:
    """node, vec, dim, t, code, part: each point once in every table, in blocks of up to some ``2 * BLOCK``.

    Blocks are numbered before any vector moves, and dealt by their number too:
    a cell with many vectors, and that with all of them, is many tasks.
    """
    cells = points.select("node", "dim", F.posexplode("codes").alias("t", "code"))
    one_cell = F.col("t") >= TABLES + COARSE
    part = F.pmod(F.xxhash64("node", "t"), F.ceil(F.col("n") / (2 * BLOCK))).alias("part")
    lengths = broadcast_if_small(points.groupBy("dim").agg(F.count("*").alias("n")))
    sizes = settle(cells.where(~one_cell).groupBy("dim", "t", "code").agg(F.count("*").alias("n")))
    numbered = (cells.where(~one_cell).join(sizes, ["dim", "t", "code"]).select("node", "t", "code", part)
                .union(cells.where(one_cell).join(lengths, "dim").select("node", "t", "code", part)))
    placed = numbered.join(points.select("node", "dim", "vec"), "node")
    return placed.repartition("dim", "t", "code", "part")


def _first_graph(points: DataFrame, degree: int, kind: str) -> DataFrame:
    """Neighbours within blocks of vectors that share a code."""
    rows = _blocks(points).groupBy("dim", "t", "code", "part").agg(
        F.collect_list("node").alias("nodes"), F.collect_list("vec").alias("vecs")).select("nodes", "vecs")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                ids = part.column(0)[k].values.to_numpy()
                vectors = _matrix(part.column(1)[k].as_py(), kind)
                s = vectors @ vectors.T
                np.fill_diagonal(s, -3)
                few = min(FIRST, len(ids) - 1)
                if few > 0:
                    top = np.argpartition(-s, few - 1, axis=1)[:, :few]
                    yield _best_of(np.repeat(ids, top.shape[1]), ids[top].ravel(),
                                   np.take_along_axis(s, top, axis=1).ravel(), degree)

    return _merge(rows.mapInArrow(compare, _NEAR), degree)


def _both_ways(graph: DataFrame, degree: int) -> DataFrame:
    """c, m: each vector with its neighbours, and with up to ``degree`` of those it is a neighbour of."""
    out = graph.select(F.col("u").alias("c"), F.explode("near.v").alias("m"))
    back = out.select(F.col("m").alias("c"), F.col("c").alias("m"))
    pick = Window.partitionBy("c").orderBy(F.xxhash64("m"), "m")
    back = back.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= degree).drop("r")
    return out.union(back).distinct()


def _round(graph: DataFrame, points: DataFrame, degree: int, kind: str) -> DataFrame:
    """The graph after each vector's neighbours have met."""
    meet = _both_ways(graph, degree).union(graph.select(F.col("u").alias("c"), F.col("u").alias("m")))
    worst = F.when(F.size("near") >= degree, F.element_at("near.s", -1)).otherwise(-2.0)
    carried = points.select(F.col("node").alias("m"), "vec").join(
        graph.select(F.col("u").alias("m"), worst.alias("worst")), "m")
    rows = meet.join(carried, "m").groupBy("c").agg(
        F.collect_list("m").alias("ms"), F.collect_list("vec").alias("vecs"),
        F.collect_list("worst").alias("worsts")).select("ms", "vecs", "worsts")

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, worsts = (c.flatten().to_numpy() for c in (part.column(0), part.column(2)))
            data = part.column(1).flatten()  # of one length within a list
            ends = np.cumsum(part.column(0).value_lengths().to_numpy())
            found: list[tuple] = []
            held = 0
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                vectors = _matrix(data.slice(a, b - a).to_pylist(), kind)
                s = vectors @ vectors.T
                np.fill_diagonal(s, -3)
                i, j = np.nonzero(s > worsts[a:b, None])
                found.append((ids[a:b][i], ids[a:b][j], s[i, j]))
                held += len(i)
                if held > 2_000_000:
                    yield _best_of(*(np.concatenate(x) for x in zip(*found, strict=True)), degree)
                    found, held = [], 0
            if held:
                yield _best_of(*(np.concatenate(x) for x in zip(*found, strict=True)), degree)

    return _merge(graph.union(rows.mapInArrow(join, _NEAR)), degree)


def build_graph(points: DataFrame, degree: int = DEGREE, kind: str = "f8") -> DataFrame:
    """u, near: for every point (node, vec, codes) its best neighbours found, best first.

    A point without any comparable other has no row.
    """
    graph = settle(_first_graph(points, degree, kind))
    for _ in range(ROUNDS):
        before, graph = graph, settle(_round(graph, points, degree, kind))
        # Neighbours are counted, since scores among near copies hardly change.
        new = graph.join(before.select("u", F.col("near.v").alias("old")), "u").agg(
            F.sum(F.size(F.array_except("near.v", "old"))), F.sum(F.size("near"))).first()
        if (new[0] or 0) <= SETTLED * (new[1] or 0):
            break
    return graph


def _step(state: DataFrame, edges: DataFrame, points: DataFrame, kind: str) -> DataFrame:
    """State (q, vec, best, seen, open) after going on from the nodes in ``open``."""
    open_ = state.select("q", F.explode("open").alias("u"))
    reached = open_.join(edges, "u").select("q", F.explode("vs").alias("node")).distinct()
    met = reached.join(points.select("node", F.col("vec").alias("nvec")), "node").groupBy("q").agg(
        F.collect_list("node").alias("ids"), F.collect_list("nvec").alias("vecs"))
    rows = state.join(met, "q", "left").select("q", "vec", "best", "seen", "open", "ids", "vecs")

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = part_schema()
        for part in parts:
            out: list[list] = [[], [], [], [], []]
            for row in part.to_pylist():
                best = {x["v"]: x["s"] for x in row["best"]}
                seen = set(row["seen"]) | set(row["open"])
                ids = row["ids"] or []
                fresh = [k for k, v in enumerate(ids) if v not in best and v != row["q"]]
                if fresh:
                    s = _matrix([row["vecs"][k] for k in fresh], kind) @ _matrix([row["vec"]], kind)[0]
                    best |= {ids[k]: x for k, x in zip(fresh, s.tolist(), strict=True)}
                top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:KEPT]
                ahead = [v for v, _ in top if v not in seen][:BEAM]
                for column, value in zip(out, (
                        row["q"], row["vec"], [{"s": s, "v": v} for v, s in top],
                        [v for v, _ in top if v in seen], ahead), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds.types, strict=True)], names=kinds.names)

    return rows.mapInArrow(go, "q bigint, vec binary, best array<struct<s:double,v:bigint>>, "
                               "seen array<bigint>, open array<bigint>")


def part_schema() -> pa.Schema:
    ids = pa.list_(pa.int64())
    return pa.schema([("q", pa.int64()), ("vec", pa.binary()),
                      ("best", pa.list_(pa.struct([("s", pa.float64()), ("v", pa.int64())]))),
                      ("seen", ids), ("open", ids)])


def search(graph: DataFrame, points: DataFrame, starts: DataFrame, kind: str = "f8") -> DataFrame:
    """q, best: for each point of ``starts`` (node) the ``KEPT`` nearest others that the search found."""
    own = starts.select(F.col("node").alias("q")).distinct()
    ids = F.array().cast("array<bigint>")
    state = settle(
        own.join(points.select(F.col("node").alias("q"), "vec"), "q")
        .join(graph.select(F.col("u").alias("q"), F.col("near").alias("best")), "q")
        .select("q", "vec", "best", ids.alias("seen"), F.slice("best.v", 1, BEAM).alias("open")))
    edges = settle(_both_ways(graph, DEGREE).groupBy(F.col("c").alias("u")).agg(F.collect_list("m").alias("vs")))
    done = None
    for _ in range(STEPS):
        state = settle(_step(state, edges, points, kind))
        over = state.where(F.size("open") == 0).select("q", "best")
        done = over if done is None else done.union(over)
        state = state.where(F.size("open") > 0)
        if not state.limit(1).count():
            break
    return done.union(state.select("q", "best"))


def _cosine(a: str, b: str) -> Column:
    """In double precision, on the vectors as given, scaled by powers of two so that squares stay finite."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda p, q: p + q)

    def scaled(x: str) -> Column:
        top = F.array_max(F.transform(x, F.abs))
        unit = F.pow(F.lit(2.0), F.floor(F.log2(top)))
        extreme = (top > 1e100) | (top < 1e-100)
        return F.transform(x, lambda v: v / F.when(extreme, unit).otherwise(1.0))

    x, y = scaled(a), scaled(b)
    norm = lambda v: F.sqrt(total(F.transform(v, lambda c: c * c)))
    return total(F.zip_with(x, y, lambda p, q: p * q)) / (norm(x) * norm(y))


def nearest(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the ``k`` nearest other rows found.

    ``rows`` has vec_id and embedding; queries are the rows that ``is_query``
    picks, and all rows are candidates but the query's own. Nearest is the
    largest cosine, in double precision on the vectors as given; ties go to the
    smaller vec_id. Vectors null, zero or with null or non-finite components
    take no part, nor do rows without vec_id; vectors of different lengths are
    not compared. Copies of a vector are all found. With fewer than ``k``
    candidates there are fewer rows. Rows that repeat a vec_id and its vector
    count once.

    A round deals each vector to some 50 others, so what it shuffled goes before
    the next one begins.
    """
    ship(rows.sparkSession)
    with tidy_shuffles(rows.sparkSession):
        return _nearest(rows, is_query, k)


def _nearest(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """The same, evaluated."""
    sound = usable(rows)
    members = settle(_points(sound, k + 1))
    nodes = members.where("vec_id = node")
    count = nodes.count()
    bits = max(0, int(np.ceil(np.log2(max(count, 1) / BLOCK))))
    # Components of a type that holds them exactly.
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "f4" if single else "f8"
    points = settle(_sketched(nodes, bits, kind))
    graph = build_graph(points, kind=kind)
    asked = settle(sound.where(is_query).select(
        F.col("vec_id").alias("query_id"), F.col("e").alias("qe"), F.xxhash64("e").alias("h1"),
        F.xxhash64(F.lit(7), "e").alias("h2")).join(nodes.select("h1", "h2", "node"), ["h1", "h2"])
        .drop("h1", "h2").dropDuplicates(["query_id", "node"]))
    found = search(graph, points, asked, kind)
    # All that may be among the best once they are scored as the result is; sums differ by far less.
    last = F.coalesce(F.try_element_at("best.s", F.lit(k)), F.lit(-2.0)) - 1e-9
    wide = found.select(F.col("q").alias("node"), F.explode(
        F.transform(F.filter("best", lambda x: x["s"] >= last), lambda x: x["v"])).alias("other"))
    near = asked.select("node").distinct().select("node", F.col("node").alias("other")).union(wide)
    scored = (asked.join(near, "node")
              .join(members.select(F.col("node").alias("other"), "vec_id", "e"), "other")
              .where("vec_id <> query_id").select("query_id", "vec_id", _cosine("qe", "e").alias("score")))
    ranked = settle(_ranked(scored, k))
    # A query that the search found too little for is compared with every row, in as many blocks as there are tasks.
    full = ranked.where(F.col("rank") == k).select("query_id")
    short = settle(asked.join(full, "query_id", "left_anti"))
    if not short.limit(1).count():
        return ranked
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = short.select("query_id", "qe", F.size("qe").alias("dim"), F.explode(
        F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    dealt = members.select("vec_id", "e", F.size("e").alias("dim"),
                           F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"))
    every = spread.join(dealt, ["dim", "part"]).where("vec_id <> query_id").select(
        "query_id", "vec_id", _cosine("qe", "e").alias("score"))
    return settle(ranked.join(short.select("query_id"), "query_id", "left_anti").select(
        "query_id", "rank", "vec_id", "score").union(_ranked(every, k)))


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of each query."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
