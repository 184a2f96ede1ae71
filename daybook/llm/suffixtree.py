"""Language model scores by a probabilistic suffix tree over words.

A context is what a text's last words are, up to ``depth`` of them. How often
each context and each next word after it occur is counted over all training
texts. Contexts grow where they diverge: a context is counted for the words
after it only if its own last word comes significantly more often than the
shorter context predicts, and it is retained if its next-word counts, each held
against the others, predict the training texts better than its longest retained
suffix does. A retained context mixes its counts with the distribution of that
suffix, the empty context being the smoothed word counts. A word is scored by
the longest retained context that it follows.

Texts are cut once into chunks of numbered words, a row each. What the chunks
have to know of the whole corpus, they ask for in sorted blocks of 64-bit keys
with numbers; blocks of one range of keys meet in a task, which answers each
with the sums over all chunks. So a task holds a chunk or a range of keys, and
nothing that grows with the corpus; a frequent word is one key for each chunk.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from math import log

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from daybook.llm.shipping import ship
from daybook.session import scratch

#: Bytes of text in a chunk, and bytes that are split into words at a time.
CHUNK = 12 << 20
SLICE = 1 << 20
#: Keys of all chunks that are summed in one task.
TOGETHER = 500_000
#: Steps of a natural logarithm in which divergences are summed, so that any order gives the same.
STEPS = 1e6
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Stands for the end of a text; no word holds white space.
END = b"\n"


@dataclass(frozen=True)
class Settings:
    """Of contexts by their number of words, from one on: words that the suffix's distribution counts for.

    ``grow`` and ``retain`` are what a divergence has to exceed, in units of ln N.
    """

    weights: tuple[float, ...] = (1000.0, 10.0)
    grow: float = 2.0
    retain: float = 1.0

    @property
    def depth(self) -> int:
        return len(self.weights)


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers by their bytes' places, where small ones leave whole stretches empty."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _stretched(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _slices(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        space = SPACE.search(data, at + SLICE)
        end = space.start() if space else len(data)
        yield data[at:end]
        at = end


class _Chunk:
    """Words of whole texts or of parts of texts; a part begins with the words before it."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.bytes = 0
        self.ids: list[np.ndarray] = []
        self.rows: list[tuple] = []  # row, doc_id, held out, whole
        self.sizes: list[int] = []
        self.leads: list[int] = []

    def begin(self, row: int, doc_id: object, held: bool, lead: list[bytes]) -> None:
        self.rows.append((row, doc_id, held, True))
        self.leads.append(len(lead))
        self.sizes.append(0)
        self.add(lead)

    def add(self, words: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words)))
        self.sizes[-1] += len(words)

    def record(self, name: int, schema: pa.Schema) -> pa.RecordBatch:
        """The chunk's row; words are numbered by how often they occur."""
        ids = np.concatenate(self.ids)
        order = np.argsort(-np.bincount(ids), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = np.array([xxhash.xxh64_intdigest(w) for w in self.number], np.uint64)[order]
        row, doc_id, held, whole = (list(c) for c in zip(*self.rows, strict=True))
        packed = [_squeezed(np.array(x, np.uint32)) for x in (self.sizes, self.leads)]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip(
                (name, row, doc_id, held, whole, *packed, _squeezed(rank[ids]), words.tobytes(), len(ids), len(words)),
                schema, strict=True)],
            schema=schema)


def _cut(parts: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    place = TaskContext.get().partitionId()
    row, name, chunk, schema = place << 40, place << 24, _Chunk(), None
    for part in parts:
        schema = schema or pa.schema([
            ("chunk", pa.int64()), ("row", pa.list_(pa.int64())), ("doc_id", pa.list_(part.schema.field(0).type)),
            ("held", pa.list_(pa.bool_())), ("whole", pa.list_(pa.bool_())), ("sizes", pa.binary()),
            ("leads", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary()),
            ("n_tokens", pa.int64()), ("n_words", pa.int64())])
        for doc_id, held, text in zip(*part.columns, strict=True):
            doc_id, held, data = doc_id.as_py(), held.as_py(), (text.as_py() or "").encode().lower()
            chunk.begin(row, doc_id, held, [])
            before: list[bytes] = []
            for piece in _slices(data):
                if chunk.bytes >= CHUNK:
                    chunk.rows[-1] = (row, doc_id, held, False)
                    yield chunk.record(name, schema)
                    chunk, name = _Chunk(), name + 1
                    chunk.begin(row, doc_id, held, before)
                    chunk.rows[-1] = (row, doc_id, held, False)
                words = piece.split()
                chunk.add(words)
                chunk.bytes += len(piece)
                before = (before + words[-depth:])[-depth:]
            chunk.add([END])
            chunk.bytes += 1
            row += 1
            if chunk.bytes >= CHUNK:
                yield chunk.record(name, schema)
                chunk, name = _Chunk(), name + 1
    if chunk.rows:
        yield chunk.record(name, schema)


def _cut_into_chunks(docs: DataFrame, held: Column, depth: int) -> DataFrame:
    """A table of chunks that is dealt by chunk, so that answers come to it without moving it."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = scratch(spark, "chunks")
    rows = docs.select("doc_id", held.alias("held"), F.col("text").cast("string").alias("text")).mapInArrow(
        partial(_cut, depth=depth),
        f"chunk bigint, row array<bigint>, doc_id array<{kind}>, held array<boolean>, whole array<boolean>, "
        "sizes binary, leads binary, tokens binary, words binary, n_tokens bigint, n_words bigint")
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = "chunks_" + path.rsplit("-", 1)[-1]
    rows.write.bucketBy(buckets, "chunk").option("path", path).saveAsTable(table)
    return spark.table(table)


class _Local:
    """What a chunk knows: its words, and of each level as far as answers have come, the counts."""

    def __init__(self, chunk: dict, settings: Settings):
        self.settings = settings
        self.ids = _stretched(chunk["tokens"], np.uint32).astype(np.int64)
        self.words = np.frombuffer(chunk["words"], np.uint64)
        self.sizes = _stretched(chunk["sizes"], np.uint32).astype(np.int64)
        leads = _stretched(chunk["leads"], np.uint32).astype(np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.ids)) - np.repeat(self.begins, self.sizes)
        self.counted = self.place >= np.repeat(leads, self.sizes)
        self.train = self.counted & ~np.repeat(np.array(chunk["held"], bool), self.sizes)
        self.event = self.words[self.ids]  # key of the words up to here that the level looks at
        self.level = 0
        self.at = np.arange(len(self.ids))  # where the level's events are
        self._index()

    def _index(self) -> None:
        """The level's distinct events, sorted, and which of them is at each of its places."""
        self.keys, inverse = np.unique(self.event[self.at], return_inverse=True)
        self.which = inverse

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The level's events and their training counts here."""
        return self.keys, np.bincount(self.which, self.train[self.at], len(self.keys)).astype(np.int64)

    def counts_are(self, totals: np.ndarray, vocabulary: int = 0, tokens: int = 0) -> None:
        """Take the corpus' counts of the level's events."""
        counts = np.zeros(len(self.ids), np.int64)
        counts[self.at] = totals[self.which]
        if self.level == 0:
            self.known = counts
            self.total = tokens + 0.5 * (vocabulary + 1)
            self.logp = np.log((counts + 0.5) / self.total)
            self.base = self.logp.copy()
            self.bound = log(max(tokens, 2))
        else:
            self.before = self.count[self.at - 1]  # of the context
        self.count = counts

    def divergences(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the level's contexts, and what each gains here over its suffix, a word left out at a time."""
        learnt = self.train[self.at]
        at = self.at[learnt]
        count, before, suffix = self.count[at], self.before[learnt], np.exp(self.logp[at])
        weight = self.settings.weights[self.level - 1]
        gain = np.log((count - 1 + weight * suffix) / (before - 1 + weight)) - self.logp[at]
        contexts, context = np.unique(self.context_keys, return_inverse=True)
        # Whole numbers, so their sums are exact.
        total = np.bincount(context[learnt], np.rint(gain * STEPS), len(contexts))
        return contexts, total.astype(np.int64)

    def retain(self, gains: np.ndarray) -> None:
        """Move on to the retained contexts' distributions, by the corpus' sums of ``divergences``."""
        _, context = np.unique(self.context_keys, return_inverse=True)
        kept = (gains > self.settings.retain * self.bound * STEPS)[context]
        at, before, weight = self.at[kept], self.before[kept], self.settings.weights[self.level - 1]
        self.logp[at] = np.log((self.count[at] + weight * np.exp(self.logp[at])) / (before + weight))

    def grow(self) -> None:
        """On to contexts of a word more: those whose own last word their suffix does not explain.

        Has to be called before ``retain``: whether an event grows then depends on itself alone.
        """
        at = self.at
        if self.level:
            count, expected = self.count[at], self.before * np.exp(self.logp[at])
            far = count * np.log(np.maximum(count, 1) / np.maximum(expected, 1e-300))
            at = at[(count >= 2) & (far >= self.settings.grow * self.bound)]
        at = at[at + 1 < len(self.ids)] + 1
        at = at[self.place[at] > self.level]
        self.next = at

    def climb(self) -> None:
        at = self.next
        self.context_keys = self.event[at - 1]
        event = np.zeros(len(self.ids), np.uint64)
        event[at] = _mixed(self.context_keys * np.uint64(3) + self.words[self.ids[at]])
        self.event, self.at, self.level = event, at, self.level + 1
        self._index()

    def scores(self, chunk: dict) -> dict[str, list]:
        some = self.sizes > 0

        def summed(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(some), x.dtype)
            out[some] = np.add.reduceat(np.where(self.counted, x, 0), self.begins[some])
            return out

        ten = log(10)
        return {"row": chunk["row"], "doc_id": chunk["doc_id"], "held_out": chunk["held"], "whole": chunk["whole"],
                "n_tokens": summed(np.ones(len(self.ids), np.int64)), "n_known": summed((self.known > 0).astype(np.int64)),
                "base_score": summed(self.base / ten), "score": summed(self.logp / ten)}


# Kinds of questions: counts of a level's events are 2 * level, divergences of its contexts 2 * level + 1.
ASKED = "kind int, range bigint, chunk bigint, keys binary, numbers binary"
ANSWERED = "kind int, range bigint, chunk bigint, sums binary, present bigint, amount bigint"


def _blocks(kind: int, chunk: int, keys: np.ndarray, numbers: np.ndarray, bits: int) -> list[tuple]:
    ranges = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(ranges)) + 1
    begin, end = np.r_[0, cuts], np.r_[cuts, len(keys)]
    return [(kind, int(ranges[a]), chunk, _squeezed(np.diff(keys[a:b], prepend=np.uint64(0))), _squeezed(numbers[a:b]))
            for a, b in zip(begin.tolist(), end.tolist(), strict=True) if b > a]


def _asked_rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                names=["kind", "range", "chunk", "keys", "numbers"])


def _sum_range(rows: pa.Table) -> pa.Table:
    """Answers the blocks of one range of keys with the sums over all of them."""
    keys = [np.cumsum(_stretched(b, np.uint64), dtype=np.uint64) for b in rows.column("keys").to_pylist()]
    numbers = np.concatenate([_stretched(b, np.int64) for b in rows.column("numbers").to_pylist()])
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(which, numbers, len(distinct)).astype(np.int64)
    own = np.split(sums[which], np.cumsum([len(k) for k in keys])[:-1])
    once = [0] * (len(keys) - 1)
    return pa.Table.from_pydict({
        "kind": rows.column("kind"), "range": rows.column("range"), "chunk": rows.column("chunk"),
        "sums": pa.array([_squeezed(s) for s in own], pa.binary()),
        "present": pa.array([int((sums > 0).sum()), *once], pa.int64()),
        "amount": pa.array([int(numbers.sum()), *once], pa.int64())})


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _exchange(asked: DataFrame) -> DataFrame:
    return _stored(asked.groupBy("kind", "range").applyInArrow(_sum_range, ANSWERED), "answers")


class _Answers:
    """Of one chunk, by kind, in the order of its keys."""

    def __init__(self, rows: pa.Table):
        self.by: dict[int, list] = defaultdict(list)
        for kind, at, sums in zip(*(rows.column(c).to_pylist() for c in ("kind", "range", "sums")), strict=True):
            self.by[kind].append((at, sums))

    def of(self, kind: int) -> np.ndarray:
        blocks = [_stretched(s, np.int64) for _, s in sorted(self.by.get(kind, []))]
        return np.concatenate([np.empty(0, np.int64), *blocks])


def _climbed(chunk: dict, answers: _Answers, level: int, settings: Settings, corpus: tuple[int, int]) -> _Local:
    """The chunk with the counts of all events up to ``level`` and the contexts retained below it."""
    local = _Local(chunk, settings)
    local.counts_are(answers.of(0), *corpus)
    for k in range(1, level + 1):
        local.grow()
        if k > 1:
            local.retain(answers.of(2 * k - 1))
        local.climb()
        local.counts_are(answers.of(2 * k))
    return local


def suffix_tree_scores(
    docs: DataFrame, held_out: Column, settings: Settings = Settings()
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each text of ``docs``.

    Words are what white space (U+0020, U+0009 to U+000D) separates, A-Z in lower
    case; an end follows them and is a token like them. The model is learnt from
    the rows that are not ``held_out`` (null: not). ``base_score`` is that of the
    words' counts alone, smoothed by a half for each word known and one unknown,
    ``score`` that of the suffix tree; both are log10 probabilities of the text.
    A null text is an empty one, which has its end. Every row gives a row;
    repeated rows are learnt from and scored each; doc_id may be null. Without
    training texts all words are unknown. No rows give no rows. Other columns are
    not looked at. A text longer than a chunk is cut between words; its parts
    know the words before them.
    """
    ship(docs.sparkSession)
    chunks = _cut_into_chunks(docs, F.coalesce(held_out, F.lit(False)), settings.depth)
    sizes = chunks.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    # A chunk asks for each of its words once, and for two in three of its pairs of words.
    words, events = (max(0, (int(n or 0) // TOGETHER).bit_length()) for n in (sizes[0], (sizes[1] or 0) * 2 // 3))

    def first(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for chunk in part.to_pylist():
                local = _Local(chunk, settings)
                rows = _blocks(0, chunk["chunk"], *local.asked(), words)
                if settings.depth:
                    local.grow()
                    local.climb()
                    rows += _blocks(2, chunk["chunk"], *local.asked(), events)
                yield from _asked_rows(rows).combine_chunks().to_batches()

    def climb(level: int, corpus: tuple[int, int]) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def ask(chunks: pa.Table, answers: pa.Table) -> pa.Table:
            chunk = chunks.to_pylist()[0]
            local = _climbed(chunk, _Answers(answers), level, settings, corpus)
            rows = _blocks(2 * level + 1, chunk["chunk"], *local.divergences(), words if level == 1 else events)
            if level < settings.depth:
                local.grow()
                local.climb()
                rows += _blocks(2 * level + 2, chunk["chunk"], *local.asked(), events)
            return _asked_rows(rows)
        return ask

    needed = chunks.select("chunk", "held", "sizes", "leads", "tokens", "words")
    answers = _exchange(needed.mapInArrow(first, ASKED))
    of_words = answers.where("kind = 0").agg(F.sum("present"), F.sum("amount")).first()
    corpus = tuple(int(x or 0) for x in of_words)
    for level in range(1, settings.depth + 1):
        asked = needed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(climb(level, corpus), ASKED)
        answers = answers.union(_exchange(asked))
    return _scored(chunks, answers, settings, corpus)


def _scored(chunks: DataFrame, answers: DataFrame, settings: Settings, corpus: tuple[int, int]) -> DataFrame:
    def score(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        chunk, known = chunks.to_pylist()[0], _Answers(answers)
        local = _climbed(chunk, known, settings.depth, settings, corpus)
        if settings.depth:
            local.retain(known.of(2 * settings.depth + 1))
        return pa.Table.from_pydict({k: pa.array(v, kinds.get(k)) for k, v in local.scores(chunk).items()})

    id_type = chunks.schema["doc_id"].dataType.elementType
    kinds = {"doc_id": to_arrow_type(id_type), "held_out": pa.bool_(), "whole": pa.bool_()}
    scored = _stored(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        score, f"row bigint, doc_id {id_type.simpleString()}, held_out boolean, whole boolean, n_tokens bigint, "
               "n_known bigint, base_score double, score double"), "scores")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    in_parts = scored.where("NOT whole").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus[1]).cast("bigint").alias("train_tokens"),
               "base_score", "score"]
    return scored.where("whole").select(*columns).union(in_parts.select(*columns))
