"""Byte-pair encoding with a pair occurrence index.

All words of a batch that were not met before are laid out as one array of
symbols. An index maps each mergeable pair to all its positions; the ranks that
occur are applied in ascending order to every position at once, and the lists
of the pairs that a merge makes or breaks are updated. Words are met again and
again, so their encodings are kept for the following rows, in two generations:
a piece that is met moves to the newer one, and the older one is dropped when
the newer is full. So common pieces stay, however many rare ones come by.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.shipping import ship
from daybook.llm.workers import give_back, keeps

#: Encoded pieces of text after which a worker's table takes its next turn: what was
#: met in neither of the last two turns is forgotten.
KEPT = 250_000
#: Characters of text whose pieces are looked up together, and of a slice of a text longer than that.
TOGETHER, SLICE = 8_000_000, 1_000_000

# The byte alphabet and the word pattern of the vocabulary.
PRINTABLE = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

# Up to here lower case, composition and letters mean the same in Python as in
# the library; texts with other characters, or with the separators that only
# Python takes for white space, are normalised and split by the library.
_SPACE = re.compile("[ \t\n]")
PLAIN = re.compile("[^\x00-\x1b\x20-ɏ]")
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_alphabet() -> list[str]:
    own = [b for span in PRINTABLE for b in span]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


class PairIndex:
    """Encodes lists of words; ``merges`` by rank."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + WORD_END] for c in letters], np.int64)
        self.merged = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        pairs = self.merged[:, 0] << 32 | self.merged[:, 1]
        self.by_pair = np.argsort(pairs)
        self.pairs = np.r_[pairs[self.by_pair], np.iinfo(np.int64).max]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 if they are never merged."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.by_pair[np.minimum(at, len(self.by_pair) - 1)], -1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word's begin."""
        data = "".join(words).encode()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if len(data) > sizes.sum():
            sizes = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
        ends = np.cumsum(sizes)
        codes = np.frombuffer(data, np.uint8)
        n = len(codes)
        symbols = self.inner[codes]
        symbols[ends - 1] = self.final[codes[ends - 1]]
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[ends - sizes] = -1
        merged = np.zeros(n, np.int64)  # the turn of the last merge at each position
        turn = 0
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enter the positions under the pairs that begin there."""
            rank = self._ranks(symbols[at], symbols[after[at]])
            met = rank >= 0
            at, rank = at[met], rank[met]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                if r not in where:
                    where[r] = []
                    heapq.heappush(active, r)
                where[r].append(part)

        note(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            left, right, whole = self.merged[r].tolist()
            found = where.pop(r)
            i = np.concatenate(found) if len(found) > 1 else found[0]
            if left == right:
                i = np.sort(i)
            j = after[i]
            # An earlier merge may have taken a symbol of the pair.
            live = (symbols[i] == left) & (j >= 0)
            live[live] = symbols[j[live]] == right
            i, j = i[live], j[live]
            if left == right and len(i) > 1:  # of pairs that overlap every other one, from the left
                begin = np.r_[True, i[1:] != j[:-1]]
                place = np.arange(len(i))
                take = (place - np.maximum.accumulate(np.where(begin, place, 0))) % 2 == 0
                i, j = i[take], j[take]
            if not len(i):
                continue
            k = after[j]
            turn += 1
            symbols[i], symbols[j], merged[i] = whole, -1, turn
            after[i] = k
            inside = k >= 0
            followed = i[inside]
            before[k[inside]] = followed
            previous = before[i]
            previous = previous[previous >= 0]
            # One that was merged now and is followed is in the list already.
            note(np.concatenate([previous[merged[previous] != turn], followed]))
        kept = symbols >= 0
        return symbols[kept], np.cumsum(kept)[ends - sizes] - 1


class Codec:
    """Encodes texts piece by piece.

    ``render`` turns a word's ids into what is kept, ``join`` what is kept of
    the words of a piece, or of the pieces of a text, into that of the whole.
    """

    def __init__(self, path: str, render: Callable[[list[int], list[str]], Any], join: Callable[[list], Any],
                 most: int | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END:
            raise ValueError(f"{path} is not a vocabulary of words with ends")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.index = PairIndex(model["vocab"], pairs)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.tokens = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in self.special) or r"(?!)")
        self.words = regex.compile(WORDS + r"|\n")  # line feeds stand between pieces
        self.render, self.join, self.most = render, join, most or KEPT
        self.path = path
        self.kept: dict[Any, Any] = {}  # met since the last turn
        self.aged: dict[Any, Any] = {}  # met in the turn before
        self._library = None

    def _split_by_library(self, text: str) -> list[tuple[str, ...]]:
        """Words of any text, each a piece of its own, marked as split already."""
        if self._library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self._library = (Tokenizer.from_file(self.path).normalizer,
                             pre_tokenizers.Split(Regex(WORDS), "removed", True))
        normal, split = self._library
        return [(w,) for w, _ in split.pre_tokenize_str(normal.normalize_str(text))]

    def _special(self, text: str) -> bool:
        return "<|" in text and self.cut.search(text) is not None

    def pieces(self, text: str) -> list:
        """Keys of the pieces: text without white space, a word, or a special token's id."""
        if self._special(text):
            out: list = []
            at = 0
            for m in self.cut.finditer(text):
                out += self.pieces(text[at:m.start()])
                out.append(self.special[m[0]])
                at = m.end()
            return out + self.pieces(text[at:])
        if not _plain(text):
            return self._split_by_library(text)
        return text.lower().split()

    def rendered(self, texts: Iterable[str]) -> Iterator[list]:
        """For each text what ``render`` made of its pieces, in order."""
        cut = [self.pieces(t) for t in texts]
        self._meet(set().union(*cut))
        kept = self.kept
        return ([kept[p] for p in pieces] for pieces in cut)

    def _meet(self, pieces: Iterable) -> None:
        """Have all of these pieces in the newer generation."""
        if len(self.kept) > self.most:  # what was not met since the last turn goes
            self.aged, self.kept = self.kept, {}
        kept, aged = self.kept, self.aged
        fresh = []
        for piece in pieces:
            if piece not in kept:
                known = aged.get(piece)
                if known is None:
                    fresh.append(piece)
                else:
                    kept[piece] = known
        self._learn(fresh)

    def joined(self, texts: list[str]) -> Iterator[Any]:
        """For each text what ``join`` makes of its pieces; of a long text some slices are held at a time."""
        short = map(self.join, self.rendered(t for t in texts if len(t) <= TOGETHER))
        for text in texts:
            if len(text) <= TOGETHER:
                yield next(short)
            else:
                yield self.join([self.join(p) for s in _slices(text) for p in self.rendered([s]) if p])

    def _learn(self, pieces: list) -> None:
        """A piece is made of its words; those are pieces, too, and mostly known."""
        kept, aged = self.kept, self.aged
        words: dict[Any, str] = {}
        mixed: list[str] = []
        for piece in pieces:
            if isinstance(piece, int):
                kept[piece] = self.render([piece], self.tokens)
            elif isinstance(piece, tuple):
                words[piece] = piece[0]
            elif piece.isalpha():
                words[piece] = piece
            else:
                mixed.append(piece)
        several: list[list[str]] = [[] for _ in mixed]
        at = 0
        for word in self.words.findall("\n".join(mixed)):
            if word == "\n":
                at += 1
                continue
            several[at].append(word)
            if word not in kept:
                if word in aged:
                    kept[word] = aged[word]
                else:
                    words[word] = word
        if words:
            ids, starts = self.index.encode(list(words.values()))
            kept.update(zip(words, self._rendered(ids, starts), strict=True))
        for piece, parts in zip(mixed, several, strict=True):
            if len(parts) != 1 or parts[0] != piece:
                kept[piece] = self.join([kept[word] for word in parts])

    def _rendered(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[Any]:
        flat, begin = ids.tolist(), [*starts.tolist(), len(ids)]
        return (self.render(flat[b:e], self.tokens) for b, e in pairwise(begin))


class ByteCodec(Codec):
    """Keeps ids as bytes, four of each in little-endian order.

    Arrow numbers the pieces of a batch and gathers their bytes, so that
    Python sees each distinct piece once a batch and not each occurrence.
    """

    def __init__(self, path: str, most: int | None = None):
        super().__init__(path, lambda ids, _: np.array(ids, "<u4").tobytes(), b"".join, most)

    def joined(self, texts: list[str]) -> Iterator[bytes]:
        short = self._whole([t for t in texts if len(t) <= TOGETHER])
        for text in texts:
            if len(text) <= TOGETHER:
                yield next(short)
            else:
                yield b"".join(data for s in _slices(text) for data in self._whole([s]))

    def _whole(self, texts: list[str]) -> Iterator[bytes]:
        plain = [not self._special(t) and _plain(t) for t in texts]
        fast = self._gathered([t for t, p in zip(texts, plain, strict=True) if p])
        slow = map(self.join, self.rendered(t for t, p in zip(texts, plain, strict=True) if not p))
        return (next(fast if p else slow) for p in plain)

    def _gathered(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of plain texts."""
        cut = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        named = cut.values.dictionary_encode()
        pieces = named.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._meet(pieces)
        ids = pa.array([self.kept[p] for p in pieces], pa.large_binary()).take(named.indices)
        if not len(ids):
            return iter([b""] * len(texts))
        _, ends, data = ids.buffers()
        at = np.frombuffer(ends, np.int64)[cut.offsets.to_numpy()].tolist()
        view = memoryview(data)
        return (bytes(view[b:e]) for b, e in pairwise(at))

    def _rendered(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
        data, begin = ids.astype("<u4").tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
        return (data[b:e] for b, e in pairwise(begin))


def _plain(text: str) -> bool:
    if text.isascii():
        return not any(c in text for c in SEPARATORS)
    return PLAIN.search(text) is None


def _slices(text: str) -> Iterator[str]:
    """Slices that begin at white space, which no word spans."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + SLICE)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


def _texts_of(ids: list[int], tokens: list[str]) -> tuple[int, str, str]:
    return len(ids), " ".join(map(str, ids)), " ".join([tokens[i] for i in ids])


def _join_texts(parts: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    return sum(p[0] for p in parts), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])


@lru_cache(maxsize=2)
def codec(path: str, render: Callable, join: Callable, most: int | None = None) -> Codec:
    """One per worker process, so that what it has learnt serves all its tasks."""
    return Codec(path, render, join, most)


# Some 100 to 200 MB, which other stages' tasks in the worker do without.
keeps(codec.cache_clear)


@lru_cache(maxsize=2)
def byte_codec(path: str) -> ByteCodec:
    """The same, of ids as bytes."""
    return ByteCodec(path)


keeps(byte_codec.cache_clear)


def batches(column: pa.Array, together: int = TOGETHER) -> Iterator[list[str]]:
    """The column's texts, some millions of characters at a time; a null is an empty text."""
    texts, size = [], 0
    for value in column:
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= together:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded: ids and decoded text as the tokenizers library gives.

    ``ids`` are decimals joined by one space. Special tokens written out in a
    text count as such, as in the library without further settings. A null text
    is an empty one: no ids and an empty decoded text. Every input row gives one
    row, repeated and null doc_ids included; other columns are not looked at. A
    long text is cut between words, so only its ids and decoded text, which are
    one value each, grow with it.
    """
    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A piece is two texts here, so fewer of them are held.
        own = codec(path, _texts_of, _join_texts, KEPT // 2)
        for part in parts:
            at = 0
            for texts in batches(part.column(1), TOGETHER // 2):
                found = list(own.joined(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(at, len(texts)), pa.array([f[0] for f in found], pa.int64()),
                     pa.array([f[1] for f in found], pa.string()),
                     pa.array([f[2] for f in found], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])
                at += len(texts)
            give_back()

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        encode, f"doc_id {kind}, n_tokens bigint, ids string, decoded string")
