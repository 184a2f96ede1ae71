"""Language identification by cross-parsing.

For each language a suffix automaton holds some labelled text. A text is parsed
against it: a phrase is the longest run of characters that occurs in the
language's text, with the character that breaks it. The language that needs the
fewest phrases, normalised by the length of what its automaton has seen, wins:
phrases * log2(length seen) / characters estimates the cross entropy.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.shipping import ship
from daybook.llm.workers import give_back, make_room

UNKNOWN = "und"

#: Bounds of what is learned from: documents per language, characters of each, characters per language.
SAMPLE_DOCS, SAMPLE_CHARS, SEEN_CHARS = 400, 1_000, 40_000
#: Size up to which a model is sent to the executors.
MODEL_BYTES = 400_000_000
#: Texts are parsed in stretches of so many characters, all at once; a stretch starts a new phrase.
STRETCH = 512
#: Characters parsed together.
BLOCK = 2_000_000


def fold_table() -> np.ndarray:
    """Code point to code point: letters in lower case (of one character), all else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_FOLD: list[np.ndarray] = []


def fold(text: str) -> np.ndarray:
    """Lower-case letters as code points; every run of other characters is one space."""
    if not _FOLD:
        _FOLD.append(fold_table())
    codes = _FOLD[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = codes != 32
    keep[1:] |= codes[:-1] != 32
    return codes[keep]


@dataclass(frozen=True)
class Automaton:
    """Transitions of a state as a comb: the one by letter c is at ``base[state] + c``, if ``owner`` there is the state.

    Teeth of different states fill each other's gaps, so the size is that of the
    transitions, of which there are at most three for each character, however
    large the alphabet.
    """

    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.base.nbytes + self.owner.nbytes + self.target.nbytes


def suffix_automaton(codes: np.ndarray, letters: int) -> Automaton:
    """Of all that occurs in ``codes`` (1 to ``letters`` - 1); the root is state 0."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return _combed(moves, letters)


def _combed(moves: list[dict[int, int]], letters: int) -> Automaton:
    """Place the rows of transitions, those with the most first, where all of their teeth find a gap."""
    free = bytearray()
    base = np.zeros(len(moves), np.int64)
    width, at, end = 0, letters, 0
    for state in sorted(range(len(moves)), key=lambda s: -len(moves[s])):
        row = sorted(moves[state])
        if not row:
            break
        if len(row) != width:
            width, at = len(row), letters
        place, tried = at, 0
        while True:
            place = free.find(1, place)
            if place < 0 or place + letters >= len(free):
                place = len(free) if place < 0 else place
                free += bytearray(b"\1") * (len(free) + 2 * letters)
            if all(free[place + c - row[0]] for c in row):
                break
            place += 1
            tried += 1
        if tried > 50:  # what is in front is too full for rows of this width
            at = place
        base[state] = place - row[0]
        for c in row:
            free[base[state] + c] = 0
        end = max(end, int(base[state]) + letters)
    owner, target = np.full(end + 1, -1, np.int64), np.zeros(end + 1, np.int64)
    for state, row in enumerate(moves):
        for c, to in row.items():
            owner[base[state] + c], target[base[state] + c] = state, to
    small = np.int32 if end < 2**31 else np.int64
    return Automaton(base.astype(small), owner.astype(small), target.astype(small))


@dataclass(frozen=True)
class Model:
    """Languages, the letters that any of them has, and the automaton of each."""

    languages: tuple[str, ...]
    alphabet: np.ndarray  # sorted code points; letter 0 is any other
    automata: tuple[Automaton, ...]
    bits: np.ndarray  # log2 of the characters seen

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in self.automata) + self.alphabet.nbytes

    @property
    def letter_bits(self) -> float:
        """What a character takes if letters are drawn from the alphabet without any order."""
        return float(np.log2(len(self.alphabet)))


def build(texts: dict[str, list[str]]) -> Model:
    """A model from texts by language; a language whose texts have no letter is left out."""
    seen = {}
    for name in sorted(texts):
        joined = fold(" ".join(texts[name]))[:SEEN_CHARS]
        if (joined != 32).any():
            seen[name] = joined
    alphabet = np.unique(np.concatenate([*seen.values(), np.array([32], np.uint32)]))
    automata = [suffix_automaton(np.searchsorted(alphabet, codes) + 1, len(alphabet) + 1) for codes in seen.values()]
    return Model(tuple(seen), alphabet, tuple(automata), np.log2([len(c) + 1 for c in seen.values()]))


def phrases(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Phrases of each folded text (row) in each language (column)."""
    counts = np.zeros((len(texts), len(model.languages)))
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.concatenate([*texts, np.zeros(0, np.uint32)])
    at = np.minimum(np.searchsorted(model.alphabet, codes), len(model.alphabet) - 1)
    letter = np.where(model.alphabet[at] == codes, at + 1, 0).astype(np.int32)
    pieces = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(texts)), pieces)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(np.cumsum(sizes) - sizes, pieces) + rank * STRETCH
    length = np.minimum(np.repeat(sizes, pieces) - rank * STRETCH, STRETCH)
    order = np.argsort(-length, kind="stable")
    owner, begin, length = owner[order], begin[order], length[order]
    alive = np.searchsorted(-length, -np.arange(STRETCH), side="left")  # stretches longer than t
    for k, own in enumerate(model.automata):
        state = np.zeros(len(owner), own.base.dtype)
        broken = np.zeros(len(owner), np.int32)
        for t in range(STRETCH):
            n = alive[t]
            if not n:
                break
            now = state[:n]
            tooth = own.base[now] + letter[begin[:n] + t]
            met = own.owner[tooth] == now
            broken[:n] += ~met
            state[:n] = np.where(met, own.target[tooth], 0)
        counts[:, k] = np.bincount(owner, broken + (state != 0), len(texts))
    return counts


def sample(docs: DataFrame, texts_per_language: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """Some hundred documents of each label, the same ones at every run: the least text hashes.

    A first pass counts each label's distinct texts, about, as copies are one text of
    the sample; a second keeps the share that is needed with some to spare; only
    those are ranked.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counted = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("texts")).collect()
    if not counted:
        return {}
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    most = F.lit(0)
    for row in counted:
        share = min(1.0, (4 * texts_per_language + 100) / max(row["texts"], 1))
        most = F.when(F.col("lang") == row["lang"], int(share * (1 << 30))).otherwise(most)
    near = labelled.where(place < most).select(
        "lang", place.alias("place"), F.substring("text", 1, SAMPLE_CHARS).alias("text")).distinct()
    top = near.groupBy("lang").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("place", "text"))), 1, texts_per_language).alias("rows"))
    return {r["lang"]: [x["text"] for x in r["rows"]] for r in top.collect()}


def learn(docs: DataFrame) -> Model:
    """A model from ``docs`` (text, lang); rows without a label or a letter teach nothing."""
    return build(sample(docs))


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score, bits: a language for every whole text.

    ``und`` with score 0 if the text is null, empty or has no letter, or if
    nothing was learned. ``score`` is the lead over the second best language, as
    a share of its entropy; 1 if only one language is known. Ties go to the
    language whose name orders first. ``bits`` is the entropy that it wins with,
    for a character, and null where there is none. Only ``text`` is looked at; every row
    gives a row.
    """
    # Bounded by SEEN_CHARS for each language: some 4 MB at most.
    if model.nbytes > MODEL_BYTES:
        raise ValueError(f"{len(model.languages)} languages make a model of {model.nbytes} bytes; {MODEL_BYTES} may be sent")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        own = shared.value
        folded = [fold(t or "") for t in texts]
        lettered = np.array([bool((c != 32).any()) for c in folded], bool)
        names, scores, least = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
        if not len(own.languages):
            return names, scores, least
        bits = phrases(own, folded) * own.bits / np.maximum([len(c) for c in folded], 1)[:, None]
        first = np.argmin(bits, axis=1)
        ranked = np.sort(bits, axis=1)
        lead = (1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-12)
                if len(own.languages) > 1 else np.ones(len(texts)))
        for i in np.flatnonzero(lettered):
            names[i], scores[i] = own.languages[first[i]], float(min(1.0, max(0.0, lead[i])))
            least[i] = float(ranked[i, 0])
        return names, scores, least

    def predict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for part in parts:
            at, rows = 0, part.num_rows
            texts = part.column("text" if "text" in keep else "__text")
            while at < rows:
                block, size = [], 0
                while at + len(block) < rows and size < BLOCK:
                    block.append(texts[at + len(block)].as_py())
                    size += len(block[-1] or "")
                names, scores, least = decide(block)
                own = part.slice(at, len(block))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                     pa.array(least, pa.float64())], names=[*keep, "lang_pred", "score", "bits"])
                at += len(block)
            give_back()

    ship(docs.sparkSession)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    # A text that is kept is not sent twice.
    texts = [] if "text" in keep else [F.col("text").cast("string").alias("__text")]
    return docs.select(*keep, *texts).mapInArrow(
        predict, f"{kinds}, lang_pred string, score double, bits double")
