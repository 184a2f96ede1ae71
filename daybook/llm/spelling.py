"""Spelling variants: words one edit apart, found by PartEnum signatures.

A word's letters are a multiset, that is a binary vector over (letter, its
occurrence). One replaced letter changes two places of the vector, one inserted
or deleted letter changes one. The places are partitioned into groups; whatever
two places differ, one of three groups agrees, and whatever one place differs,
one of two. The sums of the groups are enumerated as signatures, words are
joined where a signature is equal, and each candidate pair is verified letter
by letter. As anagrams have equal vectors, a signature also holds which third
of the word may have changed, and the letters before and behind it: an edit
lies in one of the thirds, so no pair is lost.

A signature that very many words share is not paired off. Its words are dealt
again by what is left when a letter of the third is deleted, which only words
an edit apart agree about.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.shipping import ship
from daybook.session import broadcast_if_small, settle

#: Words of one signature that are held against each other; more are dealt again.
HOT = 256
#: Distinct words that a task counts before it hands them on.
COUNTED = 500_000
#: Rows that are compared at a time.
ROWS = 200_000
#: Letters that are laid out at a time, if a single word has no more.
LETTERS = 4_000_000
REPLACED, INSERTED = 0, 1
#: Groups of the vector's places, by kind of edit: one more than the places that differ.
GROUPS = {REPLACED: 3, INSERTED: 2}
THIRDS = 3
SIGNED = "key bigint, kind tinyint, third tinyint, part tinyint, shorter tinyint, word string, n bigint"


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-spread bits of each number."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters(words: list[str], length: int) -> np.ndarray:
    """Words of one length as a matrix; all their letters are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)


def _places(letters: np.ndarray) -> np.ndarray:
    """For each letter the hash of its place in the vector: the letter and how often it came before."""
    order = np.argsort(letters, axis=1, kind="stable")
    ranked = np.take_along_axis(letters, order, axis=1)
    at = np.broadcast_to(np.arange(letters.shape[1]), letters.shape)
    begins = np.where(np.c_[np.ones(len(letters), bool), ranked[:, 1:] != ranked[:, :-1]], at, 0)
    times = at - np.maximum.accumulate(begins, axis=1)
    return _mixed(ranked.astype(np.uint64) << np.uint64(32) | times.astype(np.uint64))


def _group(places: np.ndarray, kind: int) -> np.ndarray:
    return (places >> np.uint64(8 * kind + 8)) % np.uint64(GROUPS[kind])


def _third(length: int, number: int) -> tuple[int, int]:
    return length * number // THIRDS, length * (number + 1) // THIRDS


def _signatures(letters: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """kind, third, part, shorter and the keys of all words, all of one length."""
    n, length = letters.shape
    places = _places(letters)
    at = np.arange(length, dtype=np.uint64) << np.uint64(16)
    begin = np.c_[np.zeros(n, np.uint64), np.cumsum(_mixed(letters + at), axis=1, dtype=np.uint64)]
    end = np.c_[np.zeros(n, np.uint64), np.cumsum(_mixed(letters[:, ::-1] + at), axis=1, dtype=np.uint64)]
    for kind in (REPLACED, INSERTED):
        group = _group(places, kind)
        sums = [np.where(group == g, places, 0).sum(axis=1, dtype=np.uint64) for g in range(GROUPS[kind])]
        for shorter in range(kind + 1):
            longer = length + shorter
            for third in range(THIRDS):
                low, high = _third(longer, third)
                rest = _mixed(begin[:, low] * np.uint64(3) + _mixed(end[:, longer - high]))
                for part, total in enumerate(sums):
                    which = (longer << 4 | kind << 3) + third * GROUPS[kind] + part
                    yield kind, third, part, shorter, _mixed(_mixed(rest + total) + np.uint64(which << 8))


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        length = int(lengths[own[0]])
        for few in _some(own, length):
            yield length, few


def _some(rows: np.ndarray, length: int) -> Iterator[np.ndarray]:
    step = max(1, LETTERS // length)
    return (rows[at:at + step] for at in range(0, len(rows), step))


def _sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        words = part.column(0).to_pylist()
        for length, own in _by_length(words):
            column, n = part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own))
            for *which, key in _signatures(_letters([words[i] for i in own], length)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), *(pa.array(np.full(len(own), w, np.int8)) for w in which),
                     column, n], names=["key", "kind", "third", "part", "shorter", "word", "n"])


def _keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _sign(parts):
        yield part.select(["key"])


def _deal_again(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hot signatures by what a deletion leaves, under which only words one edit apart meet."""
    for part in parts:
        kept: dict[str, list] = {name: [] for name in part.schema.names}
        for row in part.to_pylist():
            word, kind = row["word"], row["kind"]
            low, high = _third(len(word) + row["shorter"], row["third"])
            if row["shorter"]:
                left = [(0, word)]
            elif kind == INSERTED:  # from equal letters side by side any deletion leaves the same
                left = [(0, word[:i] + word[i + 1:]) for i in range(low, high) if i == low or word[i] != word[i - 1]]
            else:
                left = [(i, word[:i] + word[i + 1:]) for i in range(low, high)]
            for place, rest in left:
                text = np.frombuffer(rest.encode("latin-1"), np.uint8)
                own = _mixed(text + (np.arange(len(text), dtype=np.uint64) << np.uint64(16))).sum(dtype=np.uint64)
                key = _mixed(np.array([row["key"] ^ place], np.int64).view(np.uint64) * np.uint64(5) + own)
                for name in kept:
                    kept[name].append(int(key.view(np.int64)[0]) if name == "key" else row[name])
        yield pa.RecordBatch.from_pydict(kept, schema=part.schema)


def _top_place(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place in the vector that goes if the letter at ``at`` goes: its last occurrence."""
    letter = letters[np.arange(len(at)), at]
    times = (letters == letter[:, None]).sum(axis=1) - 1
    return _mixed(letter.astype(np.uint64) << np.uint64(32) | times.astype(np.uint64))


def _replaced(one: np.ndarray, other: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which pairs differ in one letter, and are to be named by this signature and no other."""
    differ = one != other
    single = differ.sum(axis=1) == 1
    at = differ.argmax(axis=1)
    a, b = (_group(_top_place(x, at), REPLACED) for x in (one, other))
    first = np.where((a != 0) & (b != 0), 0, np.where((a != 1) & (b != 1), 1, 2))
    return single & (first == part)


def _inserted(longer: np.ndarray, shorter: np.ndarray, third: np.ndarray, part: np.ndarray) -> np.ndarray:
    length = longer.shape[1]
    before = longer[:, :-1] != shorter
    at = np.where(before.any(axis=1), before.argmax(axis=1), length - 1)
    behind = (longer[:, 1:] != shorter) & (np.arange(length - 1) >= at[:, None])
    ends = np.array([_third(length, k)[1] for k in range(THIRDS)])
    return (~behind.any(axis=1) & (np.searchsorted(ends, at, side="right") == third)
            & (_group(_top_place(longer, at), INSERTED) != part))


def _near_rows(words: list[str], key: np.ndarray, n: np.ndarray, kind: np.ndarray, third: np.ndarray,
               part: np.ndarray, shorter: np.ndarray) -> pa.RecordBatch:
    """word, near, near_n in both directions, of rows sorted by key, then shorter; keys are whole."""
    lengths = np.array([len(w) for w in words], np.int64)
    found: list[np.ndarray] = []
    left, step = np.arange(len(key)), 1
    while len(left):
        left = left[left + step < len(key)]
        left = left[key[left] == key[left + step]]
        pairs = np.c_[left, left + step]
        step += 1
        if not len(pairs):
            continue
        whole = lengths[pairs[:, 0]]
        for kinds in (REPLACED, INSERTED):
            of_kind = (kind[pairs[:, 0]] == kinds) & (shorter[pairs[:, 0]] == 0) & (shorter[pairs[:, 1]] == kinds)
            # Equal hashes of words that do not belong together.
            of_kind &= lengths[pairs[:, 1]] == whole - kinds
            for length in np.unique(whole[of_kind]).tolist():
                for own in _some(pairs[of_kind & (whole == length)], length):
                    one = _letters([words[i] for i in own[:, 0]], length)
                    other = _letters([words[i] for i in own[:, 1]], length - kinds)
                    near = (_replaced(one, other, part[own[:, 0]]) if kinds == REPLACED
                            else _inserted(one, other, third[own[:, 0]], part[own[:, 0]]))
                    found.append(own[near])
    pairs = np.concatenate([np.empty((0, 2), np.int64), *found])
    both = np.concatenate([pairs, pairs[:, ::-1]])
    names = pa.array(words, pa.string())
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(both[:, 0])), names.take(pa.array(both[:, 1])), pa.array(n[both[:, 1]])],
        names=["word", "near", "near_n"])


def _verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Holds the rows of each key, which come one after another, against each other."""
    def ready(rows: pa.Table) -> pa.RecordBatch:
        columns = {name: rows.column(name).to_numpy() for name in rows.schema.names if name != "word"}
        return _near_rows(rows.column("word").to_pylist(), **columns)

    waiting: list[pa.RecordBatch] = []
    count = 0
    for part in parts:
        if not part.num_rows:
            continue
        waiting.append(part)
        count += part.num_rows
        if count < ROWS:
            continue
        rows = pa.Table.from_batches(waiting)
        keys = rows.column("key").to_numpy()
        whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
        yield ready(rows.slice(0, whole))
        waiting, count = rows.slice(whole).combine_chunks().to_batches(), len(keys) - whole
    if waiting:
        yield ready(pa.Table.from_batches(waiting))


def count_words(docs: DataFrame, doc_id: str = "doc_id", least_chars: int = 7) -> DataFrame:
    """word, n: runs of letters, some with a letter missing, and how often they occur in all texts.

    A run is a longest one of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower
    case. If 31 divides the crc32 of ``<doc_id>:<run>``, the letter at that crc32
    modulo the run's length is taken out. A null doc_id counts as an empty one, a
    null text has no runs.
    """
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least_chars},}}")
        seen: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for part in parts:
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                # Of bytes lower() touches A-Z alone.
                found = Counter(runs.findall((text or "").encode().lower().decode()))
                start = zlib.crc32(f"{doc}:".encode())
                for run, times in found.items():
                    crc = zlib.crc32(run.encode(), start)
                    if crc % 31 == 0:
                        cut = crc % len(run)
                        run = run[:cut] + run[cut + 1:]
                        if len(run) < least_chars:
                            continue
                    seen[run] += times
                if len(seen) >= COUNTED:
                    yield rows()
                    seen.clear()
        yield rows()

    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"),
                        F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: all pairs of ``words`` (word, n; all different) one edit apart, both ways."""
    ship(words.sparkSession)
    keys = words.select("word", "n").mapInArrow(_keys, "key bigint")
    hot = settle(keys.groupBy("key").count().where(F.col("count") > HOT).select("key"))
    rows = signed = words.select("word", "n").mapInArrow(_sign, SIGNED)
    if not hot.isEmpty():
        hot = broadcast_if_small(hot)
        rows = signed.join(hot, "key", "left_anti").unionByName(
            signed.join(hot, "key", "left_semi").mapInArrow(_deal_again, SIGNED))
    return rows.repartition("key").sortWithinPartitions("key", "shorter", "word").mapInArrow(
        _verify, "word string, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where following ``forms`` (word, form) ends; a form is far more common, so it ends soon."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = settle(now.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def group_spellings(
    docs: DataFrame, least_chars: int = 7, least_count: int = 2, times: int = 10
) -> DataFrame:
    """word, form, root, n, n_near, form_n: the common spelling that each rarer one belongs to.

    Words are those of ``count_words`` with ``least_chars`` code points and
    ``least_count`` occurrences. A word's form is, of the words one inserted,
    deleted or replaced code point away, the most frequent one (ties: the
    smallest in code-point order), if it is ``times`` as frequent; its root is
    where following the forms ends. Repeated rows count each; empty tables,
    empty and null texts give no words; other columns are not looked at.
    """
    words = settle(count_words(docs, least_chars=least_chars).where(F.col("n") >= least_count))
    best: Column = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = settle(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best")))
    forms = known.where("best IS NOT NULL").select("word", F.col("best.near").alias("form"))
    return known.join(_roots(forms), "word", "left").select(
        "word", F.col("best.near").alias("form"), F.coalesce("root", "word").alias("root"),
        "n", "n_near", (-F.col("best.less")).alias("form_n"))
