"""Suffix arrays by two-stage sorting, with numpy.

Only the suffixes smaller than their successors are sorted directly, by
doubling over the stretches between them. The others are induced by scanning
the buckets of first symbols: whoever precedes an entry and is larger than it
comes next in its own bucket. Common prefixes of neighbours follow from the
irreducible ones, which are compared word by word.
"""

from __future__ import annotations

import numpy as np

#: Symbols: 0 separates segments, a byte b is b + 1, 255 stands behind the end of a stretch.
SEPARATOR, BEHIND = 0, 255


def join(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of UTF-8 segments, each with a separator behind it, and where each begins."""
    sizes = np.array([len(s) + 1 for s in segments], np.int64)
    symbols = np.frombuffer(b"".join([s + b"\xff" for s in segments]), np.uint8) + np.uint8(1)
    return symbols, np.cumsum(sizes) - sizes


def _words(symbols: np.ndarray) -> np.ndarray:
    """The eight symbols from each position as one number; zeros behind the end."""
    padded = np.concatenate([symbols, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.as_strided(padded, (len(symbols) + 1, 8), (1, 1))
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def _rank(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Rank of each item: the place in ``order`` where its group begins; ``new`` marks those."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return out


def _names(symbols: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks of the stretches from each position up to and with the next one.

    Where one stretch begins another, the shorter is the larger one, as the
    suffix at its end is larger than its own successor's bucket fellows; so it
    is read with ``BEHIND`` after its end. Separators are all different.
    """
    size = np.diff(at, append=at[-1] + 1) + 1
    size[-1] = 1
    rank, depth = np.zeros(len(at), np.int64), 0
    todo = np.arange(len(at))
    while len(todo):
        word = words[np.minimum(at[todo] + depth, len(symbols))]
        left = np.clip(size[todo] - depth, 0, 8).astype(np.uint64)
        word |= np.where(left < 8, ~np.uint64(0) >> (left * np.uint64(8)) % np.uint64(64), np.uint64(0))
        word = np.where(left == 0, ~np.uint64(0), word)
        order = np.lexsort((word, rank[todo])) if depth else np.argsort(word)
        r, w = rank[todo][order], word[order]
        fresh = np.r_[True, (r[1:] != r[:-1])]
        new = fresh | np.r_[True, w[1:] != w[:-1]]
        rank[todo[order]] = _regroup(r, new, fresh)
        depth += 8
        todo = todo[size[todo] > depth]
        if len(todo):  # only those that share their rank with another go on
            shared = np.bincount(rank, minlength=len(rank) + 1)[rank[todo]] > 1
            todo = todo[shared]
            if len(todo):
                # All of a group go on together, also those that have ended.
                going = np.zeros(len(rank) + 1, bool)
                going[rank[todo]] = True
                todo = np.flatnonzero(going[rank])
    apart = symbols[at] == SEPARATOR
    rank += int(apart.sum())
    rank[apart] = np.arange(int(apart.sum()))
    return rank


def _regroup(rank: np.ndarray, new: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Ranks in sorted order, when groups (begun at ``fresh``) fall apart at ``new``."""
    place = np.arange(len(rank))
    group = np.maximum.accumulate(np.where(fresh, place, 0))
    part = np.maximum.accumulate(np.where(new, place, 0))
    return rank + (part - group)


def _doubled(rank: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of ranks, the last of which occurs once."""
    n = len(rank)
    order = np.argsort(rank)
    sorted_ = rank[order]
    rank = _rank(order, np.r_[True, sorted_[1:] != sorted_[:-1]])
    step = 1
    while True:
        r = rank[order]
        same = np.r_[r[1:] == r[:-1], False]
        tied = np.flatnonzero(same | np.r_[False, same[:-1]])
        if not len(tied):
            return order
        own = order[tied]
        key = rank[own] * (n + 1) + np.where(own + step < n, rank[np.minimum(own + step, n - 1)] + 1, 0)
        by = np.argsort(key)
        order[tied] = own[by]
        key = key[by]
        first = rank[own[by]]
        fresh = np.r_[True, first[1:] != first[:-1]]
        rank[order[tied]] = _regroup(first, np.r_[True, key[1:] != key[:-1]], fresh)
        step *= 2


def suffix_array(symbols: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of symbols that end with a separator; separators order by place."""
    n = len(symbols)
    change = np.flatnonzero(symbols[1:] != symbols[:-1])
    follows = np.searchsorted(change, np.arange(n - 1))
    smaller = np.ones(n, bool)  # than its successor; separators are
    inner = follows < len(change)
    place = change[np.minimum(follows, max(0, len(change) - 1))] if len(change) else np.zeros(n - 1, int)
    smaller[:-1] = np.where(inner, symbols[place] < symbols[np.minimum(place + 1, n - 1)], True)
    direct = np.flatnonzero(smaller)
    direct = direct[_doubled(_names(symbols, words, direct))]
    heads = symbols[direct]
    begin = np.searchsorted(heads, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        parts = induced[c]
        now = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        bucket = []
        while len(now):  # runs of one symbol
            bucket.append(now)
            before = now[now > 0] - 1
            now = before[symbols[before] == c]
        bucket.append(direct[begin[c]:begin[c + 1]])
        whole = np.concatenate(bucket)
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        first = symbols[before]
        larger = first > c
        before, first = before[larger], first[larger]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])[:len(first)]
        for head, part in zip(first[cuts], np.split(before, cuts[1:]), strict=False):
            induced[head].append(part)
    return np.concatenate(out)


def common_prefixes(
    symbols: np.ndarray, words: np.ndarray, suffixes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """By position: length shared with the suffix next below, and where that one is (-1: none)."""
    n = len(symbols)
    below = np.full(n, -1, np.int64)
    below[suffixes[1:]] = suffixes[:-1]
    ends = np.flatnonzero(symbols == SEPARATOR)
    room = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    at = np.arange(n)
    before = np.where((at > 0) & (below > 0), symbols[np.maximum(below, 1) - 1], SEPARATOR)
    own = np.r_[np.uint8(SEPARATOR), symbols[:-1]]
    alone = (before != own) | (own == SEPARATOR) | (below < 0)
    here = np.flatnonzero(alone)
    shared = np.zeros(n, np.int64)
    live = here[below[here] >= 0]
    cap = np.minimum(room[live], room[below[live]])
    reach = np.zeros(len(live), np.int64)
    going = np.arange(len(live))
    while len(going):
        p, q = live[going] + reach[going], below[live[going]] + reach[going]
        differ = words[p] ^ words[q]
        # The highest bit that differs; the bits behind it are thinned out, as they would round up.
        top = np.frexp((differ & ~(differ >> np.uint64(1))).astype(np.float64))[1]
        same = (64 - top) // 8
        reach[going] += same
        going = going[(same == 8) & (reach[going] < cap[going])]
    shared[live] = np.minimum(reach, cap)
    last = np.maximum.accumulate(np.where(alone, at, -1))
    return np.maximum(shared[last] - (at - last), 0), below


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment (UTF-8) the starts of ``length`` bytes that also start elsewhere in them."""
    if not segments:
        return []
    symbols, begin = join(segments)
    words = _words(symbols)
    shared, below = common_prefixes(symbols, words, suffix_array(symbols, words))
    long = np.flatnonzero(shared >= length)
    hit = np.zeros(len(symbols), bool)
    hit[long] = True
    hit[below[long]] = True
    return [np.flatnonzero(hit[a:a + len(s)]) for a, s in zip(begin.tolist(), segments, strict=True)]
