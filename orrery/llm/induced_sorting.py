"""Suffix arrays by induced sorting, and permuted common prefixes, for the strings of one shard.

Suffixes are classified, the substrings between leftmost-smaller suffixes are sorted by induction and named, the string of names is sorted by the same
procedure, and its order induces the whole array in linear time. A string of few symbols is induced bucket by bucket, all suffixes of a bucket at once by
numpy; the much shorter strings of names, which have many symbols, by stretches of the array that don't write into
themselves.
"""

from __future__ import annotations

import numpy as np

#: Symbols up to which a string is induced bucket by bucket: those of bytes, a separator and the end.
FEW = 258
#: Places of the array that are read at once, to begin with.
STRETCH = 256


def classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix, which is the end alone, counts as smaller."""
    n = len(text)
    differs = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    up = np.append(text[differs[:-1]] < text[differs[:-1] + 1], True)
    return np.repeat(up, np.diff(differs, prepend=-1))


def leftmost(smaller: np.ndarray) -> np.ndarray:
    """Places of leftmost smaller suffixes: smaller ones after larger ones."""
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _grouped(symbols: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by symbol, each one's place in its group in that order, and the groups' sizes."""
    order = np.argsort(symbols, kind="stable")
    sizes = np.bincount(symbols, minlength=kinds)
    return order, np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def _induce_buckets(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, kinds: int) -> np.ndarray:
    """The suffix array that sorted leftmost smaller suffixes induce, by whole buckets. Of a bucket, the larger suffixes that it induces within itself (runs of
    one symbol) come in rounds; all that it sends to other buckets are dealt at once, in order."""
    sizes = np.bincount(text, minlength=kinds)
    ends = np.cumsum(sizes)
    heads, out = ends - sizes, np.full(len(text), -1, np.int32)
    order, place, many = _grouped(text[seeds], kinds)
    own = seeds[order]
    seed_at = np.append(0, np.cumsum(many))
    used = np.flatnonzero(sizes)

    def deal(parts: list[np.ndarray], sign: int, at: np.ndarray) -> None:
        if parts and len(found := np.concatenate(parts) if len(parts) > 1 else parts[0]):
            symbols = text[found]
            order, place, many = _grouped(symbols, kinds)
            out[at[symbols[order]] + sign * place] = found[order]
            at += sign * many

    begins = heads.copy()
    for c in used.tolist():
        queue, away = out[begins[c] : heads[c]], []
        while len(queue):
            before = queue[queue > 0] - 1
            before = before[~smaller[before]]
            same = text[before] == c
            away.append(before[~same])
            queue = before[same]
            out[heads[c] : heads[c] + len(queue)] = queue
            heads[c] += len(queue)
        before = own[seed_at[c] : seed_at[c + 1]]
        away.append(before[before > 0] - 1)  # a seed follows a larger suffix of a greater symbol
        deal(away, 1, heads)
    tails = ends - 1
    out[tails[text[-1]]] = len(text) - 1
    tails[text[-1]] -= 1
    for c in used[::-1].tolist():
        queue, away = out[tails[c] + 1 : ends[c]][::-1], []
        while len(queue):
            before = queue[queue > 0] - 1
            before = before[smaller[before]]
            same = text[before] == c
            away.append(before[~same])
            queue = before[same]
            out[tails[c] + 1 - len(queue) : tails[c] + 1] = queue[::-1]
            tails[c] -= len(queue)
        queue = out[begins[c] : heads[c]][::-1]
        before = queue[queue > 0] - 1
        away.append(before[smaller[before]])
        deal(away, -1, tails)
    return out


def _scan(out: np.ndarray, before: np.ndarray, heads: np.ndarray) -> None:
    """Read `out` from its start and put the suffix before each, where before[suffix] is a symbol and not -1, at that symbol's head, which moves on.

    A stretch is read at once up to the first place that it writes to itself; where such stretches are short, as in runs of one symbol, suffixes go one by one.
    """
    n, at, most, differs = len(out), 0, STRETCH, np.empty(16 * STRETCH, bool)
    while at < n:
        items = out[at : at + most]
        symbols = before[items]  # an empty place is -1, which reads the last entry, -1
        source = np.flatnonzero(symbols >= 0)
        if not len(source):
            at += len(items)
            continue
        first = np.minimum.accumulate(heads[symbols[source]]) - at
        free = int(np.count_nonzero(first > source))
        if free < 16 and free < len(source):
            for k in range(at, min(n, at + 256)):
                i = int(out[k])
                c = int(before[i])
                if c >= 0:
                    out[heads[c]] = i - 1
                    heads[c] += 1
            at = min(n, at + 256)
            most = max(STRETCH // 4, most // 2)
            continue
        stop = min(int(first[free - 1]), len(items) if free == len(source) else int(source[free]))
        symbols = symbols[source[:free]]
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        differs[0] = True
        np.not_equal(symbols[1:], symbols[:-1], out=differs[1:free])
        new = np.flatnonzero(differs[:free])
        sizes = np.empty_like(new)
        np.subtract(new[1:], new[:-1], out=sizes[:-1])
        sizes[-1] = free - new[-1]
        to = heads[symbols] + np.arange(free) - np.repeat(new, sizes)
        out[to] = items[source[:free]][order] - 1
        heads[symbols[new]] += sizes
        at += stop
        most = min(2 * most if stop == len(items) else max(STRETCH // 4, 2 * stop), 16 * STRETCH)


def _induce_stretches(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, kinds: int) -> np.ndarray:
    """The same for strings of many symbols, by stretches of the array."""
    sizes = np.bincount(text, minlength=kinds)
    ends = np.cumsum(sizes)
    n, last = len(text), text[:-1].astype(np.int64)
    order, place, many = _grouped(text[seeds], kinds)
    out = np.full(n, -1, np.int32)
    out[np.repeat(ends - many, many) + place] = seeds[order]
    # by suffix, the symbol of the suffix before it, or -1 where that is of the other kind or there is none
    before = np.full(n + 1, -1, np.int64)
    before[1:n] = np.where(smaller[:-1], -1, last)
    _scan(out, before, ends - sizes)
    tails = ends - 1
    out[tails[text[-1]]] = n - 1
    tails[text[-1]] -= 1
    before[1:n] = np.where(smaller[:-1], last, -1)
    _scan(out[::-1], before, n - 1 - tails)
    return out


def _names(text: np.ndarray, places: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Names of the substrings from each leftmost smaller suffix to the next, in their sorted order: equal ones share a name."""
    length = np.zeros(len(text), np.int32)
    length[seeds[:-1]] = np.diff(seeds) + 1
    length[seeds[-1]] = 1
    mine, left = places[1:], places[:-1]
    equal, whole = np.flatnonzero(length[mine] == length[left]), []
    k = 0
    while len(equal):
        on = length[mine[equal]] > k
        whole.append(equal[~on])
        equal = equal[on]
        equal = equal[text[mine[equal] + k] == text[left[equal] + k]]
        k += 1
    same = np.zeros(len(places), bool)
    same[np.concatenate([*whole, equal]) + 1] = True
    return np.cumsum(~same) - 1


def suffix_array(text: np.ndarray, kinds: int) -> np.ndarray:
    """Places of the suffixes of `text` in sorted order. Symbols are 0 to kinds - 1; the last, and only the last, is 0."""
    if len(text) == 1:
        return np.zeros(1, np.int32)
    smaller = classify(text)
    seeds = leftmost(smaller)
    induce = _induce_buckets if kinds <= FEW else _induce_stretches
    is_seed = np.zeros(len(text), bool)
    is_seed[seeds] = True
    found = induce(text, smaller, seeds, kinds)
    places = found[is_seed[found]]
    names = _names(text, places, seeds)
    if names[-1] + 1 < len(names):
        name_of = np.zeros(len(text), np.int32)
        name_of[places] = names
        places = seeds[suffix_array(name_of[seeds], int(names[-1]) + 1)]
    return induce(text, smaller, places, kinds)


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, separator: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the text, in text order, the length that its suffix shares with the suffix before it in the array, and that suffix's place (-1 for the
    first). A separator is equal to nothing, so no prefix passes one.

    Where the symbols before both suffixes are equal, that length is the last place's less one (it is reducible); all others are compared symbol by symbol,
    many places at once.
    """
    n = len(text)
    left = np.full(n, -1, np.int32)
    left[suffixes[1:]] = suffixes[:-1]
    at = np.arange(n, dtype=np.int32)
    reducible = left > 0
    reducible[0] = False
    before = text[at - 1]
    reducible &= (before == text[np.maximum(left, 1) - 1]) & (before > separator)
    own = np.flatnonzero(~reducible).astype(np.int32)
    length, active = np.zeros(n, np.int32), own[left[own] >= 0]
    k = 0
    while len(active):
        symbol = text[active + k]
        active = active[(symbol == text[left[active] + k]) & (symbol > separator)]
        k += 1
        length[active] = k
    last = np.maximum.accumulate(np.where(reducible, 0, at))
    return length[last] - (at - last), left
