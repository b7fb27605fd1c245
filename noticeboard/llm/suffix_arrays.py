"""Suffix arrays of one shard in numpy, by induced sorting, and permuted longest common prefixes.

The steps are those of induced sorting (Nong, Zhang and Chan 2009) and of the permuted LCP array (Kaerkkaeinen, Manzini and Puglisi
2009), each done for whole buckets at a time.
"""

from __future__ import annotations

import numpy as np

from .common import ranges


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S type); the last symbol is the unique smallest."""
    n = len(text)
    rises = np.zeros(n, np.int8)
    rises[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    rises[-1] = 1
    # within a run of equal symbols the symbol after the run decides
    change = np.flatnonzero(rises)
    return (rises[change] > 0)[np.searchsorted(change, np.arange(n))] if len(change) < n else rises > 0


def _packed_order(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, tail: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Order of symbols[start:end] (then of tail), and the names: equal for equal strings."""
    bits = max(1, int(symbols.max()).bit_length())
    per = 63 // bits
    order, name = np.arange(len(start)), np.zeros(len(start), np.int64)
    depth, live = 0, np.arange(len(start))
    while len(live):  # strings that are not told apart yet, a machine word at a time
        word = np.zeros(len(live), np.int64)
        for k in range(per):
            at = start[live] + depth + k
            inside = at < end[live]
            word = (word << bits) | np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], 0)
        by = np.lexsort((word, name[live]))
        live = live[by]
        word, old = word[by], name[live]
        slot = old + np.arange(len(old)) - np.searchsorted(old, old)  # a name is the first place of its strings
        order[slot] = live
        new = np.ones(len(live), bool)
        new[1:] = (word[1:] != word[:-1]) | (old[1:] != old[:-1])
        name[live] = slot[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        depth += per
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(live)]]))
        tied = np.repeat(size > 1, size)
        longest = np.maximum.reduceat(np.where(end[live] > start[live] + depth, 1, 0), np.flatnonzero(new))
        live = live[tied & np.repeat(longest > 0, size)]
    if tail is not None:
        order = np.lexsort((tail, name))
    return order, name


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order.  text: non-negative integers of which the last is the only smallest one."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    typed = text.astype(np.int64) * 2 + small
    if len(lms) < 2:
        sorted_lms = lms
    else:
        ends = np.concatenate([lms[1:] + 1, [n]])
        order, name = _packed_order(typed, lms, ends, None)
        new = np.ones(len(order), bool)
        new[1:] = name[order][1:] != name[order][:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        # equal substrings: their order is that of the suffixes of the string of names
        sorted_lms = lms[order] if new.all() else lms[suffix_array(rank)]
    if int(text.max()) > 4096:  # names of an inner level: too many buckets to go through one by one
        place = np.zeros(n, np.int64)
        place[sorted_lms] = np.arange(len(sorted_lms)) + 1
        following = np.searchsorted(lms, np.arange(n), side="right")  # the next LMS suffix decides what the symbols up to it leave open
        end = np.where(following < len(lms), np.append(lms, n - 1)[following], n - 1)
        return _packed_order(typed, np.arange(n), end + 1, np.where(following < len(lms), place[end], 0))[0]
    return _induced(text, small, sorted_lms)


def _induced(text: np.ndarray, small: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    """All suffixes from the sorted LMS suffixes: L types from the left, then S types from the right, a bucket at a time."""
    n, kinds = len(text), int(text.max()) + 1
    size = np.bincount(text, minlength=kinds)
    head = np.cumsum(size) - size
    tail = head + size
    large_end = head + np.bincount(text[~small], minlength=kinds)
    out = np.full(n, -1, np.int64)
    lms_at = np.searchsorted(text[sorted_lms], np.arange(kinds + 1))

    def deal(found: np.ndarray, free: np.ndarray, step: int) -> None:
        """Puts the suffixes, in order, into the buckets of their first symbols."""
        symbol = text[found]
        by = np.argsort(symbol, kind="stable")
        symbol, found = symbol[by], found[by]
        first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        count = np.diff(np.concatenate([first, [len(symbol)]]))
        offset = np.arange(len(symbol)) - np.repeat(first, count)
        out[np.repeat(free[symbol[first]], count) + step * offset] = found
        free[symbol[first]] += step * count

    free = head.copy()
    for c in range(kinds):
        if not size[c]:
            continue
        done = head[c]
        while done < free[c]:  # large suffixes found so far; more of the same symbol follow from them
            wave = out[done : free[c]]
            done = free[c]
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            if len(before):
                deal(before, free, 1)
        before = sorted_lms[lms_at[c] : lms_at[c + 1]] - 1
        before = before[(before >= 0) & ~small[before]] if len(before) else before
        if len(before):
            deal(before, free, 1)
    free = tail - 1
    for c in range(kinds - 1, -1, -1):
        if not size[c]:
            continue
        done = tail[c] - 1
        while done > free[c]:  # small suffixes, from the right
            wave = out[free[c] + 1 : done + 1][::-1]
            done = free[c]
            before = wave[wave > 0] - 1
            before = before[small[before]]
            if len(before):
                deal(before, free, -1)
        wave = out[head[c] : large_end[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[small[before]]
        if len(before):
            deal(before, free, -1)
    out[0] = n - 1
    return out


def permuted_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """For every position, how far (up to most) its suffix agrees with the one before it in the array.

    Where the symbols before both suffixes agree too, the value is one less than that of the position before; only the others are
    compared.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[array[1:]] = array[:-1]
    at = np.arange(n)
    compare = (phi < 1) | (at == 0)
    inner = np.flatnonzero(~compare)
    compare[inner] = text[inner - 1] != text[phi[inner] - 1]
    todo = np.flatnonzero(compare & (phi >= 0))
    out = np.zeros(n, np.int64)
    step = 8
    while len(todo) and most > 0:  # those that agree so far go on, with longer strides
        depth = out[todo]
        width = int(min(step, most))
        left = np.minimum(todo + depth, n)[:, None] + np.arange(width)
        right = np.minimum(phi[todo] + depth, n)[:, None] + np.arange(width)
        same = (text[np.minimum(left, n - 1)] == text[np.minimum(right, n - 1)]) & (left < n) & (right < n)
        run = np.where(same.all(1), width, same.argmin(1))
        out[todo] += run
        todo = todo[(run == width) & (out[todo] < most)]
        step = min(64, step * 2)
    compared = np.flatnonzero(compare)
    last = compared[np.maximum(np.searchsorted(compared, at, side="right") - 1, 0)]
    return np.maximum(out[last] - (at - last), 0)


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """Where a string of this length starts that also starts somewhere else."""
    array = suffix_array(text)
    common = permuted_prefixes(text, array, 1 << 40)
    with_next = np.zeros(len(text), np.int64)
    with_next[array[:-1]] = common[array[1:]]
    return np.maximum(common, with_next) >= length
