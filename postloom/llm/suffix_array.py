"""Suffix arrays by induced sorting, and common prefixes in text order.

Bytes are sorted in whole-array steps: while a bucket is scanned, all of its suffixes known so far
send their left neighbours on at once, in order, and those that stay in the bucket form the next
step. The reduced text of the recursion has a large alphabet and is sorted item by item.
"""

from __future__ import annotations

import numpy as np

from .flat import Sums, byte_sums


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is larger than the empty one."""
    n = len(text)
    smaller = np.zeros(n, bool)
    if n > 1:
        up = text[1:] > text[:-1]
        # Equal neighbours take the type of the next unequal pair to their right.
        unequal = np.flatnonzero(text[1:] != text[:-1])
        if len(unequal):
            runs = np.diff(unequal, prepend=-1)
            smaller[: unequal[-1] + 1] = np.repeat(up[unequal], runs)
    return smaller


def _leftmost(smaller: np.ndarray) -> np.ndarray:
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _ranks(sorted_keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Position of each item within its run of equal keys."""
    return np.arange(len(sorted_keys)) - (counts.cumsum() - counts)[sorted_keys]


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes in the order that the sorted ``seeds`` (leftmost smaller ones) induce."""
    n = len(text)
    sizes = np.bincount(text, minlength=alphabet)
    end = sizes.cumsum()
    begin = end - sizes
    out = np.full(n, -1, np.int64)
    # Seeds at the ends of their buckets, in order.
    at = np.bincount(text[seeds], minlength=alphabet)
    seed_begin = end - at
    keys = text[seeds]
    turn = np.argsort(keys, kind="stable")
    out[seed_begin[keys[turn]] + _ranks(keys[turn], at)] = seeds[turn]

    head = begin.copy()

    def push_larger(suffixes: np.ndarray) -> None:
        left = suffixes[suffixes > 0] - 1
        left = left[~smaller[left]]
        if len(left):
            keys = text[left]
            order = np.argsort(keys, kind="stable")
            keys, left = keys[order], left[order]
            more = np.bincount(keys, minlength=alphabet)
            out[head[keys] + _ranks(keys, more)] = left
            head[:] += more

    push_larger(np.array([n]))
    used = np.flatnonzero(sizes).tolist()
    for c in used:
        done = begin[c]
        while done < head[c]:
            now, done = out[done : head[c]], int(head[c])
            push_larger(now)
        push_larger(out[seed_begin[c] : end[c]])

    tail = end.copy()

    def push_smaller(suffixes: np.ndarray) -> None:
        """``suffixes`` in descending order."""
        left = suffixes[suffixes > 0] - 1
        left = left[smaller[left]]
        if len(left):
            keys = text[left]
            order = np.argsort(keys, kind="stable")
            keys, left = keys[order], left[order]
            more = np.bincount(keys, minlength=alphabet)
            out[tail[keys] - 1 - _ranks(keys, more)] = left
            tail[:] -= more

    for c in reversed(used):
        done = end[c]
        while done > tail[c]:
            now, done = out[tail[c] : done][::-1], int(tail[c])
            push_smaller(now)
        push_smaller(out[begin[c] : head[c]][::-1])
    return out


def _names(order: np.ndarray, length: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Numbers of sorted substrings, equal ones alike."""
    new = np.ones(len(order), np.int64)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        new[1:] = (length[a] != length[b]) | (key[a] != key[b])
    return new.cumsum() - 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a byte array in ascending order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    smaller = _types(text)
    seeds = _leftmost(smaller)
    if len(seeds) > 1:
        order = _induce(text, smaller, seeds, 256)
        flag = np.zeros(n, bool)
        flag[seeds] = True
        order = order[flag[order]]
        number = np.zeros(n, np.int64)
        number[seeds] = np.arange(len(seeds))
        # Substrings run from one leftmost smaller suffix to the next, both ends included.
        last = np.append(seeds[1:] + 1, n)
        key = byte_sums(text).spans(seeds, last)
        by_rank = number[order]
        length = last - seeds
        length[-1] += n  # the last one reaches the end and equals no other
        name = np.zeros(len(seeds), np.int64)
        name[by_rank] = _names(by_rank, length, key)
        top = int(name.max()) + 1
        if top < len(seeds):
            seeds = seeds[np.array(_sorted_items(name, top), np.int64)]
        else:
            seeds = order
    return _induce(text, smaller, seeds, 256)


def _sorted_items(numbers: np.ndarray, alphabet: int) -> list[int]:
    """Suffix array of an array of numbers below ``alphabet``, by the same method item by item."""
    n = len(numbers)
    if n < 2:
        return list(range(n))
    flags = _types(numbers)
    seeds = _leftmost(flags).tolist()
    ends = np.bincount(numbers, minlength=alphabet).cumsum()
    text, smaller, end = numbers.tolist(), flags.tolist(), ends.tolist()
    begin = [0, *end[:-1]]

    def induce(ordered: list[int]) -> list[int]:
        out, tail = [-1] * n, end.copy()
        for i in reversed(ordered):
            c = text[i]
            tail[c] -= 1
            out[tail[c]] = i
        head = begin.copy()
        c = text[n - 1]
        out[head[c]] = n - 1
        head[c] += 1
        for k in range(n):
            i = out[k] - 1
            if i >= 0 and not smaller[i]:
                c = text[i]
                out[head[c]] = i
                head[c] += 1
        tail = end.copy()
        for k in range(n - 1, -1, -1):
            i = out[k] - 1
            if i >= 0 and smaller[i]:
                c = text[i]
                tail[c] -= 1
                out[tail[c]] = i
        return out

    if len(seeds) > 1:
        nxt = {a: b + 1 for a, b in zip(seeds, seeds[1:], strict=False)}
        nxt[seeds[-1]] = n
        name, top, before = {}, -1, None
        for i in induce(seeds):
            if i in nxt:
                own = text[i : nxt[i]]
                if own != before or i == seeds[-1]:
                    top += 1
                name[i], before = top, None if i == seeds[-1] else own
        if top + 1 < len(seeds):
            seeds = [seeds[k] for k in _sorted_items(np.array([name[i] for i in seeds]), top + 1)]
        else:
            seeds = sorted(seeds, key=name.__getitem__)
    return induce(seeds)


def permuted_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in text order, the one before it in the suffix array (-1: none) and their
    common prefix, counted up to ``most`` bytes; by doubling steps over hashes of spans."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    own = np.flatnonzero(before >= 0)
    other = before[own]
    sums: Sums = byte_sums(text)
    length = np.zeros(len(own), np.int64)
    limit = np.minimum(np.minimum(n - own, n - other), most)
    step = 1 << max(0, most.bit_length() - 1)
    while step:
        trial = length + step
        ok = np.flatnonzero(trial <= limit)
        a, b, t = own[ok], other[ok], trial[ok]
        same = sums.spans(a, a + t) == sums.spans(b, b + t)
        length[ok[same]] = t[same]
        step >>= 1
    prefix = np.zeros(n, np.int64)
    prefix[own] = length
    return before, prefix
