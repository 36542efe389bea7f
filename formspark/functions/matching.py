"""Matching-block similarity of many pairs at once.

The longest common block of two texts is found by the lengths of common suffixes, one row of the table at a time, for all
pairs of a batch together; what lies before and after it is searched the same way in the next round.
"""

from __future__ import annotations

import numpy as np

#: Places of the table's rows that are worked on at once.
CELLS = 1 << 20
#: From so many characters on, characters that make up more than a hundredth of the second text don't begin a block.
LONG = 200


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _longest(a: np.ndarray, a_at: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_n: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of stretches the longest block without common characters of b: length and the two offsets. Of equal ones
    that which begins first in a, and of these that which does in b."""
    k, m = len(a_at), int(b_n.max())
    cell = np.minimum(b_at[:, None] + np.arange(m), len(b) - 1)
    inside = np.arange(m) < b_n[:, None]
    right = np.where(inside & ~common[cell], b[cell], -1)
    run = np.zeros((k, m + 1), np.int32)
    best, i_end, j_end, rows = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.arange(k)
    for i in range(int(a_n.max())):
        left = np.where(i < a_n, a[np.minimum(a_at + i, len(a) - 1)], -2)
        run[:, 1:] = np.where(right == left[:, None], run[:, :-1] + 1, 0)
        j = run[:, 1:].argmax(axis=1)
        now = run[rows, j + 1]
        more = now > best
        best[more], i_end[more], j_end[more] = now[more], i + 1, j[more] + 1
    return best, np.where(best > 0, i_end - best, 0), np.where(best > 0, j_end - best, 0)


def matched(first: list[str], second: list[str]) -> np.ndarray:
    """How many characters of each pair lie in matching blocks."""
    a, b = _codes(first), _codes(second)
    a_n, b_n = (np.array([len(x) for x in own], np.int64) for own in (first, second))
    a_at, b_at = np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n
    pair = np.repeat(np.arange(len(second)), b_n)
    common = np.zeros(len(b), bool)
    if (b_n >= LONG).any():
        _, kind, times = np.unique(pair << 32 | b, return_inverse=True, return_counts=True)
        common = (b_n >= LONG)[pair] & (times[kind] > (b_n // 100 + 1)[pair])
    total = np.zeros(len(first), np.int64)
    todo = np.array([np.arange(len(first)), a_at, a_n, b_at, b_n])
    while (todo := todo[:, (todo[2] > 0) & (todo[4] > 0)]).shape[1]:
        todo = todo[:, np.argsort(todo[4], kind="stable")]
        later, lo = [], 0
        while lo < todo.shape[1]:
            hi = lo + 1
            while hi < todo.shape[1] and (hi - lo + 1) * todo[4, hi] <= CELLS and todo[4, hi] <= 2 * todo[4, lo] + 8:
                hi += 1
            own, i0, n, j0, m = todo[:, lo:hi]
            size, i, j = _longest(a, i0, n, b, j0, m, common)
            if len(common) and common.any():  # common characters lengthen a block, or are one at the start
                grown = (b_n >= LONG)[own]
                while (back := grown & (i > 0) & (j > 0)).any() and (back := back & (a[np.maximum(i0 + i - 1, 0)] == b[np.maximum(j0 + j - 1, 0)])).any():
                    i, j, size = i - back, j - back, size + back
                while (on := grown & (i + size < n) & (j + size < m)).any() and (on := on & (a[np.minimum(i0 + i + size, len(a) - 1)] == b[np.minimum(j0 + j + size, len(b) - 1)])).any():
                    size = size + on
            hit = size > 0
            np.add.at(total, own[hit], size[hit])
            own, i0, n, j0, m, size, i, j = (x[hit] for x in (own, i0, n, j0, m, size, i, j))
            later += [np.array([own, i0, i, j0, j]), np.array([own, i0 + i + size, n - i - size, j0 + j + size, m - j - size])]
            lo = hi
        todo = np.concatenate(later, axis=1)
    return total


def ratios(first: list[str], second: list[str]) -> np.ndarray:
    """Twice the matched characters over all characters; 1 for two empty texts."""
    size = np.array([len(x) + len(y) for x, y in zip(first, second)], np.int64)
    different = {}  # equal pairs are compared once
    which = np.array([different.setdefault(p, len(different)) for p in zip(first, second)], np.int64)
    found = matched([x for x, _ in different], [y for _, y in different])[which] if different else np.zeros(0, np.int64)
    return np.where(size > 0, 2.0 * found / np.maximum(size, 1), 1.0)
