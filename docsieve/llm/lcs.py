"""Longest common subsequences."""

from __future__ import annotations

import numpy as np

#: Most bits of table rows that are held at a time; larger problems are halved first.
TABLE_BITS = 200_000_000


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places in ``a`` and ``b`` of a longest common subsequence (bit-parallel, so many equal values cost no more)."""
    head, most = 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    start = [(i, i) for i in range(head)]
    end = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    # values that only one side has can't take part
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    x = [i for i in range(head, len(a) - tail) if a[i] in both]
    y = [j for j in range(head, len(b) - tail) if b[j] in both]
    return start + [(x[i], y[j]) for i, j in _solve([a[i] for i in x], [b[j] for j in y])] + end


def _solve(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    if len(a) * len(b) <= TABLE_BITS or len(a) < 2:
        return _table(a, b)
    half = len(a) // 2
    left, right = _prefix_lengths(a[:half], b), _prefix_lengths(a[half:][::-1], b[::-1])[::-1]
    cut = int(np.argmax(left + right))
    return _solve(a[:half], b[:cut]) + [(half + i, cut + j) for i, j in _solve(a[half:], b[cut:])]


def _rows(a: list[int], b: list[int]):
    """For each prefix of ``a`` a number whose zero bits tell where the LCS with the prefixes of ``b`` grows."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the LCS of ``a`` with each prefix of ``b``, the empty one first."""
    v = 0
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _table(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    rows = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not rows[i - 1] >> (j - 1) & 1:
            continue
        j -= 1
        out.append((i, j))
    return out[::-1]
