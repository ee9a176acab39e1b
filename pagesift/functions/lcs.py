"""Longest common subsequence of two token lists, bit-parallel.

Python ints serve as bit vectors over the positions of ``x``: after reading
``y[:j]``, bit ``i`` of ``v`` is 0 exactly where the LCS of ``x[:i+1]`` and
``y[:j]`` is one longer than that of ``x[:i]``.  One pass over ``y`` costs
O(len(y) * len(x) / 64) word operations instead of the quadratic table.
"""

from __future__ import annotations

import math


def _match_masks(x):
    positions: dict = {}
    for i, tok in enumerate(x):
        positions.setdefault(tok, []).append(i)
    return {tok: _bits(idx, len(x)) for tok, idx in positions.items()}


def _bits(positions: list[int], n: int) -> int:
    """The int with these bits set; many of them are set in bytes, as every sum
    of ints writes all of its words anew."""
    if len(positions) < 16:
        return sum(1 << i for i in positions)
    out = bytearray(n // 8 + 1)
    for i in positions:
        out[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(out, "little")


def _advance(v: int, mask: int, full: int) -> int:
    """The column after one more token of ``y`` that ``mask`` places in ``x``."""
    u = v & mask
    return ((v + u) | (v - u)) & full


def lcs_length(x, y) -> int:
    """Length of the longest common subsequence of sequences ``x`` and ``y``."""
    # equal ends belong to some longest one; tokens of one side only to none
    least, start = min(len(x), len(y)), 0
    while start < least and x[start] == y[start]:
        start += 1
    end = 0
    while end < least - start and x[-1 - end] == y[-1 - end]:
        end += 1
    x, y = x[start:len(x) - end], y[start:len(y) - end]
    seen = set(y)
    x = [tok for tok in x if tok in seen]
    full = v = (1 << len(x)) - 1
    masks = _match_masks(x)
    for tok in y:
        if m := masks.get(tok):
            v = _advance(v, m, full)
    return start + end + len(x) - v.bit_count()


class _Columns:
    """The column after each token of ``y``, from about sqrt(len(y)) stored
    ones; the stretch of columns in use, and the one before, are recomputed
    from the stored column they begin at."""

    def __init__(self, x, y):
        self.y, self.masks = y, _match_masks(x)
        self.full = v = (1 << len(x)) - 1
        self.step = math.isqrt(len(y)) + 1
        self.stored = [v]
        for j, tok in enumerate(y, 1):
            if m := self.masks.get(tok):
                v = _advance(v, m, self.full)
            if j % self.step == 0:
                self.stored.append(v)
        self.stretches: dict[int, list[int]] = {}

    def __getitem__(self, j: int) -> int:
        k, at = divmod(j, self.step)
        if k not in self.stretches:
            v = self.stored[k]
            cols = [v]
            for tok in self.y[k * self.step:(k + 1) * self.step - 1]:
                if m := self.masks.get(tok):
                    v = _advance(v, m, self.full)
                cols.append(v)
            self.stretches = {i: c for i, c in self.stretches.items() if i == k + 1} | {k: cols}
        return self.stretches[k][at]


def lcs_flags(x, y) -> list[bool]:
    """Which positions of ``x`` belong to the LCS found by walking back from
    the end: a match is taken when the tokens agree, otherwise the walk
    moves along ``y`` while that keeps the LCS length, else along ``x``.
    An empty ``y`` marks nothing."""
    m, n = len(x), len(y)
    flags = [False] * m
    if m == 0 or n == 0:
        return flags
    cols = _Columns(x, y)

    def c(i, j):  # LCS length of x[:i] and y[:j]
        return i - (cols[j] & ((1 << i) - 1)).bit_count()

    i, j = m, n
    while i > 0 and j > 0:
        if x[i - 1] == y[j - 1]:
            flags[i - 1] = True
            i -= 1
            j -= 1
        elif c(i, j - 1) >= c(i - 1, j):
            j -= 1
        else:
            i -= 1
    return flags
