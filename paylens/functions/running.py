"""Exact order statistics of all values so far, for many rows at once.

Values of a group come in order; what was before them is given as sorted values with counts. A wavelet matrix over the ranks of all
values answers, for each of many (group, number of values so far) at once, how many are below a value or which is the
k-th: each of its levels halves the ranks that are left, and costs a few array operations for all questions together.
"""

from __future__ import annotations

import numpy as np


class PrefixOrder:
    """Values of groups 0, 1, ...; groups don't fall, and a weight of -1 takes a value out again."""

    def __init__(self, group: np.ndarray, value: np.ndarray, weight: np.ndarray, old_group: np.ndarray, old_value: np.ndarray, old_count: np.ndarray, groups: int):
        groups_of, values = np.concatenate([old_group, group]), np.concatenate([old_value, value])
        order = np.lexsort((values, groups_of))
        g, v = groups_of[order], values[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
        codes = np.empty(len(order), np.int64)
        codes[order] = np.cumsum(fresh) - 1
        self.values, owner = v[fresh], g[fresh]
        self.first_code, self.last_code = (np.searchsorted(owner, np.arange(groups), side=s) for s in ("left", "right"))
        self.start = np.searchsorted(group, np.arange(groups))
        self.before = np.zeros(len(self.values) + 1, np.int64)
        np.add.at(self.before, codes[: len(old_group)] + 1, old_count)
        self.before = np.cumsum(self.before)
        self.total = np.concatenate([[0], np.cumsum(weight)])
        self.bits = max(int(len(self.values) - 1).bit_length(), 1)
        self.levels = []
        code, w = codes[len(old_group) :], weight.astype(np.int64)
        for bit in range(self.bits - 1, -1, -1):
            zero = (code >> bit & 1) == 0
            self.levels.append((np.concatenate([[0], np.cumsum(zero)]), np.concatenate([[0], np.cumsum(np.where(zero, w, 0))]), int(zero.sum())))
            code, w = np.concatenate([code[zero], code[~zero]]), np.concatenate([w[zero], w[~zero]])

    def _old(self, group: np.ndarray, code: np.ndarray, width: int) -> np.ndarray:
        """How many given values of the group have one of so many codes from code on."""
        low, high = self.first_code[group], self.last_code[group]
        return self.before[np.clip(code + width, low, high)] - self.before[np.clip(code, low, high)]

    def count(self, group: np.ndarray, n: np.ndarray) -> np.ndarray:
        start = self.start[group]
        return self.total[start + n] - self.total[start] + self.before[self.last_code[group]] - self.before[self.first_code[group]]

    def kth(self, group: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with k others before it (from 0) among the first n of its group; k must be below their count."""
        low = self.start[group]
        high, code, k = low + n, np.zeros(len(group), np.int64), k.copy()
        for level, (zeros, weights, n_zero) in enumerate(self.levels):
            width = 1 << self.bits - 1 - level
            here = weights[high] - weights[low] + self._old(group, code, width)
            right = k >= here
            k -= np.where(right, here, 0)
            low, high = np.where(right, n_zero + low - zeros[low], zeros[low]), np.where(right, n_zero + high - zeros[high], zeros[high])
            code += right * width
        return self.values[np.minimum(code, len(self.values) - 1)] if len(self.values) else np.zeros(len(group))

    def below(self, group: np.ndarray, n: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the first n of the group are less than the value."""
        low, high = self.first_code[group].copy(), self.last_code[group].copy()
        while (low < high).any():  # the first code of the group whose value isn't less
            middle = np.minimum((low + high) // 2, len(self.values) - 1)
            less = (low < high) & (self.values[middle] < value)
            low, high = np.where(less, middle + 1, low), np.where((low < high) & ~less, middle, high)
        target, out = low, self.before[low] - self.before[self.first_code[group]]
        low = self.start[group]
        high = low + n
        for level, (zeros, weights, n_zero) in enumerate(self.levels):
            right = (target >> self.bits - 1 - level & 1) == 1
            out = out + np.where(right, weights[high] - weights[low], 0)
            low, high = np.where(right, n_zero + low - zeros[low], zeros[low]), np.where(right, n_zero + high - zeros[high], zeros[high])
        return np.where(target >> self.bits > 0, self.count(group, n), out)

    def median(self, group: np.ndarray, n: np.ndarray) -> np.ndarray:
        """NaN of none."""
        size = self.count(group, n)
        some = size > 0
        low, high = self.kth(group, n, np.where(some, (size - 1) // 2, 0)), self.kth(group, n, np.where(some, size // 2, 0))
        return np.where(some, (low + high) / 2, np.nan)

    def deviation(self, group: np.ndarray, n: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """The median distance from middle, 0 of none: distances on both sides are sorted, so halves are found by bisection."""
        size = self.count(group, n)
        some = size > 0
        middle = np.where(some, middle, 0.0)
        left = self.below(group, n, middle)
        right, take = size - left, (size - 1) // 2 + 1
        inside = lambda i: np.clip(i, 0, np.maximum(size - 1, 0))
        down = lambda i: middle - self.kth(group, n, inside(left - 1 - i))
        up = lambda i: self.kth(group, n, inside(left + i)) - middle
        low, high = np.maximum(0, take - right), np.minimum(take, left)
        while (low < high).any():
            i = (low + high) // 2
            more = (low < high) & (down(i) < up(take - i - 1))
            low, high = np.where(more, i + 1, low), np.where((low < high) & ~more, i, high)
        rest = take - low
        last = np.maximum(np.where(low > 0, down(low - 1), -np.inf), np.where(rest > 0, up(rest - 1), -np.inf))
        after = np.minimum(np.where(low < left, down(low), np.inf), np.where(rest < right, up(rest), np.inf))
        return np.where(some, np.where(size % 2 == 1, last, (last + np.where(size % 2 == 1, 0, after)) / 2), 0.0)


def earlier_in_group(group: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """How many marked rows of its group stand before each row; groups stand together."""
    before = np.concatenate([[0], np.cumsum(marked)])[:-1]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return before - np.repeat(before[first], np.diff(np.append(first, len(group)))) if len(group) else before


def running_most(group: np.ndarray, value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The largest value of the group's rows before each row, or its start; values and starts are 0 or more."""
    if not len(group):
        return value
    step = int(max(value.max(), start.max())) + 1
    first = np.diff(group, prepend=-1) != 0
    shifted = np.where(first, start[group], np.concatenate([[0], value[:-1]]))
    return np.maximum.accumulate(shifted + group * step) - group * step
