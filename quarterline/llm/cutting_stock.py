"""Cutting stock on one machine: a length histogram in, patterns with whole counts out.

The size of the problem is the number of length classes, whatever the number of documents.
"""

from __future__ import annotations

import warnings
from bisect import bisect_left, insort

import numpy as np


def price_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: class k (size k + 1) is worth values[k].

    Returns the best total and how often each class is taken.
    """
    m = len(values)
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        k = min(room, m)
        gains = values[:k] + best[room - k : room][::-1]
        pick = int(gains.argmax())
        if gains[pick] > best[room - 1] + 1e-12:
            best[room], took[room] = gains[pick], pick + 1
        else:
            best[room] = best[room - 1]
    pattern = np.zeros(m, dtype=np.int64)
    room = capacity
    while room > 0:
        if took[room]:
            pattern[took[room] - 1] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[capacity]), pattern


def crash_basis(demand: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A first basis: full patterns one after another, each used until one of its classes is served.

    No pattern holds a class that was served before, so the columns are triangular and hence independent.
    """
    left = demand.astype(float)
    open_ = np.ones(len(sizes), dtype=bool)
    values = np.zeros(int(sizes[-1]))
    columns, amounts = [], []
    while open_.any():
        values[:] = 0
        # Worth a little more than their size where they are large, so that hard classes go first.
        values[sizes[open_] - 1] = sizes[open_] * (1 + 0.1 * sizes[open_] / capacity)
        column = price_pattern(values, capacity)[1][sizes - 1]
        some = column > 0
        times = float((left[some] / column[some]).min())
        left[some] -= column[some] * times
        served = np.flatnonzero(some & open_ & (left <= 1e-9 * demand))
        for k in served:
            columns.append(column if k == served[0] else np.where(np.arange(len(sizes)) == k, capacity // sizes[k], 0))
            amounts.append(times if k == served[0] else 0.0)
        left[served] = 0
        open_[served] = False
    return columns, np.array(amounts)


def solve_relaxation(demand: np.ndarray, capacity: int, gap: float = 1e-3, stalled: int = 2_000) -> list[tuple[np.ndarray, float]]:
    """Column generation: the least fractional number of bins for demand[k] items of size k + 1.

    A revised simplex keeps the inverse of the basis; the knapsack program prices the next column.
    It ends when the dual bound or the total size proves that no solution is smaller by more than gap. Should the number of
    bins not fall over so many pivots in a row (stalled), it ends with a warning of what is not proven.
    """
    classes = np.flatnonzero(demand)
    sizes = classes + 1
    m = len(classes)
    if not m:
        return []
    total = float((demand[classes] * sizes).sum()) / capacity
    columns, amounts = crash_basis(demand[classes], sizes, capacity)
    inverse = np.linalg.inv(np.array(columns, dtype=float).T)
    values = np.zeros(int(sizes[-1]))
    since, least = 0, np.inf
    while True:
        since, least = (0, amounts.sum()) if amounts.sum() < least - 1e-9 else (since + 1, least)
        if amounts.sum() <= total * (1 + gap):
            break
        duals = np.maximum(inverse.sum(axis=0), 0)
        values[:] = 0
        values[classes] = duals
        worth, pattern = price_pattern(values, capacity)
        if worth <= 1 + gap:
            break
        if since >= stalled:
            warnings.warn(f"{least:.1f} bins stand against a bound of {max(total, least / worth):.1f}", stacklevel=2)
            break
        column = pattern[classes]
        step = inverse @ column
        up = step > 1e-9
        if not up.any():
            break
        ratios = np.where(up, amounts / np.where(up, step, 1), np.inf)
        out = int(ratios.argmin())
        theta = max(ratios[out], 0.0)
        amounts = np.maximum(amounts - theta * step, 0)
        amounts[out] = theta
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[out] = column
    full = []
    for column, amount in zip(columns, amounts):
        if amount > 1e-9:
            pattern = np.zeros(len(demand), dtype=np.int64)
            pattern[classes] = column
            full.append((pattern, float(amount)))
    return full


def best_fit(left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Best-fit decreasing for the few items that rounding down leaves."""
    rooms: list[tuple[int, int]] = []
    bins: list[np.ndarray] = []
    for k in range(len(left) - 1, -1, -1):
        for _ in range(int(left[k])):
            at = bisect_left(rooms, (k + 1, -1))
            if at < len(rooms):
                room, b = rooms.pop(at)
            else:
                room, b = capacity, len(bins)
                bins.append(np.zeros(len(left), dtype=np.int64))
            bins[b][k] += 1
            if room > k + 1:
                insort(rooms, (room - k - 1, b))
    return bins


def patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns that hold demand[k] items of size k + 1, and perhaps a few more places than items."""
    left = demand.astype(np.int64).copy()
    chosen: list[tuple[np.ndarray, int]] = []
    for pattern, amount in solve_relaxation(left, capacity):
        times = int(amount + 1e-6)
        if times:
            chosen.append((pattern, times))
    for pattern, times in chosen:
        left -= pattern * times
    left = np.maximum(left, 0)
    chosen += [(pattern, 1) for pattern in best_fit(left, capacity)]
    return chosen
