"""One-dimensional cutting stock by column generation, on a histogram.

The histogram has one row per length class, so all of this is bounded by the number
of classes and not by the documents behind it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

Pattern = tuple[tuple[int, int], ...]  # (class, pieces of that class), by class


def price(duals: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """Unbounded knapsack by dynamic programming: the most valuable multiset of classes (a class's size is
    its number, ``duals[c]`` its value) within ``capacity``."""
    values = np.full(capacity + 1, -np.inf)
    values[1:len(duals)] = duals[1:]
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        options = best[c - 1::-1] + values[1:c + 1]
        k = int(options.argmax())
        if options[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = options[k], k + 1
        else:
            best[c] = best[c - 1]
    chosen, c = [], capacity
    while c > 0:
        if pick[c]:
            chosen.append(int(pick[c]))
            c -= int(pick[c])
        else:
            c -= 1
    return float(best[capacity]), chosen


def solve(demand: dict[int, int], capacity: int, max_rounds: int = 20_000) -> dict[Pattern, float]:
    """The linear program: fewest sequences (fractions allowed) whose patterns cover the demand of every class.

    Revised simplex; a round prices one new pattern with ``price``. Stopping early still leaves a
    cover, only not the best one.
    """
    classes = sorted(c for c, n in demand.items() if n > 0)
    if not classes:
        return {}
    row = {c: i for i, c in enumerate(classes)}
    m = len(classes)
    need = np.array([demand[c] for c in classes], dtype=float)
    # A small growing term breaks the ties on which the simplex method could cycle.
    need_moved = need * (1 + 1e-9 * np.arange(1, m + 1)) + 1e-7 * np.arange(1, m + 1) / m
    basis: list[Pattern | None] = [((c, capacity // c),) for c in classes]
    cost = np.ones(m)
    inverse = np.diag([1.0 / (capacity // c) for c in classes])
    values = inverse @ need_moved
    for _ in range(max_rounds):
        duals_row = cost @ inverse
        low = int(duals_row.argmin())
        if duals_row[low] < -1e-9:  # more than the demand of this class is cheaper than exactly it
            column, pattern, c_in = np.zeros(m), None, 0.0
            column[low] = -1.0
        else:
            duals = np.zeros(classes[-1] + 1)
            duals[classes] = duals_row
            worth, chosen = price(duals, capacity)
            if worth <= 1 + 1e-7:
                break
            counted = Counter(x for x in chosen if duals[x] > 0)
            pattern = tuple(sorted(counted.items()))
            column, c_in = np.zeros(m), 1.0
            for c, k in pattern:
                column[row[c]] = k
        direction = inverse @ column
        able = direction > 1e-9
        if not able.any():
            break
        ratio = np.where(able, values / np.where(able, direction, 1.0), np.inf)
        out = int(ratio.argmin())
        step = max(ratio[out], 0.0)
        values = values - step * direction
        values[out] = step
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        basis[out], cost[out] = pattern, c_in
    found: dict[Pattern, float] = {}
    for p, x in zip(basis, values):
        if p is not None and x > 1e-6:
            found[p] = found.get(p, 0.0) + float(x)
    return found


def best_fit(pieces: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing for the few pieces that rounding leaves."""
    bins: list[list[int]] = []
    room: list[int] = []
    for p in sorted(pieces, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= p]
        if fits:
            r, i = min(fits)
            bins[i].append(p)
            room[i] = r - p
        else:
            bins.append([p])
            room.append(capacity - p)
    return bins


def plan(demand: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Whole patterns with their number of sequences; together they hold exactly the demand."""
    left = {c: int(n) for c, n in demand.items() if n > 0}
    out: Counter[Pattern] = Counter()

    def use(pattern: Pattern, times: int) -> None:
        times = min([times, *(left[c] // k for c, k in pattern)])
        if times > 0:
            out[pattern] += times
            for c, k in pattern:
                left[c] -= k * times

    fractions = solve(left, capacity)
    for pattern, x in sorted(fractions.items()):
        use(pattern, int(x + 1e-6))
    for pattern, x in sorted(fractions.items(), key=lambda e: (-(e[1] % 1), e[0])):
        use(pattern, 1)
    for bin_ in best_fit([c for c, n in left.items() for _ in range(n)], capacity):
        out[tuple(sorted(Counter(bin_).items()))] += 1
    return sorted(out.items())
