"""Cutting stock over a histogram of piece lengths, by column generation.

Bins hold ``capacity`` ids. A bin that is not full is padded to ``capacity``, unless its
total is a power of two, which costs only itself. The linear program over patterns (how
many pieces of each length share a bin) is solved by the revised simplex method;
an unbounded knapsack prices new patterns. Whole multiples of each pattern are kept, and
what their rounding leaves, fewer pieces than patterns times bin size whatever the
corpus, is packed bin by bin with the fullest subset that still fits.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np

# Stop once the bound says that at most this share of the cost can still be saved.
GAP = 0.0005
MOST_ROUNDS = 1500
MOST_KNAPSACKS = 40
# Patterns taken from one knapsack.
COLUMNS = 25
# Patterns that waste more than this share of a bin are not kept as they are.
WASTE = 0.002

# A pattern: pieces of each length, and how many bins use it.
Pattern = tuple[dict[int, int], int]


def bin_cost(total: int, capacity: int) -> int:
    return total if total and total & (total - 1) == 0 else capacity


def _best_fill(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each exact total the best sum of values, and the length added last.

    ``values[l]`` is the value of a piece of length ``l``.
    """
    best = np.full(capacity + 1, -np.inf)
    last = np.zeros(capacity + 1, np.int64)
    best[0] = 0.0
    for total in range(1, capacity + 1):
        options = best[total - 1 :: -1][:total] + values[1 : total + 1]
        pick = int(np.argmax(options))
        best[total], last[total] = options[pick], pick + 1
    return best, last


def solve(demand: Mapping[int, int], capacity: int) -> list[Pattern]:
    """Patterns that together hold each length exactly as often as asked for."""
    demand = {length: count for length, count in demand.items() if count}
    if not demand:
        return []
    if min(demand) < 1 or max(demand) > capacity:
        raise ValueError(f"lengths lie between 1 and {capacity}")
    lengths = sorted(demand)
    pool = [pattern for pattern, _ in _leftovers(dict(demand), capacity)]
    patterns = _relaxed(lengths, np.array([demand[n] for n in lengths], float), capacity, pool)
    left = dict(demand)
    chosen: list[Pattern] = []
    for pattern, times in sorted(patterns, key=lambda p: (-p[1], sorted(p[0].items()))):
        whole = min(int(times + 1e-9), *(left[n] // k for n, k in pattern.items()))
        total = sum(n * k for n, k in pattern.items())
        if whole and total >= (1 - WASTE) * bin_cost(total, capacity):
            chosen.append((pattern, whole))
            for n, k in pattern.items():
                left[n] -= k * whole
    return chosen + _leftovers(left, capacity)


def _relaxed(
    lengths: list[int], asked: np.ndarray, capacity: int, pool: list[dict[int, int]]
) -> list[tuple[dict[int, int], float]]:
    """The linear program: a basis of patterns and how often each is used.

    Patterns of the ``pool`` are priced first, and the knapsack only when none of them helps.
    """
    size = len(lengths)
    place = {n: i for i, n in enumerate(lengths)}
    copies = np.array([capacity // n for n in lengths], float)
    basis = [{n: capacity // n} for n in lengths]
    cost = np.array([bin_cost(n * (capacity // n), capacity) for n in lengths], float)
    inverse = np.diag(1.0 / copies)
    used = asked / copies
    totals = np.arange(capacity + 1)
    price_of = np.array([bin_cost(int(t), capacity) for t in totals], float)
    # Slightly uneven demands keep the method from going round in circles.
    used = used * (1 + 1e-7 * np.arange(1, size + 1))
    known = _Pool(place)
    known.add([(p, bin_cost(sum(n * k for n, k in p.items()), capacity)) for p in pool])
    knapsacks = 0
    for _ in range(MOST_ROUNDS):
        worth = cost @ inverse
        gains = worth @ known.columns - known.costs
        if gains.max(initial=-1.0) > 1e-6 * capacity:
            j = int(np.argmax(gains))
            if not _enter(inverse, used, basis, cost, known.columns[:, j], known.patterns[j], known.costs[j]):
                break
            continue
        if knapsacks == MOST_KNAPSACKS:
            break
        knapsacks += 1
        values = np.full(capacity + 1, -np.inf)
        values[lengths] = worth
        best, last = _best_fill(values, capacity)
        # Farley's bound: dual values scaled until no pattern is worth more than it costs.
        if np.max(best[1:] / price_of[1:]) <= 1 + GAP:
            break
        gain = best[1:] - price_of[1:]
        tops = [int(t) + 1 for t in np.argsort(-gain)[:COLUMNS] if gain[t] > 1e-6 * capacity]
        known.add([(_pattern(last, total), price_of[total]) for total in tops])
    return list(zip(basis, used.tolist()))


class _Pool:
    """Patterns found so far, as columns."""

    def __init__(self, place: dict[int, int]):
        self.place = place
        self.patterns: list[dict[int, int]] = []
        self.columns = np.zeros((len(place), 0))
        self.costs = np.zeros(0)

    def add(self, priced: list[tuple[dict[int, int], float]]) -> None:
        new = np.zeros((len(self.place), len(priced)))
        for j, (pattern, _) in enumerate(priced):
            for n, k in pattern.items():
                new[self.place[n], j] = k
        self.patterns += [p for p, _ in priced]
        self.columns = np.hstack([self.columns, new])
        self.costs = np.append(self.costs, [float(c) for _, c in priced])


def _pattern(last: np.ndarray, total: int) -> dict[int, int]:
    pattern: dict[int, int] = {}
    while total:
        length = int(last[total])
        pattern[length] = pattern.get(length, 0) + 1
        total -= length
    return pattern


def _enter(inverse, used, basis, cost, column, pattern, price) -> bool:
    """One pivot, in place: ``pattern`` takes the place of the one it first drives to zero."""
    step = inverse @ column
    able = step > 1e-9
    if not able.any():
        return False
    ratios = np.where(able, used / np.where(able, step, 1.0), np.inf)
    out = int(np.argmin(ratios))
    by = ratios[out]
    used -= by * step
    used[out] = by
    np.maximum(used, 0.0, out=used)
    pivot = inverse[out] / step[out]
    inverse -= np.outer(step, pivot)
    inverse[out] = pivot
    basis[out], cost[out] = pattern, price
    return True


def _leftovers(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Bins for the rest: the longest piece, then the subset that fills its bin best."""
    left = {n: k for n, k in left.items() if k}
    bins: dict[tuple, int] = {}
    while left:
        longest = max(left)
        take = {longest: 1}
        _use(left, longest)
        room = capacity - longest
        for n in _fullest(left, room):
            take[n] = take.get(n, 0) + 1
            _use(left, n)
        # The same bin again, as often as the rest allows.
        again = min((left.get(n, 0) // k for n, k in take.items()), default=0)
        for n, k in take.items():
            if again:
                _use(left, n, k * again)
        key = tuple(sorted(take.items()))
        bins[key] = bins.get(key, 0) + 1 + again
    return [(dict(key), times) for key, times in bins.items()]


def _use(left: dict[int, int], length: int, times: int = 1) -> None:
    left[length] -= times
    if not left[length]:
        del left[length]


def _fullest(left: dict[int, int], room: int) -> list[int]:
    """Pieces with the largest total that still fits: subset sums as bits of one integer."""
    lengths = sorted((n for n in left if n <= room), reverse=True)
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        count, bundle = min(left[n], room // n), 1
        while count:
            size = min(bundle, count)
            steps.append((n, size, reach))
            reach |= (reach << (n * size)) & mask
            count -= size
            bundle *= 2
        if reach >> room:
            break
    total = reach.bit_length() - 1
    taken = []
    for n, size, before in reversed(steps):
        if not before >> total & 1:
            taken += [n] * size
            total -= n * size
    return taken


def padding(patterns: list[Pattern], capacity: int) -> int:
    """Ids of padding that these bins need."""
    totals = ((sum(n * k for n, k in p.items()), times) for p, times in patterns)
    return sum((bin_cost(t, capacity) - t) * times for t, times in totals)
