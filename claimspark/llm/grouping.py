"""Plans of sequences from a histogram of lengths, by linear grouping.

The plan depends on how many items there are of each length, not on the items: it
is made on the driver from at most ``capacity`` counts, and its size is bounded by
the capacity and the number of groups, however many items there are.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, int]], float]:
    """Configurations of few sizes and how often to use each (rounded down), by column generation, and the gap.

    Solves the linear relaxation of the cutting-stock problem: a basis of
    configurations, prices from it, and a knapsack that finds a configuration worth
    more than one sequence at these prices, until there is none. The gap is how many
    sequences the relaxation may still be above its least: 0, unless as many rounds in a row
    as there are pairs of sizes bring nothing (the basis is going round in circles then).
    """
    kinds = len(sizes)
    if not kinds:
        return [], 0.0
    basis = np.diag(capacity // sizes).astype(float)
    most = int(capacity // sizes.min())
    amounts = demand / np.diag(basis)
    idle, gap = 0, 0.0
    while True:
        prices = np.linalg.solve(basis.T, np.ones(kinds))
        worth = np.zeros(capacity + 1)
        taken: list[np.ndarray] = []
        for _ in range(most):  # one more item in each round
            better, chosen = worth.copy(), np.full(capacity + 1, -1)
            for kind in np.flatnonzero(prices > 0):
                size = int(sizes[kind])
                value = worth[: capacity + 1 - size] + prices[kind]
                gain = value > better[size:] + 1e-12
                better[size:][gain] = value[gain]
                chosen[size:][gain] = kind
            taken.append(chosen)
            worth = better
        if worth[capacity] <= 1 + 1e-7:
            break
        if idle > kinds * kinds:
            gap = float(amounts.sum() * (1 - 1 / worth[capacity]))
            break
        column, left = np.zeros(kinds), capacity
        for chosen in reversed(taken):
            if (kind := chosen[left]) >= 0:
                column[kind] += 1
                left -= int(sizes[kind])
        change = np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, amounts / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(ratio.argmin())
        step = ratio[leaves]
        idle = idle + 1 if step * (worth[capacity] - 1) <= 1e-9 * amounts.sum() else 0
        amounts = np.maximum(amounts - step * change, 0)
        amounts[leaves] = step
        basis[:, leaves] = column
    return [(basis[:, j].astype(int), int(amounts[j] + 1e-7)) for j in range(kinds) if amounts[j] + 1e-7 >= 1], gap


class Plan:
    """Placements by length and rank among the items of that length.

    Each row of ``rows`` is (length, first rank, count, first sequence, offset, items
    in each sequence): item ``rank`` goes to sequence ``first + (rank - first rank) //
    each``, at ``offset + length * ((rank - first rank) % each)``.
    """

    def __init__(self, counts: dict[int, int], capacity: int, groups: int = 96, small: int = 3) -> None:
        self.capacity, self.rows, self.sequences, self.gap = capacity, [], 0, 0.0
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.used: dict[int, int] = defaultdict(int)
        left = {length: n for length, n in counts.items() if n}
        if any(not 0 < length <= capacity for length in left):
            raise ValueError("an item is empty or longer than a sequence")
        large = [length for length in sorted(left, reverse=True) if capacity // small < length < capacity]
        if large:
            self._configure(np.array(large), np.array([left[length] for length in large]), left, groups)
        for length in sorted(left, reverse=True):
            self._best_fit(length, left[length])

    def _put(self, length: int, count: int, sequence: int, offset: int, each: int = 1) -> None:
        self.rows.append((length, self.used[length], count, sequence, offset, each))
        self.used[length] += count

    def _configure(self, lengths: np.ndarray, numbers: np.ndarray, left: dict[int, int], groups: int) -> None:
        """Groups of equal cardinality, rounded up to their largest, are configured and replaced by the items."""
        ends = np.cumsum(numbers)
        total = int(ends[-1])
        cardinality = -(-total // groups)
        begins = np.arange(0, total, cardinality)
        rounded = lengths[np.searchsorted(ends, begins, side="right")]
        sizes, first = np.unique(-rounded, return_index=True)  # descending, equal ones merged
        sizes, begins = -sizes, begins[first]
        demand = np.diff(np.append(begins, total))
        at = begins.copy()  # the next item of each group, by rank in descending length
        found, self.gap = patterns(sizes, demand, self.capacity)
        for column, times in found:
            slots = []
            for kind in np.flatnonzero(column):
                for _ in range(column[kind]):
                    slots.append(int(at[kind]))
                    at[kind] += times
            self._substitute(slots, times, ends, lengths, left)

    def _substitute(self, slots: list[int], times: int, ends: np.ndarray, lengths: np.ndarray, left: dict) -> None:
        """Actual items for ``times`` sequences of one configuration, in runs of equal lengths."""
        begun = 0
        while begun < times:
            places = [int(np.searchsorted(ends, slot + begun, side="right")) for slot in slots]
            run = min(times - begun, *(int(ends[p]) - slot - begun for p, slot in zip(places, slots)))
            offset = 0
            for place in places:
                length = int(lengths[place])
                self._put(length, run, self.sequences, offset)
                left[length] -= run
                offset += length
            self._release(self.capacity - offset, self.sequences, run)
            self.sequences += run
            begun += run

    def _release(self, room: int, sequence: int, count: int) -> None:
        if room:
            self.free[room].append((sequence, count))

    def _best_fit(self, length: int, number: int) -> None:
        while number:
            room = min((r for r in self.free if r >= length), default=None)
            if room is None:
                opened = -(-number // (self.capacity // length))
                self._release(self.capacity, self.sequences, opened)
                self.sequences += opened
                room = self.capacity
            sequence, count = self.free[room].pop()
            if not self.free[room]:
                del self.free[room]
            if number < count:
                self._release(room, sequence + number, count - number)
                count = number
            each = min(room // length, number // count)
            self._put(length, count * each, sequence, self.capacity - room, each)
            self._release(room - each * length, sequence, count)
            number -= count * each


def best_plan(counts: dict[int, int], capacity: int, groups: int = 96, parts: tuple[int, ...] = (2, 3, 4)) -> Plan:
    """The plan with the fewest sequences of those that call items large from a half, a third or a quarter on."""
    return min((Plan(counts, capacity, groups, small) for small in parts), key=lambda plan: plan.sequences)
