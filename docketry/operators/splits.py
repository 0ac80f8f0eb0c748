"""First combinations of 2, 3 and 4 claims of a group that add up to another claim of it, for groups of any size.

In the first combination (by its ascending ids) a claim would give way to an earlier one of the same total, were that free: so only
the first few ids of each total can take part, however large the group. Totals of few units are summed in one table of all sums;
others are searched, prefixes in the order of ids, with the last claim looked up among the sorted totals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SIZES = (2, 3, 4)
#: Ids of a total that can take part: the three other places of a combination and the whole may hold as many earlier ones.
ALIKE = SIZES[-1] + 1
#: Below so many units (the greatest common divisor of the totals), 1 % of a total is less than a unit.
UNITS = 100
#: Pairs that are looked up at once.
AT_ONCE = 1 << 20
NONE = 1 << 62


def kernel(kind: str) -> Callable[[pa.Table], pa.Table]:
    """Of a group's rows (w, cents): w and the ids of its first combination of each size. kind: Spark's type of the ids."""

    def run(table: pa.Table) -> pa.Table:
        column = table["w"].combine_chunks()
        ids = np.array(column.to_pylist(), object) if kind == "string" else column.to_numpy(zero_copy_only=False)
        names, rank = np.unique(ids, return_inverse=True)
        found = combinations(rank, table["cents"].to_numpy())
        names = pa.array(names, column.type)
        size = np.concatenate([np.full(len(w), parts.shape[1]) for w, parts in found])
        of = lambda x: names.take(pa.array(x))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), of(np.concatenate([parts.ravel() for _, parts in found])))
        return pa.table({"w": of(np.concatenate([w for w, _ in found])), "ids": lists})

    return run


def combinations(rank: np.ndarray, cents: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size the wholes that have a combination, and a row of ascending ranks of each; an id may have several totals."""
    order = np.lexsort((rank, cents))
    rank, cents = rank[order], cents[order]
    other = np.append(True, (rank[1:] != rank[:-1]) | (cents[1:] != cents[:-1]))
    rank, cents = rank[other], cents[other]
    start = np.flatnonzero(np.append(True, cents[1:] != cents[:-1]))
    place = np.arange(len(cents)) - np.repeat(start, np.diff(np.append(start, len(cents))))
    part = place < ALIKE
    part_rank, part_cents = rank[part], cents[part]
    back = np.argsort(part_rank, kind="stable")
    part_rank, part_cents = part_rank[back], part_cents[back]
    unit = np.gcd.reduce(cents)
    if cents[0] > 0 and cents[-1] < UNITS * unit and (np.diff(np.sort(rank)) > 0).all():
        return _summed(rank, cents // unit, part_rank, part_cents // unit)
    return _searched(rank, cents, part_rank, part_cents)


def _summed(rank: np.ndarray, units: np.ndarray, part_rank: np.ndarray, part_units: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """All totals are positive, so none that equals a sum takes part in it."""
    base, top = len(part_rank), int(units.max())
    # row k - 1, column s: the least number, to the base, of k places in ascending order whose totals make s
    least = np.full((SIZES[-1], top + 1), NONE, np.int64)
    lead = base ** np.arange(1, SIZES[-1], dtype=np.int64)[:, None]
    for i in range(base - 1, -1, -1):
        u = int(part_units[i])
        tails = least[:-1, : top + 1 - u] + lead * i
        np.minimum(least[1:, u:], tails, out=least[1:, u:])
        least[0, u] = i
    out = []
    for k in SIZES:
        code = least[k - 1][units]
        w, code = rank[code < NONE], code[code < NONE]
        out.append((w, part_rank[code[:, None] // base ** np.arange(k - 1, -1, -1, dtype=np.int64) % base]))
    return out


def _searched(rank: np.ndarray, cents: np.ndarray, part_rank: np.ndarray, part_cents: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    every = Parts(part_rank, part_cents)
    without = cache(lambda w: Parts(part_rank[part_rank != w], part_cents[part_rank != w]))
    first = cache(lambda c, k: every.first(c - c // 100, c + c // 100, k))
    out = []
    for k in SIZES:
        found: dict[int, tuple[int, ...]] = {}
        for w, c in zip(rank.tolist(), cents.tolist()):
            if c < 0:
                continue
            ids = first(c, k)
            if ids and w in ids:
                ids = without(w).first(c - c // 100, c + c // 100, k)
            if ids:
                found[w] = min(ids, found.get(w, ids))
        out.append((np.array(list(found), np.int64), np.array(list(found.values()), np.int64).reshape(-1, k)))
    return out


class Parts:
    """Claims in the order of their ids."""

    def __init__(self, rank: np.ndarray, cents: np.ndarray) -> None:
        self.rank, self.cents = rank, cents
        by = np.lexsort((rank, cents))
        self.sorted, self.sorted_rank = cents[by], rank[by]
        # row j: the greatest rank of 2 ** j sorted totals from each on
        self.last = [self.sorted_rank]
        while 2 ** len(self.last) <= len(rank):
            half = 2 ** (len(self.last) - 1)
            self.last.append(np.maximum(self.last[-1][:-half], self.last[-1][half:]))
        self.after = np.searchsorted(rank, rank, side="right")  # first place with a greater rank
        self._pairs: tuple | None = None

    def first(self, low: int, high: int, k: int) -> tuple[int, ...] | None:
        """The least k ascending ranks whose totals make low to high."""
        n = len(self.rank)
        if n < k:
            return None
        if k == 2:
            return self._best(self.rank[:, None], self.cents, low, high)
        if k == 3:
            return self._of_pairs(0, low, high)
        at = 0
        while at < n:
            end, best = int(self.after[at]), None
            for c in self.cents[at:end].tolist():  # totals of one id
                tail = self._of_pairs(end, low - c, high - c)
                best = min(tail, best or tail) if tail else best
            if best:
                return (int(self.rank[at]), *best)
            at = end
        return None

    def _of_pairs(self, at: int, low: int, high: int) -> tuple[int, ...] | None:
        for ranks, cents in self._blocks(at):
            best = self._best(ranks, cents, low, high)
            if best:
                return best
        return None

    def _best(self, ranks: np.ndarray, cents: np.ndarray, low: int, high: int) -> tuple[int, ...] | None:
        """The least prefix (ranks ascend by rows) and last rank."""
        a, b = np.searchsorted(self.sorted, low - cents), np.searchsorted(self.sorted, high - cents, side="right")
        some = np.flatnonzero(a < b)
        level = np.frexp((b - a)[some].astype(float))[1] - 1
        top = np.full(len(some), -1, np.int64)
        for j in np.unique(level).tolist():
            x = some[level == j]
            top[level == j] = np.maximum(self.last[j][a[x]], self.last[j][b[x] - 2**j])
        some = some[top > ranks[some, -1]]
        if not len(some):
            return None
        head = tuple(ranks[some[0]].tolist())
        ends = []
        for x in some[(ranks[some] == head).all(axis=1)].tolist():  # more than one where an id has several totals
            r = self.sorted_rank[a[x] : b[x]]
            ends.append(int(r[r > head[-1]].min()))
        return (*head, min(ends))

    def _blocks(self, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ranks and sums of the pairs of places from `at` on, in the order of their ranks."""
        n = len(self.rank)
        if n * (n - 1) // 2 <= AT_ONCE:
            if self._pairs is None:
                self._pairs = self._between(0, n)
            ranks, cents = self._pairs
            begin = np.searchsorted(ranks[:, 0], self.rank[at]) if at < n else len(ranks)
            yield ranks[begin:], cents[begin:]
            return
        while at < n:
            end = max(int(self.after[at]), at + AT_ONCE // n)
            end = n if end >= n else int(np.searchsorted(self.rank, self.rank[end]))
            end = max(end, int(self.after[at]))
            yield self._between(at, end)
            at = end

    def _between(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        many = len(self.rank) - self.after[a:b]
        i = np.repeat(np.arange(a, b), many)
        j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + self.after[i]
        ranks, cents = np.column_stack([self.rank[i], self.rank[j]]), self.cents[i] + self.cents[j]
        by = np.lexsort((ranks[:, 1], ranks[:, 0]))
        return ranks[by], cents[by]
