"""Suffix arrays by grouping: suffixes in groups of equal Lyndon prefix, then the order inside each group.

The method is Baier's (Linear-time Suffix Sorting, 2016) for many short texts at once, each ended by
a sentinel smaller than all symbols.
"""

from __future__ import annotations

import numpy as np

from noticewing.llm.common import ranges

#: groups from this size on are worked off by array operations
MANY = 64


class LyndonGroups:
    """Suffixes of `symbols` (0: sentinel, first and after each text) in groups by Lyndon prefix.

    `first[i]` is where i's group begins in suffix order, `before[i]` the nearest position to the left
    whose suffix is smaller ("previous smaller").
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.symbols, self.n_ends = symbols, int((symbols == 0).sum())
        self.order = np.argsort(symbols, kind="stable").astype(np.int32)
        self.place = np.empty(n, dtype=np.int32)
        self.place[self.order] = np.arange(n, dtype=np.int32)
        counts = np.bincount(symbols)
        self.first = (np.cumsum(counts) - counts).astype(np.int32)[symbols]
        self.size = np.zeros(n + 1, dtype=np.int32)
        self.size[np.cumsum(counts)[counts > 0] - counts[counts > 0]] = counts[counts > 0]
        self.before = np.arange(-1, n - 1, dtype=np.int32)
        self.done = np.zeros(n, dtype=np.uint8)
        self.moving = np.zeros(n, dtype=bool)
        self._group()

    def _group(self) -> None:
        """Groups from the highest down. When a group's turn comes its members have their whole Lyndon prefix.

        The previous smaller position of a member is the nearest one to its left whose group has not had
        its turn: its prefix grows by the member's, so it moves to a new group at the end of its own,
        further back the more members of the group follow it.
        """
        order, place, first, size, before, done, symbols = (
            memoryview(a) for a in (self.order, self.place, self.first, self.size, self.before, self.done, self.symbols))
        end = len(order)
        while end > self.n_ends:
            start = first[order[end - 1]]
            n = end - start
            if n == 1:
                i = order[start]
                done[i] = 1
                p = i - 1
                while done[p]:
                    p = before[p]
                before[i] = p
                if symbols[p]:
                    h = first[p]
                    rest = size[h] - 1
                    if rest:
                        last, at = h + rest, place[p]
                        q = order[last]
                        order[at], place[q], order[last], place[p] = q, at, p, last
                        size[h], size[last], first[p] = rest, 1, last
            elif n < MANY:
                members = order[start:end].tolist()
                for i in members:
                    done[i] = 1
                follow: dict[int, int] = {}
                for i in members:
                    p = i - 1
                    while done[p]:
                        p = before[p]
                    before[i] = p
                    if symbols[p]:
                        follow[p] = follow.get(p, 0) + 1
                for k in sorted(set(follow.values()), reverse=True):
                    moved: dict[int, int] = {}
                    for p, times in follow.items():
                        if times == k:
                            h = first[p]
                            m = moved.get(h, 0)
                            moved[h] = m + 1
                            last, at = h + size[h] - 1 - m, place[p]
                            q = order[last]
                            order[at], place[q], order[last], place[p] = q, at, p, last
                    for h, m in moved.items():
                        rest = size[h] - m
                        if rest:
                            size[h], size[h + rest] = rest, m
                            for x in range(h + rest, h + rest + m):
                                first[order[x]] = h + rest
            else:
                self._turn_of(self.order[start:end].copy())
            end = start

    def _turn_of(self, members: np.ndarray) -> None:
        """The same for a large group."""
        self.done[members] = 1
        open_ = members
        while len(open_):
            p = self.before[open_]
            passed = self.done[p] > 0
            open_ = open_[passed]
            self.before[open_] = self.before[p[passed]]  # pointers double where members follow each other
        p = self.before[members]
        parents, times = np.unique(p[self.symbols[p] > 0], return_counts=True)
        for k in np.unique(times)[::-1]:
            self._move(parents[times == k])

    def _move(self, parents: np.ndarray) -> None:
        """`parents` to the ends of their groups, where they are groups of their own."""
        own = self.first[parents]
        by = np.argsort(own, kind="stable")
        parents, own = parents[by], own[by]
        edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        m = np.diff(np.append(edge, len(own))).astype(np.int32)
        group = own[edge]
        tail = group + self.size[group] - m
        slots = ranges(tail.astype(np.int64), m.astype(np.int64))
        self.moving[parents] = True
        there = self.order[slots]
        out = there[~self.moving[there]]
        at = self.place[parents]
        free = at[at < np.repeat(tail, m)]  # as many as `out` in every group, in the same order of groups
        self.order[free], self.place[out] = out, free
        self.order[slots], self.place[parents] = parents, slots
        self.moving[parents] = False
        self.size[group] -= m
        self.size[tail] = m
        self.first[parents] = np.repeat(tail, m)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of `symbols` (0: sentinel, first and after each text) in the order of their suffixes.

    Sentinels come first and stop a comparison: an earlier one is smaller.
    """
    groups = LyndonGroups(symbols)
    n = len(symbols)
    out_array = np.zeros(n, dtype=np.int32)
    placed_array = (symbols == 0).astype(np.uint8)
    out_array[: groups.n_ends] = np.flatnonzero(placed_array)
    fill_array = np.arange(n, dtype=np.int32)
    out, placed, fill, first, before = (memoryview(a) for a in (out_array, placed_array, fill_array, groups.first, groups.before))
    # In ascending order, each suffix places those that end their Lyndon prefix where it begins.
    for s in out:
        j = s - 1
        while not placed[j]:
            g = first[j]
            f = fill[g]
            out[f] = j
            fill[g] = f + 1
            placed[j] = 1
            j = before[j]
    return out_array
