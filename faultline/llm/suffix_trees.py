"""Suffix trees of a word sequence and its reversal, and longest common extensions from them.

A tree is grown left to right by Ukkonen's rule; its Euler tour turns the question how far two
suffixes agree into the least depth between two places of the tour, answered in constant time from
minima of blocks. All queries of one sequence are answered together in numpy.
"""

import numpy as np

END = 0  # the symbol behind the last one, smaller than all others
BLOCK = 32


class RangeMinimum:
    """Least value between two places (both included): sparse table over blocks, scans within one."""

    def __init__(self, values: np.ndarray):
        n = -(-len(values) // BLOCK) * BLOCK
        self.grid = np.full(n, np.iinfo(np.int64).max).reshape(-1, BLOCK)
        self.grid.reshape(-1)[: len(values)] = values
        self.upto = np.minimum.accumulate(self.grid, axis=1).reshape(-1)
        self.onward = np.minimum.accumulate(self.grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.levels = [self.grid.min(axis=1)]
        while 2 << len(self.levels) - 1 <= len(self.levels[0]):
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(a, b), np.maximum(a, b)
        out = np.minimum(self.onward[low], self.upto[high])
        first, last = low // BLOCK + 1, high // BLOCK  # whole blocks between
        width = last - first
        for k in np.unique(np.frexp(np.maximum(width, 1))[1][width > 0] - 1):
            at = np.flatnonzero((width > 0) & (np.frexp(np.maximum(width, 1))[1] - 1 == k))
            table = self.levels[k]
            out[at] = np.minimum(out[at], np.minimum(table[first[at]], table[last[at] - (1 << k)]))
        same = np.flatnonzero(width < 0)
        if len(same):
            flat, start, least = self.grid.reshape(-1), low[same], None
            for step in range(BLOCK):
                seen = flat[np.minimum(start + step, high[same])]
                least = seen if least is None else np.minimum(least, seen)
            out[same] = least
        return out


class SuffixTree:
    """Suffix tree of ``symbols`` (integers above ``END``); ``ordered`` visits children by symbol."""

    def __init__(self, symbols: list[int], ordered: bool):
        self.n = len(symbols)
        children, depth = _ukkonen([*symbols, END])
        tour, self.place, leaves = _euler_tour(children, depth, self.n + 1, ordered)
        self.least = RangeMinimum(np.array(tour, np.int64))
        self.first = np.array(self.place, np.int64)
        self.leaves = leaves  # suffixes in tour order: sorted, if ordered

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``a`` and ``b`` (different, at most n) share."""
        return self.least(self.first[a], self.first[b])


def _ukkonen(s: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Children and depths of the inner nodes; a child below 0 is the leaf of suffix -1 - child.

    The edge into inner node v holds the symbols from ``start[v]`` on, up to its depth; leaf j is
    the suffix at j, and its edge begins at ``leaf_start[j]`` and goes to the end.
    """
    children: list[dict[int, int]] = [{}]
    depth, start, link, leaf_start = [0], [0], [0], []
    node, edge, length = 0, 0, 0  # the active place: so far along an edge below a node
    waiting = 0  # suffixes that end inside the tree
    for i, c in enumerate(s):
        unlinked = 0
        waiting += 1
        while waiting:
            if not length:
                edge = i
            below = children[node]
            child = below.get(s[edge])
            if child is None:
                below[s[edge]] = -1 - len(leaf_start)
                leaf_start.append(i)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                if child >= 0:
                    begin = start[child]
                    size = depth[child] - depth[node]
                    if length >= size:
                        node, edge, length = child, edge + size, length - size
                        continue
                else:
                    begin = leaf_start[-1 - child]  # such an edge has no end yet
                if s[begin + length] == c:
                    length += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                split = len(children)
                children.append({s[begin + length]: child, c: -1 - len(leaf_start)})
                depth.append(depth[node] + length)
                start.append(begin)
                link.append(0)
                below[s[edge]] = split
                if child >= 0:
                    start[child] = begin + length
                else:
                    leaf_start[-1 - child] = begin + length
                leaf_start.append(i)
                if unlinked:
                    link[unlinked] = split
                unlinked = split
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return children, depth


def _euler_tour(children: list[dict[int, int]], depth: list[int], n: int, ordered: bool) -> tuple[list[int], list[int], list[int]]:
    """Depths along the tour, each leaf's place on it, leaves in the order of the tour."""
    arrange = (lambda d: [v for _, v in sorted(d.items())]) if ordered else lambda d: list(d.values())
    tour, place, leaves = [0], [0] * n, []
    path, todo = [0], [iter(arrange(children[0]))]
    while todo:
        here = depth[path[-1]]
        for child in todo[-1]:
            if child < 0:
                leaf = -1 - child
                place[leaf] = len(tour)
                leaves.append(leaf)
                tour.append(n - leaf)
                tour.append(here)
            else:
                path.append(child)
                todo.append(iter(arrange(children[child])))
                tour.append(depth[child])
                break
        else:
            path.pop()
            todo.pop()
            if path:
                tour.append(depth[path[-1]])
    return tour, place, leaves
