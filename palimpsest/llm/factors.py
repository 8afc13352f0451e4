"""Longest previous factors of strings that share a gram, from suffix order and smaller positions.

A context is a string around a gram, which all contexts of a group hold at the same column, `middle`. Two suffixes that
start at the same place before the gram have a common prefix that reaches into it iff they agree up to the gram; then
it goes on as long as the parts from the gram on agree. So the suffixes at a place fall into sets of equal left parts,
and within a set they are ordered by their right parts alone. With places further left the sets only split: they are the
nodes of the tree that the left parts, read outwards from the gram, span. For each node, from the root on:

* its suffixes in order, and the common prefixes of neighbours;
* for each the nearest suffix above and below in that order that starts at a smaller position (an earlier one in the corpus);
* the longer of the two common prefixes: the longest previous factor, for all places that the node stands for.

All nodes of one depth, of all groups of a batch, are worked on at once.
"""

from __future__ import annotations

import numpy as np


def minima(x: np.ndarray) -> list[np.ndarray]:
    """Row k holds the smallest of x[i : i + 2**k]."""
    out, w = [x], 1
    while 2 * w <= len(x):
        out.append(np.minimum(out[-1][:-w], out[-1][w:]))
        w *= 2
    return out


def smallest(rows: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The smallest of x[lo : hi + 1] for each pair, from minima(x)."""
    out, k = np.empty(len(lo), rows[0].dtype), np.frexp((hi - lo + 1).astype(float))[1] - 1
    for level in np.unique(k):
        own = k == level
        out[own] = np.minimum(rows[level][lo[own]], rows[level][hi[own] - (1 << int(level)) + 1])
    return out


def previous_smaller(position: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in order, the place in the order of the nearest one above of smaller position (-1: none), and its
    common prefix with it. lcp: common prefixes with the one above."""
    n = len(position)
    low, common = minima(position), minima(lcp)
    at, shared = np.arange(n), np.full(n, np.iinfo(lcp.dtype).max, dtype=lcp.dtype)
    for k in range(len(low) - 1, -1, -1):
        j = at - (1 << k)
        move = np.flatnonzero(j >= 0)
        move = move[low[k][j[move]] > position[move]]
        shared[move] = np.minimum(shared[move], common[k][j[move] + 1])
        at[move] = j[move]
    return at - 1, np.where(at > 0, np.minimum(shared, lcp[at]), 0).astype(lcp.dtype)


def next_smaller(position: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """previous_smaller() below."""
    at, shared = previous_smaller(position[::-1], np.concatenate([lcp[:1] * 0, lcp[:0:-1]]))
    return np.where(at >= 0, len(position) - 1 - at, -1)[::-1], shared[::-1]


def in_order(strings: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows by group (numbers from 0), then string; strings[k, : lengths[k]] is a string."""
    m, width = strings.shape[0], strings.shape[1] + 4
    keys = np.empty((m, width), dtype=np.uint8)
    keys[:, :4] = group.astype(">u4").view(np.uint8).reshape(m, 4)
    keys[:, 4:] = strings
    flat, ends = keys.tobytes(), (np.arange(m) * width + 4 + lengths).tolist()
    keys = [flat[k * width : end] for k, end in enumerate(ends)]
    return np.array(sorted(range(m), key=keys.__getitem__), dtype=np.int64)


def shared_with_above(strings: np.ndarray, lengths: np.ndarray, group: np.ndarray, by: np.ndarray, first: int) -> np.ndarray:
    """Common prefixes of each string in the order `by` with the one above; `first` where a group begins."""
    out = np.full(len(by), first, dtype=np.int32)
    for k in range(1, len(by), 4096):
        a, b = by[k - 1 : k + 4095], by[k : k + 4096]
        a = a[: len(b)]
        differ = strings[a] != strings[b]
        n = np.where(differ.any(1), differ.argmax(1), strings.shape[1])
        out[k : k + 4096] = np.where(group[a] == group[b], np.minimum(n, np.minimum(lengths[a], lengths[b])), first)
    return out


def _thin(values: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Common prefixes with the one above among the kept alone."""
    p = np.flatnonzero(keep)
    return np.minimum.reduceat(values[: p[-1] + 1], np.concatenate([[0], p[:-1] + 1])) if len(p) else values[:0]


def factors(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray, position: np.ndarray, middle: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(previous, other): for each context (a row, whose text is from column lo to hi) and place from 0 to middle, the longest previous factor
    of the suffix there, and the longest factor that any other suffix of the group at that place begins with; 0 where there is none that
    takes in the left part and at least one byte of the gram. Lengths from `least` on are exact; suffixes that can't reach it are left out on
    the way, so that smaller ones may be too small (none are with least=1). position: distinct numbers, by place in the corpus."""
    m = len(rows)
    group = np.unique(group, return_inverse=True)[1]
    left, right = np.ascontiguousarray(rows[:, :middle][:, ::-1]), rows[:, middle:]
    n_left, n_right = middle - lo, hi - middle
    previous, other = np.zeros((m, middle + 1), dtype=np.int32), np.zeros((m, middle + 1), dtype=np.int32)
    a = in_order(left, n_left, group)  # by left part, read outwards
    deep = shared_with_above(left, n_left, group, a, -1)
    longest = np.empty(m, dtype=np.int64)
    longest[a] = np.maximum(deep, np.append(deep[1:], -1))
    r = in_order(right, n_right, group)  # by right part
    lcp = shared_with_above(right, n_right, group, r, 0)
    node = np.empty(m, dtype=np.int64)  # of each context, numbered in the order of a
    node[a] = np.cumsum(deep < 0) - 1
    while len(r):
        best = np.maximum(lcp, np.append(lcp[1:], 0))
        keep = (best > 0) & (best + longest[r] >= least)
        if not keep.all():
            lcp = _thin(lcp, keep)
            stays = np.zeros(m, dtype=bool)
            stays[r[keep]] = True
            r, deep, a = r[keep], _thin(deep, stays[a]), a[stays[a]]
            if not len(r):
                break
        # nodes that are left, as runs of a, and the left bytes that all of a node share
        own = node[a]
        begins = np.concatenate([[True], own[1:] != own[:-1]])
        starts = np.flatnonzero(begins)
        deep[starts] = middle + 1
        depth = np.minimum.reduceat(deep, starts)
        number = np.cumsum(begins) - 1
        node[a] = number
        own = node[r]
        lcp[np.concatenate([[True], own[1:] != own[:-1]])] = 0
        up, n_up = previous_smaller(position[r], lcp)
        down, n_down = next_smaller(position[r], lcp)
        whole = depth[own] <= middle  # nodes of two or more
        column = middle - np.minimum(depth[own], middle)
        longest_previous = np.where(whole, np.maximum(n_up, n_down), 0)
        for grid in (previous, other):
            grid[r, column] = np.maximum(grid[r, column], longest_previous)
        for to, n in ((up, n_up), (down, n_down)):  # the earlier ones are others to those that found them
            hit = np.flatnonzero(n > 0)
            np.maximum.at(other, (r[to[hit]], column[hit]), n[hit])
        # nodes split where no more left bytes are shared
        node[a] = np.cumsum(begins | (deep <= depth[number])) - 1
        deep[begins] = -1
        by = np.argsort(node[r], kind="stable")
        table, r = minima(lcp), r[by]
        lcp = np.zeros(len(r), dtype=np.int32)
        same = np.flatnonzero(node[r[1:]] == node[r[:-1]]) + 1
        lcp[same] = smallest(table, by[same - 1] + 1, by[same])
    for grid in (previous, other):
        np.maximum.accumulate(grid, axis=1, out=grid)
        grid += np.where(grid > 0, middle - np.arange(middle + 1, dtype=np.int32), 0)
    return previous, other
