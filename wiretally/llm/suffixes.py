"""Suffix array by linear grouping: Lyndon-prefix groups, then one pass that emits their order."""
from __future__ import annotations

import numpy as np


def suffix_array(text: bytes) -> np.ndarray:
    """Start positions of all suffixes of a text in ascending order.

    Phase 1 keeps the suffixes in groups, ordered, of equal known prefix; at first
    that is one symbol. Groups are taken from the highest down. Each suffix of the
    group has a previous smaller suffix: the nearest position to its left in a
    lower group. Every such position has the group's prefix behind its own, as
    often as the group points to it, so it moves behind its old group, further
    for more pointers. In the end a group holds the suffixes with one Lyndon prefix.

    Phase 2 goes through the array from its least entry, the end mark. Whoever has
    been placed lets its left neighbour, and the previous smaller suffixes of that
    in turn, take the next free place of their groups. No names, no recursion.
    """
    n = len(text) + 1
    symbols = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    symbols = np.append(symbols, 0)
    order = np.argsort(symbols, kind="stable")
    starts = np.searchsorted(symbols[order], symbols, side="left")
    row = order.tolist()                               # suffixes, group after group
    place = [0] * n
    for at, i in enumerate(row):
        place[i] = at
    group = starts.tolist()                            # start of the group of each suffix
    size = dict(zip(*(x.tolist() for x in np.unique(starts, return_counts=True))))
    previous = [-1] * n

    at = n
    while at > 0:
        g = group[row[at - 1]]                         # the group that ends here
        members = sorted(row[g:at])
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) == 1:
            moves = [list(pointed)]
        else:
            parts: dict[tuple[int, int], list[int]] = {}
            for p, times in pointed.items():
                parts.setdefault((times, group[p]), []).append(p)
            moves = [parts[k] for k in sorted(parts, reverse=True)]
        for moved in moves:
            old = group[moved[0]]
            end = old + size[old]
            if len(moved) == size[old]:
                continue                               # the whole group moves behind itself
            for p in moved:
                end -= 1
                other, here = row[end], place[p]
                row[here], row[end] = other, p
                place[other], place[p] = here, end
            for p in moved:
                group[p] = end
            size[end] = len(moved)
            size[old] -= len(moved)
        at = g

    out = [-1] * n
    out[0] = n - 1
    free = dict.fromkeys(size, 0)
    placed = bytearray(n)
    placed[n - 1] = 1
    free[group[n - 1]] = 1
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[g + free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return np.array(out[1:], np.int64)
