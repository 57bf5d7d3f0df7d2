"""Linear suffix sorting by grouping, without recursion.

Suffixes are first grouped by their Lyndon prefix: groups are taken in descending order, and
every suffix that a group's members point back to (the nearest one before them in a lower
group) moves to a new group just above its own. Walking the suffixes in ascending order then
puts each group's members in order, again through those pointers.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in ascending order. The last symbol must be smaller
    than all others."""
    t = np.asarray(symbols)
    n = len(t)
    if n < 2:
        return np.arange(n)
    if not (t[:-1] > t[-1]).all():
        raise ValueError("the last symbol must be the least")
    order = np.argsort(t, kind="stable")
    new = np.concatenate([[True], t[order][1:] != t[order][:-1]])
    firsts = np.flatnonzero(new)
    of_rank = firsts[np.cumsum(new) - 1]
    start_np, pos_np, end_np = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    start_np[order], pos_np[order] = of_rank, np.arange(n)
    end_np[firsts] = np.append(firsts[1:], n)
    start, pos, ends, at = start_np.tolist(), pos_np.tolist(), end_np.tolist(), order.tolist()
    before = [-1] * n
    stop = n
    while stop > 1:
        group = start[at[stop - 1]]
        if stop - group == 1:
            i = at[group]
            p = i - 1
            while p >= 0 and start[p] > group:
                p = before[p]
            before[i] = p
            if p >= 0:  # the only suffix that this group points back to
                s = start[p]
                e = ends[s] - 1
                if e > s:
                    other, here = at[e], pos[p]
                    at[here], pos[other] = other, here
                    at[e], pos[p] = p, e
                    start[p], ends[e], ends[s] = e, e + 1, e
            stop = group
            continue
        counts: dict[int, int] = {}
        for i in sorted(at[group:stop]):
            p = i - 1
            while p >= 0 and start[p] >= group:
                p = before[p]
            before[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        stop = group
        if len(counts) == 1:
            batches = [list(counts)]
        else:
            by: dict[tuple[int, int], list[int]] = {}
            for p, c in counts.items():
                by.setdefault((c, start[p]), []).append(p)
            batches = [by[k] for k in sorted(by, reverse=True)] if len(by) > 1 else by.values()
        for batch in batches:
            s = start[batch[0]]
            e = stop_was = ends[s]
            if stop_was - s == len(batch):
                continue
            for p in batch:
                e -= 1
                other, here = at[e], pos[p]
                at[here], pos[other] = other, here
                at[e], pos[p] = p, e
            for p in batch:
                start[p] = e
            ends[e], ends[s] = stop_was, e
    out = [-1] * n
    free = list(range(n))
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            s = start[j]
            out[free[s]] = j
            free[s] += 1
            j = before[j]
    return np.array(out)
