"""Suffix arrays of many texts at once by linear grouping.

Suffixes that share their longest Lyndon prefix form a group.  Groups are
handled from the highest to the lowest: every suffix of the group looks for
the nearest suffix before it in a lower group (its previous-smaller pointer),
and the suffixes found are moved, out of their own group, to a new group right
above it, those found more often higher.  Once all groups stand, each group's
order is emitted from the lowest suffix up: a suffix s settles s - 1 and what
the pointers lead to from there, each at the front of its group.  No names are
given to prefixes and nothing recurses.

Many short texts go side by side, one group of each text a step, so the steps
are array operations.
"""

from __future__ import annotations

import numpy as np


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them), for each pair, end to end."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def _moved(found: np.ndarray, isa: np.ndarray, sa: np.ndarray, pos: np.ndarray, size: np.ndarray, moving: np.ndarray) -> None:
    """Put ``found`` into new groups at the upper ends of their groups."""
    home = isa[found]
    order = np.argsort(home, kind="stable")
    found, home = found[order], home[order]
    first = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1])))
    group = home[first]
    counts = np.diff(np.append(first, len(home)))
    new = group + size[group] - counts
    new_of = np.repeat(new, counts)
    moving[found] = True
    slots = _ragged(new, counts)
    stay = ~moving[sa[slots]]  # held by suffixes that do not move
    if stay.any():
        slot, out = slots[stay], sa[slots[stay]]
        outside = pos[found] < new_of
        mover = found[outside]
        hole = pos[mover]
        sa[hole], pos[out] = out, hole
        sa[slot], pos[mover] = mover, slot
    moving[found] = False
    isa[found] = new_of
    size[group] -= counts
    size[new] = counts


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffixes of each text symbols[bounds[i]:bounds[i + 1]] in ascending order, text after text.

    Every text must end in a symbol that is smaller than all its others.
    Positions are those of ``symbols``.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    lo, hi = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    full = hi > lo
    lo, hi = lo[full], hi[full]
    text = np.repeat(np.arange(len(lo)), hi - lo)

    # groups by first symbol; a group's number is the index where it starts in ``sa``
    key = text.astype(np.int64) * (int(symbols.max()) + 1) + symbols
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(edge, n))
    size = np.zeros(n, np.int64)
    size[edge] = counts
    isa = np.empty(n, np.int64)
    isa[sa] = np.repeat(edge, counts)
    pos = np.empty(n, np.int64)
    pos[sa] = np.arange(n)
    moving = np.zeros(n, bool)
    first_of = np.zeros(n, bool)
    first_of[lo] = True
    prev = np.where(first_of, -1, np.arange(n) - 1)

    top = hi - 1  # last index not handled yet, by text
    live = np.arange(len(lo))
    while len(live):
        start = isa[sa[top[live]]]
        count = top[live] - start + 1
        members = sa[_ragged(start, count)]
        own = np.repeat(start, count)
        top[live] = start - 1
        live = live[top[live] >= lo[live]]
        # previous-smaller pointers: past everything in this group and in those above
        active, mine = members, own
        while True:
            at = prev[active]
            go = at >= 0
            go[go] = isa[at[go]] >= mine[go]
            if not go.any():
                break
            active, mine = active[go], mine[go]
            prev[active] = prev[at[go]]
        found = prev[members]
        found = found[found >= 0]
        if not len(found):
            continue
        found.sort()
        edge = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        times = np.diff(np.append(edge, len(found)))
        found = found[edge]
        most = int(times.max())
        if most == 1:
            _moved(found, isa, sa, pos, size, moving)
        else:
            for k in np.unique(times)[::-1]:
                _moved(found[times == k], isa, sa, pos, size, moving)

    # order inside the groups, from the lowest suffix up
    out = np.empty(n, np.int64)
    placed = np.zeros(n, bool)
    front = np.arange(n)
    last = hi - 1
    out[lo], placed[last] = last, True
    front[lo] = lo + 1
    at, live = lo.copy(), np.arange(len(lo))
    while len(live):
        begin = at[live]
        end = front[isa[out[begin]]]
        if (end <= begin).any():
            raise AssertionError("a group is out of order")
        at[live] = end
        live = live[end < hi[live]]
        done = out[_ragged(begin, end - begin)]
        rank = np.arange(len(done))
        levels_j, levels_r = [], []
        j = np.where(first_of[done], -1, done - 1)
        while True:
            ok = j >= 0
            ok[ok] = ~placed[j[ok]]
            if not ok.any():
                break
            j, rank = j[ok], rank[ok]
            levels_j.append(j)
            levels_r.append(rank)
            j = prev[j]
        if not levels_j:
            continue
        j, rank = np.concatenate(levels_j), np.concatenate(levels_r)
        group = isa[j]
        order = np.lexsort((rank, group)) if len(levels_j) > 1 else np.argsort(group, kind="stable")
        j, group = j[order], group[order]
        edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        counts = np.diff(np.append(edge, len(group)))
        heads = group[edge]
        out[_ragged(front[heads], counts)] = j
        front[heads] += counts
        placed[j] = True
    return out
