"""Suffix arrays of many small texts side by side, by linear grouping (Baier, "Linear-time suffix sorting", 2016)."""

from __future__ import annotations

import numpy as np

from lakelens.llm.base import ranges


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions of ``symbols`` in suffix order, text by text: text g fills [bounds[g], bounds[g + 1]).

    Every text ends with its only 0, the smallest symbol. Phase 1 keeps groups of suffixes as intervals of
    the array, named by their starts; it takes the groups of each text in descending order, finds the previous
    smaller suffix of each member by following pointers, and moves those that are pointed at, by how
    often, to new groups behind what stays of theirs: a group ends as the suffixes with one
    longest Lyndon prefix. Phase 2 goes upwards: a suffix that got its place places those that it follows next,
    each at the front of its group. Nothing is renamed and no smaller string is sorted. All texts take
    their steps together, so the steps are those of the longest text and the work is linear in the sum.
    """
    n, texts = len(symbols), len(bounds) - 1
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    # index 0 stands before every text: no suffix, smaller than all
    key = owner * (int(symbols.max(initial=0)) + 1) + symbols
    array = np.argsort(key, kind="stable") + 1
    sorted_key = key[array - 1]
    starts = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])) if n else np.zeros(0, np.int64)
    group = np.full(n + 1, -1, np.int64)
    group[array] = np.repeat(starts, np.diff(np.append(starts, n)))
    size = np.zeros(n + 1, np.int64)
    size[starts] = np.diff(np.append(starts, n))
    place = np.zeros(n + 1, np.int64)
    place[array] = np.arange(n)
    before = np.arange(-1, n)  # of index i + 1
    before[bounds[:-1][np.diff(bounds) > 0] + 1] = 0
    previous = np.zeros(n + 1, np.int64)
    end = bounds[1:].copy()
    live = np.flatnonzero(end > bounds[:-1])
    while len(live):
        last = end[live]
        low = group[array[last - 1]]
        count = last - low
        members = array[ranges(low, count)]
        limit = np.repeat(low, count)
        previous[members] = before[members]
        todo, bar = members, limit
        while len(todo):
            at = previous[todo]
            open_ = group[at] >= bar
            todo, bar, at = todo[open_], bar[open_], at[open_]
            previous[todo] = previous[at]
        end[live] = low
        live = live[low > bounds[live]]
        hit = np.sort(previous[members])
        hit = hit[np.searchsorted(hit, 1) :]
        if not len(hit):
            continue
        first = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1]]))
        times = np.diff(np.append(first, len(hit)))
        hit = hit[first]
        old = group[hit]
        order = np.lexsort((times, old))
        hit, old, times = hit[order], old[order], times[order]
        # all that move take the last slots of their group, by (group, times)
        head = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        moved = np.diff(np.append(head, len(hit)))
        g = old[head]
        slots = ranges(g + size[g] - moved, moved)
        edge = np.repeat(g + size[g] - moved, moved)
        was = place[hit]
        vacated = was[was < edge]
        sitting = array[slots]
        place[hit] = -1
        displaced = sitting[place[sitting] >= 0]
        array[vacated] = displaced
        place[displaced] = vacated
        array[slots] = hit
        place[hit] = slots
        new = np.flatnonzero(np.concatenate([[True], (old[1:] != old[:-1]) | (times[1:] != times[:-1])]))
        length = np.diff(np.append(new, len(hit)))
        size[g] -= moved
        size[slots[new]] = length
        group[hit] = np.repeat(slots[new], length)
    # phase 2: `front` is the next free slot of each group, `rank` the slot whose suffix is at work
    front = np.arange(n + 1)
    done = np.zeros(n + 1, bool)
    done[0] = True
    live = np.flatnonzero(np.diff(bounds) > 0)
    rank, stop = bounds[live].copy(), bounds[live + 1]
    array[rank] = bounds[live + 1]  # the last suffix is the smallest
    done[bounds[live + 1]] = True
    at = before[array[rank]]
    while len(rank):
        closed = done[at]
        if closed.any():
            rank[closed] += 1
            keep = rank < stop
            if not keep.all():
                rank, stop, at, closed = rank[keep], stop[keep], at[keep], closed[keep]
            at[closed] = before[array[rank[closed]]]
            open_ = ~done[at]
            now = at[open_]
        else:
            open_, now = slice(None), at
        slot = group[now]
        slot_at = front[slot]
        array[slot_at] = now
        front[slot] = slot_at + 1
        done[now] = True
        at[open_] = previous[now]
    return array - 1
