"""Suffix arrays by linear grouping construction, for many strings side by side.

First part: the suffixes of a string are grouped by first symbol. Groups are taken in descending order; every suffix i of the group points to
prev(i), the nearest suffix to its left in a smaller group (its previous-smaller pointer). Suffixes that are pointed to go, by the number of
pointers, into new groups right behind their old one. In the end a group holds the suffixes with one Lyndon prefix. Second part: from the least
suffix on, each suffix s that is emitted puts s - 1, then prev(s - 1) and so on, at the front of their groups, until one stands already.
There is no recursion and no renaming.

The strings are independent, so one numpy step does one group (then one emission) of every string at once. A group is a range of the array under
construction, and a group's new neighbours are cut from its end.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + counts[i] - 1, one range behind the other."""
    out = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    out += np.arange(len(out))
    return out


def _grouped(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First part. The pointer of every position (-1: none), its group, and the groups' first places in the array."""
    total = len(symbols)
    lane = np.repeat(np.arange(len(begin)), end - begin)
    order = np.argsort(lane * 512 + symbols, kind="stable")
    key = (lane * 512 + symbols)[order]
    fresh = np.ones(total, bool)
    fresh[1:] = key[1:] != key[:-1]
    group = np.empty(total, np.int64)
    group[order] = np.cumsum(fresh) - 1
    first, last = np.empty(2 * total + 1, np.int64), np.empty(2 * total + 1, np.int64)  # a new group takes at least one suffix
    made = int(fresh.sum())
    first[:made] = np.nonzero(fresh)[0]
    last[:made] = np.append(first[1:made], total)
    slots, slot_of = order, np.empty(total, np.int64)
    slot_of[slots] = np.arange(total)
    left = np.arange(total) - 1
    left[begin] = -1
    done = np.zeros(total + 1, bool)  # the last entry stands for -1
    rest, low = end.copy(), begin
    live = np.nonzero(rest > low)[0]
    while len(live):
        top = group[slots[rest[live] - 1]]
        start = first[top]
        members = slots[_ranges(start, rest[live] - start)]
        rest[live] = start
        live = live[start > low[live]]
        done[members] = True
        to = left[members]
        while True:
            far = np.nonzero(done[to])[0]
            if not len(far):
                break
            to[far] = left[to[far]]
        left[members] = to
        to = np.sort(to[to >= 0])
        if not len(to):
            continue
        cut = np.ones(len(to), bool)
        cut[1:] = to[1:] != to[:-1]
        at = np.nonzero(cut)[0]
        moved, times = to[at], np.diff(np.append(at, len(to)))
        old = group[moved]
        by = np.lexsort((times, old))
        moved, times, old = moved[by], times[by], old[by]
        edge = np.ones(len(moved), bool)
        edge[1:] = old[1:] != old[:-1]
        heads = np.nonzero(edge)[0]
        count = np.diff(np.append(heads, len(moved)))
        stop = last[old[heads]]
        place = _ranges(stop - count, count)  # where the moved ones go: the ends of their groups, few pointers first
        # what stands there and stays goes to the places that moved ones leave
        from_slot = slot_of[moved]
        tail = np.repeat(stop - count, count)
        left_open = from_slot[from_slot < tail]
        standing = slots[place]
        moving = np.zeros(len(place), bool)
        moving[_position(from_slot, tail, place)] = True
        stay = standing[~moving]
        slots[left_open] = stay
        slot_of[stay] = left_open
        slots[place] = moved
        slot_of[moved] = place
        split = edge.copy()
        split[1:] |= times[1:] != times[:-1]
        new = made + np.cumsum(split) - 1
        group[moved] = new
        number = int(split.sum())
        first[made : made + number] = place[split]
        last[made : made + number] = np.append(place[split][1:], -1)
        ends = np.append(heads[1:], len(moved)) - 1
        last[new[ends]] = stop
        last[old[heads]] = stop - count
        made += number
    return left, group, first[:made]


def _position(from_slot: np.ndarray, tail: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Indexes in ``place`` (ranges behind each other, ``tail`` the start of each one's range) of the slots that lie in their range."""
    inside = np.nonzero(from_slot >= tail)[0]
    base = np.zeros(len(place), np.int64)
    start = np.ones(len(place), bool)
    start[1:] = tail[1:] != tail[:-1]
    base = np.maximum.accumulate(np.where(start, np.arange(len(place)), 0))
    return base[inside] + from_slot[inside] - tail[inside]


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions of ``symbols`` (values below 512) so that between two bounds the suffixes of that string stand in order.

    String i is symbols[bounds[i]:bounds[i + 1]]; the end of a string is smaller than any symbol. Suffixes do not look beyond their string.
    """
    symbols = np.asarray(symbols, np.int64)
    sizes = np.diff(bounds)
    if not sizes.sum():
        return np.empty(0, np.int64)
    # every string ends with a symbol of its own that is less than all others, so the first emitted suffix is known
    begin = bounds[:-1] + np.arange(len(sizes))
    end = begin + sizes + 1
    text = np.zeros(len(symbols) + len(sizes), np.int64)
    mine = np.ones(len(text), bool)
    mine[end - 1] = False
    text[mine] = symbols + 1
    prev, group, free = _grouped(text, begin, end)
    free = free.copy()
    out = np.full(len(text), -1, np.int64)
    placed = np.zeros(len(text) + 1, bool)
    placed[-1] = True  # stands for -1, no suffix
    out[begin] = end - 1
    placed[end - 1] = True
    lanes = np.argsort(-sizes, kind="stable")
    head, stop, low = begin[lanes], end[lanes], begin[lanes]
    s = out[head] - 1
    s[s < low] = -1
    while len(head):
        emit = np.nonzero(~placed[s])[0]
        now = s[emit]
        g = group[now]
        out[free[g]] = now
        free[g] += 1
        placed[now] = True
        s[emit] = prev[now]
        step = np.nonzero(placed[s])[0]
        head[step] += 1
        going = head < stop
        if not going.all():
            head, stop, low, s = head[going], stop[going], low[going], s[going]
            step = np.nonzero(placed[s])[0]
        fresh = out[head[step]] - 1
        fresh[fresh < low[step]] = -1
        s[step] = fresh
    keep = out[mine[out]]
    lane = np.repeat(np.arange(len(sizes)), sizes)
    return keep - lane
