"""A suffix array by the linear grouping construction.

Phase one groups suffixes by their longest Lyndon prefix.  Groups are processed in descending order;
for each member the previous suffix of a smaller group is found, and those suffixes move to a new group
right above their own, since their Lyndon prefix goes on with the member's.  Phase two walks the order
from the least suffix and emits each group's members by the pointers of phase one.  No recursion and no
renaming of the text are needed.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Positions of the suffixes of ``symbols`` (whole numbers) in ascending order.

    The empty sequence has none; a suffix that is a prefix of another comes first.
    """
    n = len(symbols)
    if not n:
        return []
    # groups are numbered; above[g] is the next higher one.  Group 0 holds the empty suffix at n.
    alphabet = {c: g for g, c in enumerate(sorted(set(symbols)), 1)}
    group = [alphabet[c] for c in symbols]
    group.append(0)
    members: list[list[int]] = [[] for _ in range(len(alphabet) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    above = [*range(1, len(members)), -1]
    below = [-1, *range(len(members) - 1)]

    previous = [-1] * (n + 1)  # the nearest suffix before of a smaller group
    left = list(range(-1, n))  # for suffixes of processed groups: where to look further left
    done = bytearray(n + 1)
    g = len(members) - 1
    while g > 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        for i in own:
            done[i] = 1
        times: dict[int, int] = {}
        for i in own:
            j = left[i]
            while j >= 0 and done[j]:
                k = left[j]
                if k >= 0:  # halve the path
                    left[i] = k
                j = k
            left[i] = previous[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            split: dict[tuple[int, int], list[int]] = {}
            for j, t in times.items():
                split.setdefault((t, group[j]), []).append(j)
            # those met more often go higher, so they are put right above their group first
            for t, h in sorted(split, reverse=True) if len(split) > 1 else split:
                moved = split[t, h]
                new = len(members)
                members.append(moved)
                size.append(len(moved))
                size[h] -= len(moved)
                up = above[h]
                above[h] = new
                above.append(up)
                below.append(h)
                if up >= 0:
                    below[up] = new
                for j in moved:
                    group[j] = new
        g = below[g]

    start, at, g = [0] * len(members), 0, 0
    while g >= 0:
        start[g] = at
        at += size[g]
        g = above[g]
    out = [0] * (n + 1)
    out[0] = n
    start[0] = 1
    placed = bytearray(n + 1)
    placed[n] = 1
    for i in range(n + 1):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = previous[j]
    return out[1:]


def common_prefixes(symbols: list[int], order: list[int]) -> list[int]:
    """For each place of the suffix array, the length of the prefix shared with the suffix before it."""
    n = len(symbols)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    out, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            while i + h < n and j + h < n and symbols[i + h] == symbols[j + h]:
                h += 1
            out[r] = h
            h = h - 1 if h else 0
        else:
            h = 0
    return out
