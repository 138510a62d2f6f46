"""Suffix arrays by linear grouping.

First the suffixes are put into groups by the Lyndon word that each starts with. Groups are taken in descending
order. For each suffix of the group the pointer to the previous smaller suffix is found; the suffixes pointed at
have, so far, been grouped by a shorter prefix, and move into new groups just above their old ones, one for each
number of suffixes that point at them, since their prefix is now known to go on with that many copies of the
group's own. When all groups have been taken they are final and in order.
Then one scan from the smallest suffix on writes each group's order: the suffix before a placed one, and those that
its pointers lead to, take the next free places of their groups. Nothing is named or sorted again: symbols (small
numbers) and numbers of pointers go to buckets.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The starts of the suffixes of ``text`` (numbers above 0) in ascending order."""
    s = [*text, 0]
    n = len(s)
    by: list[list[int]] = [[] for _ in range(max(s) + 1)]
    for i, c in enumerate(s):
        by[c].append(i)
    members = [m for m in by if m]  # by number of the group; a suffix that has moved on is told by group_of
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    group_of = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group_of[i] = g
    previous = [-1] * n  # the previous smaller suffix
    jump = list(range(-1, n - 1))  # some suffix before; all between have been taken
    taken = bytearray(n)
    final = []
    group = len(members) - 1
    while group >= 0:
        own = [i for i in members[group] if group_of[i] == group]
        final.append((group, len(own)))
        for i in own:
            taken[i] = 1
        pointers: dict[int, int] = {}
        for i in own:
            j = jump[i]
            while j >= 0 and taken[j]:
                j = jump[j]
            jump[i] = previous[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        # by number of pointers, which sum up to no more than the group: more pointers make a larger prefix, a higher group
        times: list[list[int]] = [[] for _ in range(max(pointers.values(), default=0) + 1)]
        for j, k in pointers.items():
            times[k].append(j)
        top: dict[int, int] = {}  # of each old group the highest made from it
        for same in times:
            made: dict[int, int] = {}
            for j in same:
                old = group_of[j]
                new = made.get(old, -1)
                if new < 0:
                    new = made[old] = len(members)
                    members.append([])
                    under = top.get(old, old)
                    over = above[under]
                    below.append(under)
                    above.append(over)
                    above[under] = below[over] = new
                    top[old] = new
                members[new].append(j)
                group_of[j] = new
        group = below[group]
    # the order within the groups, smallest suffix first
    free = [0] * len(members)
    at = 0
    for g, size in reversed(final):
        free[g] = at
        at += size
    out, placed = [n - 1] * n, bytearray(n)
    placed[n - 1] = 1
    for x in range(n):
        j = out[x] - 1
        while j >= 0 and not placed[j]:
            g = group_of[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return out[1:]


def common_prefixes(text: list[int], suffixes: list[int]) -> list[int]:
    """For each place in the suffix array how many symbols its suffix shares with the one before."""
    n = len(text)
    rank = [0] * n
    for r, i in enumerate(suffixes):
        rank[i] = r
    out, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r:
            j = suffixes[r - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out
