"""Suffix array by linear grouping (Lyndon prefixes, previous-smaller pointers).

Suffixes start in groups by their first symbol. Groups are taken in descending
order; each member's pointer goes to the nearest earlier suffix of a smaller
group, and the suffixes pointed at move to new groups right behind their old one,
those with more pointers further back. When all groups are done, each holds the
suffixes with one Lyndon prefix, and a single ascending pass along the pointers
emits the order: nothing is renamed and nothing is sorted again.
"""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """Order of the suffixes of ``s``, whose last symbol is its only least one."""
    n = len(s)
    at = sorted(range(n), key=s.__getitem__)     # suffixes by group
    place, group, stop = [0] * n, [0] * n, [0] * (n + 1)
    g = 0
    for k, i in enumerate(at):
        if s[i] != s[at[g]]:
            stop[g] = k
            g = k
        place[i], group[i] = k, g
    stop[g] = n
    smaller = [-1] * n                           # previous-smaller pointers

    def behind(j: int) -> int:
        """Move ``j`` to the last place of its group and take that place off the group."""
        h = group[j]
        z = stop[h] - 1
        other, a = at[z], place[j]
        at[a], place[other] = other, a
        at[z], place[j] = j, z
        stop[h] = z
        return h

    e = n
    while e:
        g = group[at[e - 1]]
        if e - g == 1:
            i = at[g]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = smaller[j]
            smaller[i] = j
            if j >= 0 and stop[group[j]] - group[j] > 1:
                behind(j)
                z = place[j]
                group[j], stop[z] = z, z + 1
        else:
            pointed: dict[int, int] = {}
            for i in sorted(at[g:e]):
                j = i - 1
                while j >= 0 and group[j] >= g:
                    j = smaller[j]
                smaller[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            levels: dict[int, list[int]] = {}
            for j, times in pointed.items():
                levels.setdefault(times, []).append(j)
            for times in sorted(levels, reverse=True):
                ends: dict[int, int] = {}
                for j in levels[times]:
                    ends.setdefault(group[j], stop[group[j]])
                    behind(j)
                for h, end in ends.items():
                    z = stop[h]
                    stop[z] = end
                    if z != h:
                        for k in range(z, end):
                            group[at[k]] = z
        e = g
    out, front, done = [-1] * n, list(range(n)), bytearray(n)
    h = group[n - 1]
    out[h], done[n - 1] = n - 1, 1
    front[h] += 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            h = group[j]
            out[front[h]] = j
            front[h] += 1
            done[j] = 1
            j = smaller[j]
    return out
