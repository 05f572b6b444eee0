"""A suffix array by grouping, in time linear in the text.

Suffixes start in groups by first symbol. Groups are taken in descending order; each suffix
of a group points to the nearest earlier suffix of a smaller group, and what is pointed to is
moved into a new group just above its own, the higher the more pointers it got. In the end
suffixes are grouped by their Lyndon prefixes. A second pass in ascending order emits each
group: once a suffix is ranked, those whose Lyndon prefix ends where it begins come next in
theirs. Nothing is renamed and nothing recurs.
"""
from __future__ import annotations


def suffix_array(text) -> list[int]:
    """Starts of the suffixes of a sequence of integers in ascending order; the end of the text is less than any symbol."""
    n = len(text)
    if n == 0:
        return []
    # groups: lower and upper neighbour by number, members in rising order; group 0 holds the end alone
    buckets: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        if c in buckets:
            buckets[c].append(i)
        else:
            buckets[c] = [i]
    members: list[list[int]] = [[n]]
    of = [0] * (n + 1)
    for c in sorted(buckets):
        g = len(members)
        members.append(buckets[c])
        for i in buckets[c]:
            of[i] = g
    lower, upper = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    prev, done = [-1] * (n + 1), bytearray(n + 1)
    g = len(members) - 1
    while g > 0:
        mine = members[g] = [i for i in members[g] if of[i] == g]
        for i in mine:
            done[i] = 1
        count: dict[int, int] = {}
        for i in mine:
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        if count:
            moved: dict[tuple[int, int], list[int]] = {}
            for j, c in count.items():
                key = (-c, of[j])
                if key in moved:
                    moved[key].append(j)
                else:
                    moved[key] = [j]
            for key in sorted(moved) if len(moved) > 1 else moved:
                new, old = len(members), key[1]
                s = sorted(moved[key])
                members.append(s)
                for j in s:
                    of[j] = new
                above = upper[old]
                lower.append(old)
                upper.append(above)
                lower[above] = new
                upper[old] = new
        g = lower[g]
    # starts of the groups, from the lowest
    at = [0] * len(members)
    total, g = 0, 0
    while g != -1:
        at[g] = total
        total += len(members[g])
        g = upper[g]
    out = [-1] * (n + 1)
    out[0] = n
    placed = bytearray(n + 1)
    placed[n] = 1
    for i in range(n + 1):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            k = at[of[j]]
            out[k] = j
            at[of[j]] = k + 1
            j = prev[j]
    return out[1:]
