"""Suffix sorting by Lyndon-prefix groups: linear, and without recursive renaming.

First all suffixes are grouped by their first symbol. Groups are taken in descending order. Each suffix i of the
current group is tied to ``prev[i]``, the nearest suffix to its left that lies in a lower group; such a suffix's
prefix grows by the current group's (as often as members point at it), so it moves to a new group right above the
rest of its own. In the end a group holds the suffixes with one longest Lyndon prefix. Then the order is emitted in
one pass: after the suffix at s is placed, s - 1 and the suffixes along its ``prev`` pointers that aren't placed yet
come next in their groups.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; a suffix comes before those it is a prefix of."""
    n = len(text)
    number = {s: g for g, s in enumerate(sorted(set(text)))}
    members = [[] for _ in number]
    group = [number[s] for s in text]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    prev, done, final = [-1] * n, bytearray(n + 1), []  # -1 is never done
    at = len(members) - 1
    while at >= 0:
        here = members[at]
        if len(here) == 1:  # the most of them
            i = here[0]
            if group[i] == at:
                final.append(here)
                p = i - 1
                while done[p]:
                    p = prev[p]
                prev[i] = p
                done[i] = 1
                if p >= 0:
                    g = group[p]
                    new = len(members)
                    members.append([p])
                    up = above[g]
                    below.append(g)
                    above.append(up)
                    above[g] = new
                    if up >= 0:
                        below[up] = new
                    group[p] = new
            at = below[at]
            continue
        here = [i for i in here if group[i] == at]
        if here:
            final.append(here)
            times = {}
            for i in here:
                p = i - 1
                while done[p]:
                    p = prev[p]
                prev[i] = p
                done[i] = 1
                times[p] = times.get(p, 0) + 1
            times.pop(-1, None)
            if len(times) == 1:
                moves = [(group[p], [p]) for p in times]
            else:
                split = {}
                for p, t in times.items():
                    key = group[p], t
                    if key in split:
                        split[key].append(p)
                    else:
                        split[key] = [p]
                moves = [(key[0], split[key]) for key in sorted(split)]
            last = top = -1
            for g, moved in moves:
                if g != last:
                    top = last = g
                new = len(members)
                members.append(moved)
                up = above[top]
                below.append(top)
                above.append(up)
                above[top] = new
                if up >= 0:
                    below[up] = new
                top = new
                for p in moved:
                    group[p] = new
        at = below[at]
    # emit
    place = [0] * len(members)
    k = 0
    final.reverse()
    for here in final:
        place[group[here[0]]] = k
        k += len(here)
    order = [0] * n
    put = bytearray(n + 1)
    put[n] = 1
    j = n - 1  # the empty suffix comes first
    i = -1
    while True:
        while not put[j]:
            g = group[j]
            k = place[g]
            order[k] = j
            place[g] = k + 1
            put[j] = 1
            j = prev[j]
        i += 1
        if i >= n:
            return order
        j = order[i] - 1
