"""Linear suffix sorting by Lyndon groups, for sequences of whole numbers."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of `text` in lexicographic order; a suffix that begins another stands before it.

    Grouping: suffixes start in groups by first symbol, and groups are taken in descending order. Each member of the taken group
    finds the nearest earlier suffix of a lower group (its previous smaller one) along pointers already set. The prefix of a
    suffix so found grows by the group's prefix, once per member that points at it, so it moves to a new group right above its old
    one, more repeats higher. In the end each group holds the suffixes of one Lyndon prefix.

    Order: the array is read from its smallest suffix on while it fills. For each suffix met, the suffix one symbol
    longer, and then those along the pointers, take the next free place of their groups until one has been placed before."""
    if not text:
        return []
    text = [*text, min(text) - 1]  # the end is smaller than any symbol
    n = len(text)
    starts: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        starts.setdefault(c, []).append(i)
    members = [set(starts[c]) for c in sorted(starts)]
    up, down = [g + 1 for g in range(len(members))], [g - 1 for g in range(len(members))]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    taken, pointer = [False] * n, [-1] * n
    falling: list[int] = []
    g = len(members) - 1
    up[g] = -1
    while g >= 0:
        own = sorted(members[g])
        falling.append(g)
        for i in own:
            taken[i] = True
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and taken[j]:
                j = pointer[j]
            pointer[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, t in times.items():
            moves.setdefault((-t, group[j]), []).append(j)
        for t, old in sorted(moves):  # most repeats first: what comes later goes below them
            moved, new = moves[t, old], len(members)
            members.append(set(moved))
            members[old].difference_update(moved)
            above = up[old]
            up.append(above)
            down.append(old)
            up[old] = new
            down[above] = new
            for j in moved:
                group[j] = new
        g = down[g]
    place, total = [0] * len(members), 0
    for g in reversed(falling):
        place[g] = total
        total += len(members[g])
    out, placed = [-1] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            out[place[group[j]]] = j
            place[group[j]] += 1
            placed[j] = True
            j = pointer[j]
    return out[1:]
