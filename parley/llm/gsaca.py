"""Suffix array by grouping, in linear time and without renaming (Baier's construction).

The suffixes start grouped by first symbol. Groups are taken from the highest to the lowest. For each suffix of the group
the nearest earlier suffix in a lower group (its previous-smaller pointer) is found; those earlier suffixes have the
group's prefix right behind their own and so leave their groups for new ones just above, the more repetitions the higher.
At the end each group holds the suffixes with one Lyndon prefix. Then the order is emitted: going up the array, the suffixes
whose Lyndon prefix ends where the current one starts are appended to their groups, following the pointers.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of ``text`` (integers of any size), as start positions."""
    n = len(text)
    if not n:
        return []
    # position n is the end mark, below every symbol
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    members = [[n], *(first[c] for c in sorted(first))]
    group = [0] * (n + 1)
    place = [0] * (n + 1)
    for g, m in enumerate(members):
        for k, i in enumerate(m):
            group[i] = g
            place[i] = k
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    done = bytearray(n + 1)
    before = [-1] * (n + 1)

    g = len(members) - 1
    while g > 0:
        mine = members[g]
        mine.sort()
        for k, i in enumerate(mine):
            place[i] = k
            done[i] = 1
        count: dict[int, int] = {}
        for i in mine:
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            before[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            split: dict[int, dict[int, list[int]]] = {}
            for p, c in count.items():
                split.setdefault(group[p], {}).setdefault(c, []).append(p)
            for old, parts in split.items():
                left = members[old]
                if len(parts) == 1 and len(next(iter(parts.values()))) == len(left):
                    continue  # the whole group moves: it stays one group
                at = old
                for c in sorted(parts):
                    new = len(members)
                    for k, p in enumerate(parts[c]):
                        last = left.pop()
                        if last != p:
                            left[place[p]] = last
                            place[last] = place[p]
                        group[p] = new
                        place[p] = k
                    members.append(parts[c])
                    up = above[at]
                    below.append(at)
                    above.append(up)
                    above[at] = new
                    if up >= 0:
                        below[up] = new
                    at = new
                if not left:
                    lo, hi = below[old], above[old]
                    above[lo] = hi
                    below[hi] = lo
        g = below[g]

    start = [0] * len(members)
    g, total = 0, 0
    while g >= 0:
        start[g] = total
        total += len(members[g])
        g = above[g]
    order = [-1] * (n + 1)
    order[0] = n
    placed = bytearray(n + 1)
    placed[n] = 1
    for k in range(n + 1):
        s = order[k] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            order[start[g]] = s
            start[g] += 1
            placed[s] = 1
            s = before[s]
    return order[1:]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Length of the common prefix of each suffix with the one before it in the order (0 for the first)."""
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    out = [0] * n
    h = 0
    for i in range(n):
        k = rank[i]
        if k:
            j = order[k - 1]
            most = n - (i if i > j else j)
            while h < most and text[i + h] == text[j + h]:
                h += 1
            out[k] = h
            if h:
                h -= 1
        else:
            h = 0
    return out
