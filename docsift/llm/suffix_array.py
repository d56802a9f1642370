"""Linear suffix sorting by grouping: the suffix array without recursive renaming."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Places of all suffixes in sorted order. ``text``: values from 0, the last one 0 and nowhere else.

    First, suffixes are grouped by their Lyndon prefix. They begin grouped by their first value. From the highest group
    down, every suffix of the group finds the nearest place before it that lies in a lower group (its previous smaller
    suffix); the prefix found there is lengthened by the group's, as often as suffixes of the group point to it, so it
    moves to a new group directly above its own, the more often the higher.

    Then the order within the groups is emitted: going through the suffix array from its beginning, each suffix puts the
    one before it, and those which the pointers lead to, on the next free place of their groups.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    rank = [0] * n
    start = [0] * n  # where the group of a suffix begins in the order
    size = [0] * n  # by the begin of a group
    head = 0
    for i, place in enumerate(order):
        if text[place] != text[order[head]]:
            head = i
        rank[place] = i
        start[place] = head
        size[head] += 1

    before = [-1] * n
    end = n
    while end > 0:
        low = start[order[end - 1]]
        pointed: dict[int, int] = {}
        for place in sorted(order[low:end]) if end - low > 1 else order[low:end]:
            p = place - 1
            while p >= 0 and start[p] >= low:
                p = before[p]
            before[place] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = low
        moves: dict[tuple[int, int], list[int]] = {}
        for p, times in pointed.items():
            moves.setdefault((times, start[p]), []).append(p)
        for times, group in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            members = moves[times, group]
            left = size[group] - len(members)
            tail = group + size[group]
            new = group + left
            for p in members:
                tail -= 1
                other, at = order[tail], rank[p]
                order[at], rank[other] = other, at
                order[tail], rank[p] = p, tail
                start[p] = new
            size[group] = left
            size[new] = len(members)

    out = [-1] * n
    free = list(range(n))  # next free place, by the begin of a group
    out[0] = n - 1
    start[n - 1] = -1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and start[p] >= 0:
            group = start[p]
            out[free[group]] = p
            free[group] += 1
            start[p] = -1
            p = before[p]
    return out
