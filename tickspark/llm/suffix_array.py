"""Suffix arrays by linear grouping, for many short texts at once.

For each text, first the suffixes are put into groups by their longest Lyndon prefix: groups start as the first
characters and are taken from the highest down; each suffix of the group in hand finds the nearest suffix before it that is
in a lower group, and the suffixes so found move, by how often they are found, into new groups directly above their old
one. Then the order within the groups is read off: from the lowest suffix on, the suffix before each one, and along its
previous-smaller pointers those before it, take the next place of their group. No text is renamed or sorted recursively.

A step is the same for every text, so the steps of all texts of a batch are taken together, as array operations.
"""

from __future__ import annotations

import numpy as np


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each span, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def suffix_arrays(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffix arrays of texts that lie one after the other in ``text``, as places in it.

    Each text must end with a character that is lower than all its others. size: the length of each text, over 0.
    """
    n = len(text)
    off = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    occ = np.lexsort((text, owner))  # slot to suffix; a group is a span of slots
    code, own = text[occ], owner[occ]
    new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (own[1:] != own[:-1])])
    width = np.diff(np.r_[new, n])
    group = np.empty(n, np.int64)  # suffix to the first slot of its group
    group[occ] = np.repeat(new, width)
    slot = np.empty(n, np.int64)
    slot[occ] = np.arange(n)
    many = np.zeros(n + 1, np.int64)  # first slot to the size of the group
    many[new] = width
    below = np.zeros(n + 1, np.int64)  # end of a group to its first slot
    below[new + width] = new
    prev = np.full(n, -1, np.int64)
    moved = np.zeros(n, bool)
    first_of = off[owner]
    now = below[off + size]
    base = off
    while len(now):
        count = many[now]
        suffix = occ[_spans(now, count)]
        mine = np.repeat(now, count)
        p = np.where(suffix == first_of[suffix], -1, suffix - 1)
        prev[suffix] = p
        open_ = np.flatnonzero((p >= 0) & (group[p] >= mine))
        while len(open_):
            q = prev[p[open_]]
            p[open_] = q
            prev[suffix[open_]] = q
            open_ = open_[(q >= 0) & (group[q] >= mine[open_])]
        found, times = np.unique(p[p >= 0], return_counts=True)
        if len(found):
            old = group[found]
            order = np.lexsort((times, old))
            found, times, old = found[order], times[order], old[order]
            head = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
            cnt = np.diff(np.r_[head, len(old)])
            g = old[head]
            cut = g + many[g] - cnt  # the found suffixes take the last slots of their group
            place = _spans(cut, cnt)
            moved[found] = True
            there = occ[place]
            there = there[~moved[there]]
            free = slot[found][slot[found] < np.repeat(cut, cnt)]
            occ[free], slot[there] = there, free
            occ[place], slot[found] = found, place
            moved[found] = False
            many[g] -= cnt
            rest = many[g] > 0
            below[cut[rest]] = g[rest]
            part = np.flatnonzero(np.r_[True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])])
            size_of = np.diff(np.r_[part, len(old)])
            start = place[part]
            many[start] = size_of
            below[start + size_of] = start
            group[found] = np.repeat(start, size_of)
        more = now > base
        now, base = below[now[more]], base[more]
    # Second phase: places within the groups.
    out = np.full(n, -1, np.int64)
    out[off] = off + size - 1
    done = np.zeros(n, bool)
    done[off + size - 1] = True
    nxt = np.arange(n)
    longest = np.argsort(-size, kind="stable")
    at, length = off[longest], size[longest]
    for i in range(int(length[0]) if len(length) else 0):
        live = np.searchsorted(-length, -i, side="left")  # texts longer than i
        s = out[at[:live] + i]
        s = np.where(s == at[:live], -1, s - 1)
        s = s[s >= 0]
        s = s[~done[s]]
        while len(s):
            g = group[s]
            out[nxt[g]] = s
            nxt[g] += 1
            done[s] = True
            s = prev[s]
            s = s[s >= 0]
            s = s[~done[s]]
    return out
