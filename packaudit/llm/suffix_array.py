"""Suffix arrays by linear grouping: Lyndon-prefix groups in descending order, then each group's order."""

from __future__ import annotations

import numpy as np

UNSET = -2


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of the suffixes of a sequence of positive integers in ascending order.

    First part: suffixes are grouped by their first symbol, and groups are taken from the highest
    down. For each suffix of the group, the previous-smaller pointer leads to the nearest place
    before it whose group is lower. The places pointed to continue with the group's prefix, so
    they move behind the rest of their own group, those pointed to more often further up. In the
    end a group holds the suffixes that share their longest Lyndon prefix.
    Second part: in ascending order, each suffix that is in place puts the suffixes whose Lyndon
    prefix ends where it begins next into their groups; the pointers lead from one to the other.
    Nothing is renamed and nothing recurs; every step moves a suffix once.
    """
    n = len(symbols) + 1
    text = np.zeros(n, np.int64)
    text[:-1] = symbols
    order_of = np.argsort(text, kind="stable")
    heads = np.empty(n, bool)
    heads[0] = True
    heads[1:] = text[order_of[1:]] != text[order_of[:-1]]
    starts = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    order = order_of.tolist()
    where, group = [0] * n, [0] * n
    for i, (s, g) in enumerate(zip(order, starts.tolist(), strict=True)):
        where[s], group[s] = i, g
    size = [0] * n
    for g in group:
        size[g] += 1
    previous = [UNSET] * n

    stop = n
    while stop > 0:
        start = group[order[stop - 1]]
        pointed: dict[int, int] = {}
        for i in order[start:stop]:
            p = previous[i]
            if p == UNSET:
                path, p = [i], i - 1
                while p >= 0 and group[p] >= start:
                    if previous[p] == UNSET:
                        path.append(p)
                        p -= 1
                    else:
                        p = previous[p]
                for x in path:
                    previous[x] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, k in pointed.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True) if len(by_count) > 1 else by_count:
            touched: dict[int, list[int]] = {}
            for p in by_count[k]:
                g = group[p]
                size[g] -= 1
                last, at = g + size[g], where[p]
                other = order[last]
                order[at], where[other] = other, at
                order[last], where[p] = p, last
                touched.setdefault(g, []).append(p)
            for g, moved in touched.items():
                new = g + size[g]
                size[new] = len(moved)
                if new != g:
                    for p in moved:
                        group[p] = new
        stop = start

    out, free, placed = [UNSET] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = previous[s]
    return np.array(out[1:], np.int64)


def common_prefixes(symbols: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in the suffix array."""
    n = len(symbols)
    text, order, rank, out, k = symbols.tolist(), suffixes.tolist(), [0] * n, [0] * n, 0
    for i, s in enumerate(order):
        rank[s] = i
    for s in range(n):
        r = rank[s]
        if r == 0:
            k = 0
            continue
        t = order[r - 1]
        top = n - max(s, t)
        while k < top and text[s + k] == text[t + k]:
            k += 1
        out[r] = k
        if k:
            k -= 1
    return np.array(out, np.int64)
