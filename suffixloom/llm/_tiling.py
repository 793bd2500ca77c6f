"""Greedy string tiling by running Karp-Rabin matching.  Plain Python for worker processes."""

from __future__ import annotations

BASE, MOD = 1_000_003, (1 << 61) - 1


def _windows(seq: list[int], marked: list[bool], size: int):
    """(position, hash) of every window of unmarked elements."""
    top = pow(BASE, size, MOD)
    h = run = 0
    for i, x in enumerate(seq):
        if marked[i]:
            h = run = 0
            continue
        h = (h * BASE + x + 1) % MOD
        run += 1
        if run > size:
            h = (h - (seq[i - size] + 1) * top) % MOD
            run = size
        if run == size:
            yield i - size + 1, h


def tiles(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping matches (pattern start, text start, length) of at least ``least`` elements, longest first."""
    pm, tm = [False] * len(pattern), [x < 0 for x in text]
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(pattern), len(text)))
    while True:
        at: dict[int, list[int]] = {}
        for i, h in _windows(text, tm, size):
            at.setdefault(h, []).append(i)
        found: list[tuple[int, int, int]] = []
        longer = 0
        for p, h in _windows(pattern, pm, size) if at else ():
            for t in at.get(h, ()):
                k = 0
                while p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] and not pm[p + k] and not tm[t + k]:
                    k += 1
                if k > 2 * size:
                    longer = max(longer, k)
                elif k >= size:
                    found.append((k, p, t))
        if longer:
            size = longer
            continue
        for k, p, t in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
            # a match that earlier marks have shortened keeps its free head
            free = 0
            while free < k and not pm[p + free] and not tm[t + free]:
                free += 1
            if free >= size:
                pm[p : p + free] = [True] * free
                tm[t : t + free] = [True] * free
                out.append((p, t, free))
        if size == least:
            return out
        size = size // 2 if size > 2 * least else least
