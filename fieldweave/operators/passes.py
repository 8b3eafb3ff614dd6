"""Offsets of the passes of a long field, without a dense matrix of its passes.

Unknowns x and equations A x = b + e, of which each names a pass and the few beside it, stand in one
symmetric system, [[I, A], [A', -r I]] (e; x) = (b; 0), that has an entry where A has one.  Ordered by
their distance from one end of a field, its rows fall into blocks that touch only the next, and a border
of the few passes that lie beside very many others.  Elimination block by block gives x, and the same
blocks backwards the trace of (A'A + r I)^-1, both to rounding: memory grows with the passes of a field
times the width of a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Rows of a block at least (more where a field is wide), and how many times the mean of neighbours puts a row in the border.
BLOCK, BORDER = 32, 8


def _levels(ends: np.ndarray, other: np.ndarray, inner: np.ndarray) -> list[np.ndarray]:
    """The inner vertices in blocks of whole levels of a breadth-first search from an end of each component."""
    order = np.argsort(ends, kind="stable")
    start = np.searchsorted(ends[order], np.arange(len(inner) + 1)).tolist()
    to, seen = other[order].tolist(), (~inner).tolist()

    def search(seed: int, done: list[bool]) -> list[list[int]]:
        done[seed], levels = True, [[seed]]
        while levels[-1]:
            levels.append([])
            for v in levels[-2]:
                for u in to[start[v] : start[v + 1]]:
                    if not done[u]:
                        done[u] = True
                        levels[-1].append(u)
        return levels[:-1]

    far, blocks, now = list(seen), [], []
    for seed in np.flatnonzero(inner).tolist():
        if seen[seed]:
            continue
        for level in search(search(seed, far)[-1][0], seen):
            now += level
            if len(now) >= BLOCK:
                blocks.append(np.array(now))
                now = []
    return blocks + [np.array(now)] if now else blocks


def system(n: int, used: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, b: np.ndarray) -> Callable[[float], tuple[np.ndarray, np.ndarray, float]]:
    """r to (x, b - A x, trace of (A'A + r I)^-1), where equation k has 1 at pass used[k] and -w at the passes beside it.

    i: the pass of each share w, j: the pass beside it.
    """
    row = np.full(n, -1)
    row[used] = n + np.arange(len(used))
    p, q, v = np.concatenate([row[used], row[i]]), np.concatenate([used, j]), np.concatenate([np.ones(len(used)), -w])
    ends, other, value, size = np.concatenate([p, q]), np.concatenate([q, p]), np.concatenate([v, v]), n + len(used)
    degree = np.bincount(ends, minlength=size)
    inner = degree <= BORDER * max(degree.mean(), 2.0)
    blocks, border = _levels(ends, other, inner), np.flatnonzero(~inner)
    count = len(blocks)
    number, place = np.full(size, count), np.zeros(size, int)
    for k, mine in enumerate([*blocks, border]):
        number[mine], place[mine] = k, np.arange(len(mine))
    of, to = number[ends], number[other]
    widths = [len(m) for m in blocks] + [len(border)]

    def dense(which: np.ndarray, step: int | None) -> list[np.ndarray]:
        """One matrix for each block: its entries with the block step further on, or with the border."""
        e = np.flatnonzero(which)
        e = e[np.argsort(of[e], kind="stable")]
        cut = np.searchsorted(of[e], np.arange(count + 2))
        out = []
        for k in range(count + 1):
            m = np.zeros((widths[k], widths[count if step is None else min(k + step, count)]))
            mine = e[cut[k] : cut[k + 1]]
            m[place[ends[mine]], place[other[mine]]] = value[mine]
            out.append(m)
        return out

    own, after, beyond = dense(of == to, 0), dense((to == of + 1) & (to < count), 1), dense((to == count) & (of < count), None)
    is_x = [m < n for m in [*blocks, border]]
    rhs = np.zeros(size)
    rhs[n:] = b

    def solve(r: float) -> tuple[np.ndarray, np.ndarray, float]:
        plain = lambda k: own[k] + np.diag(np.where(is_x[k], -r, 1.0))
        inverse, edge, given = [], [], []
        last, f_last = plain(count), rhs[border].copy()
        for k in range(count):
            d, c, f = plain(k), beyond[k], rhs[blocks[k]]
            if k:
                back = after[k - 1].T @ inverse[-1]
                d, c, f = d - back @ after[k - 1], c - back @ edge[-1], f - back @ given[-1]
            s = np.linalg.inv(d)
            last, f_last = last - c.T @ s @ c, f_last - c.T @ (s @ f)
            inverse.append((s + s.T) / 2)
            edge.append(c)
            given.append(f)
        out, bb = np.zeros(size), np.linalg.inv(last)
        out[border] = x_border = bb @ f_last
        trace = -bb.diagonal()[is_x[count]].sum()
        for k in range(count - 1, -1, -1):
            s = inverse[k]
            gc, whole = s @ edge[k], s @ given[k]
            whole = whole - gc @ x_border
            kk, kb = s + gc @ bb @ gc.T, -gc @ bb
            if k < count - 1:
                gu = s @ after[k]
                whole = whole - gu @ out[blocks[k + 1]]
                mixed = gu @ nb @ gc.T
                kk, kb = kk + gu @ nn @ gu.T + mixed + mixed.T, kb - gu @ nb
            out[blocks[k]], nn, nb = whole, kk, kb
            trace -= kk.diagonal()[is_x[k]].sum()
        return out[:n], out[n:], float(trace)

    return solve
