"""Slow reference computations for small inputs, written from the definitions."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def paths(n, m):
    """All alignments of lengths n and m as edit strings over B, X, Y."""
    if n == 0 and m == 0:
        yield ""
        return
    if n and m:
        for p in paths(n - 1, m - 1):
            yield p + "B"
    if n:
        for p in paths(n - 1, m):
            yield p + "X"
    if m:
        for p in paths(n, m - 1):
            yield p + "Y"


def hmm_posterior(a, b, model):
    """Posterior of each match by enumerating all state paths of the pair HMM."""
    k = len(model.gap_open)
    states = ["B"] + [f"X{q}" for q in range(k)] + [f"Y{q}" for q in range(k)]
    start = {"B": model.start[0]}
    for q in range(k):
        start[f"X{q}"] = model.start[2 * q + 1]
        start[f"Y{q}"] = model.start[2 * q + 2]

    def trans(s, t):
        if s == "B" and t == "B":
            return 1 - 2 * sum(model.gap_open)
        if s == "B":
            return model.gap_open[int(t[1])]
        if t == "B":
            return 1 - model.gap_extend[int(s[1])]
        return model.gap_extend[int(s[1])] if s == t else 0.0

    total, post = 0.0, np.zeros((len(a) + 1, len(b) + 1))
    for p in paths(len(a), len(b)):
        options = [[("B" if c == "B" else f"{c}{q}") for q in range(1 if c == "B" else k)] for c in p]
        stack = [(0, None, 1.0)]
        weight = 0.0
        while stack:
            pos, prev, w = stack.pop()
            if pos == len(p):
                weight += w * start[prev]
                continue
            for s in options[pos]:
                w2 = w * (start[s] if prev is None else trans(prev, s))
                if w2:
                    stack.append((pos + 1, s, w2))
        i = j = 0
        cells = []
        for c in p:
            i += c in "BX"
            j += c in "BY"
            if c == "B":
                weight *= model.match_odds[ord(a[i - 1]) - 65][ord(b[j - 1]) - 65]
                cells.append((i, j))
        total += weight
        for c in cells:
            post[c] += weight
    return np.minimum(post / total, 1.0)


def partition_posterior(a, b, model, floor):
    """Posterior of each match by enumerating all alignments with Boltzmann
    weights, free gaps at the borders, and no change between gap directions."""
    n, m = len(a), len(b)
    total, post = 0.0, np.zeros((n + 1, m + 1))
    for p in paths(n, m):
        if "XY" in p or "YX" in p:
            continue
        w, i, j, cells, prev = 1.0, 0, 0, [], ""
        for c in p:
            i += c in "BX"
            j += c in "BY"
            if c == "B":
                w *= model.boltzmann[ord(a[i - 1]) - 65][ord(b[j - 1]) - 65]
                cells.append((i, j))
            elif c == "X" and j not in (0, m) or c == "Y" and i not in (0, n):
                w *= model.partition_extend if prev == c else model.partition_open
            prev = c
        total += w
        for c in cells:
            post[c] += w
    post /= total
    post[post < floor] = 0
    return np.minimum(post, 1.0)


def best_sum(p):
    """Largest sum of cells over monotone paths."""
    n, m = p.shape[0] - 1, p.shape[1] - 1
    s = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s[i, j] = max(s[i - 1, j - 1] + p[i, j], s[i - 1, j], s[i, j - 1])
    return s[n, m]


def upgma(d, linkage="upgma"):
    """Textbook clustering; pairs in the order (larger, smaller) label, the first
    smallest wins, the larger label survives. Returns (left, right, height)."""
    n = len(d)
    d = np.array(d, dtype=float)
    alive, node, size, out = list(range(n)), list(range(n)), [1] * n, []
    for step in range(n - 1):
        best = None
        for i in alive:
            for j in alive:
                if j < i and (best is None or d[i, j] < best[0]):
                    best = (d[i, j], i, j)
        h, i, j = best
        out.append((node[i], node[j], h))
        alive.remove(j)
        for k in alive:
            if k != i:
                if linkage == "upgma":
                    v = (d[i, k] * size[i] + d[j, k] * size[j]) / (size[i] + size[j])
                elif linkage == "wpgma":
                    v = (d[i, k] + d[j, k]) / 2
                else:
                    v = min(d[i, k], d[j, k])
                d[i, k] = d[k, i] = v
        size[i] += size[j]
        node[i] = n + step
    return out


def global_score(a, b, score, gap_open, gap_extend):
    """Affine global alignment score by memoised recursion."""

    @lru_cache(None)
    def h(i, j):
        if i == 0 and j == 0:
            return 0
        if i == 0 or j == 0:
            return (max(i, j) - 1) * gap_extend + gap_open
        return max(e(i, j), f(i, j), h(i - 1, j - 1) + score[a[i - 1], b[j - 1]])

    @lru_cache(None)
    def e(i, j):
        if j == 0:
            return (i - 1) * gap_extend + gap_open
        return max(e(i, j - 1) + gap_extend, h(i, j - 1) + gap_open)

    @lru_cache(None)
    def f(i, j):
        if i == 0:
            return (j - 1) * gap_extend + gap_open
        return max(f(i - 1, j) + gap_extend, h(i - 1, j) + gap_open)

    return h(len(a), len(b))


def local_score(a, b, score, gap_open, gap_extend):
    """Affine local alignment score."""
    n, m = len(a), len(b)
    h = np.zeros((n + 1, m + 1))
    e = np.zeros((n + 1, m + 1))
    f = np.zeros((n + 1, m + 1))
    best = -math.inf
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i, j] = max(e[i, j - 1] + gap_extend, h[i, j - 1] + gap_open)
            f[i, j] = max(f[i - 1, j] + gap_extend, h[i - 1, j] + gap_open)
            h[i, j] = max(0, e[i, j], f[i, j], h[i - 1, j - 1] + score[a[i - 1], b[j - 1]])
            best = max(best, h[i, j])
    return best
