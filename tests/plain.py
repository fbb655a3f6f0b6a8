"""The recurrences as plain loops, for comparison."""

import numpy as np


def matrix(q, r, local, exists=lambda i, j: True):
    h = [[0] * (len(r) + 1) for _ in range(len(q) + 1)]
    if not local:
        h[0] = [-j for j in range(len(r) + 1)]
        for i in range(len(q) + 1):
            h[i][0] = -i
    for i in range(1, len(q) + 1):
        for j in range(1, len(r) + 1):
            if not exists(i - 1, j - 1):
                continue
            best = max(h[i - 1][j - 1] + (1 if q[i - 1] == r[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            h[i][j] = max(best, 0) if local else best
    return h


def sw(q, r):
    return max(map(max, matrix(q, r, True)))


def banded(q, r, band):
    return max(map(max, matrix(q, r, True, lambda i, j: 0 <= j - i < band)))


def nw(q, r):
    return matrix(q, r, False)[-1][-1]


def argmax(q, r):
    h = matrix(q, r, True)
    best = (0, 0, 0)
    for i in range(1, len(q) + 1):
        for j in range(1, len(r) + 1):
            if h[i][j] > best[0]:
                best = (h[i][j], i - 1, j - 1)
    return best


def path(q, r):
    f, s = matrix(q, r, False), matrix(q[::-1], r[::-1], False)
    best = f[-1][-1]
    return [next(i for i in range(len(q) + 1) if f[i][j] + s[len(q) - i][len(r) - j] == best) for j in range(len(r))]


def trace(q, r):
    """(score, steps, smallest query index by ref column) of the traced path, ties diagonal, up, left."""
    h, i, j, steps, at = matrix(q, r, False), len(q), len(r), "", [None] * len(r)
    while i or j:
        same = i and j and q[i - 1] == r[j - 1]
        if i and j and h[i][j] == h[i - 1][j - 1] + (1 if same else -1):
            i, j, steps = i - 1, j - 1, ("=" if same else "X") + steps
        elif i and (not j or h[i][j] == h[i - 1][j] - 1):
            i, steps = i - 1, "I" + steps
        else:
            j, steps = j - 1, "D" + steps
        if j < len(r):
            at[j] = i
    return h[-1][-1], steps, at


def check(q, r, path):
    """(valid, bad_ref, bad_query, point_count, score, number of the error or -1)"""
    f, s = matrix(q, r, False), matrix(q[::-1], r[::-1], False)
    best, score, points, last_i, last_j = f[-1][-1], 0, 0, 0, 0
    for j, i in enumerate(path):
        if i == -1:
            continue
        if not 0 <= i <= len(q) or i < last_i:
            return False, j, i, points, score, 0
        if f[i][j] + s[len(q) - i][len(r) - j] != best:
            return False, j, i, points, score, 1
        score += nw(q[last_i:i], r[last_j:j])
        if score != f[i][j]:
            return False, j, i, points, score, 2
        points, last_i, last_j = points + 1, i, j
    score += nw(q[last_i:], r[last_j:])
    return (True, -1, -1, points, score, -1) if score == best else (False, len(r), len(q), points, score, 3)


def chain(x, y, lookback):
    f = []
    for i in range(len(x)):
        best = 15
        for j in range(max(0, i - lookback), i):
            dx, dy = x[i] - x[j], y[i] - y[j]
            if dx > 0 and dy > 0:
                cost = int(np.float32(0.01) * np.float32(15) * np.float32(abs(dy - dx)))
                best = max(best, f[j] + min(dx, dy, 15) - cost)
        f.append(best)
    return f
