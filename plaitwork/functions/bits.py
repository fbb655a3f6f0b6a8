"""Global alignment of one pair by differences in whole numbers of as many bits as a text has symbols.

With the indices added, scores T[i][j] = S[i][j] + i + j gain 3 by a match, 1 by a mismatch and nothing by a gap, so neighbours differ by 0 to 3. A
row is three numbers h1, h2, h3: bit j says that column j + 1 is at least 1, 2, 3 above column j; v1, v2, v3 likewise say what a row is above the one before,
at bit j for column j. With z = max(step, h, v) of a cell, the new v is z - h and the new h is z - v. Only v depends on its left
neighbour, where h is 0 and the symbols differ; an addition's carry takes it over the whole row.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np

Row = tuple[int, int, int]


def masks(r: np.ndarray) -> dict[int, int]:
    """For each symbol the places where ``r`` has it, as bits."""
    kinds, out = np.unique(r), {}
    step = max(1, 4_000_000 // max(1, len(r)))
    for k in range(0, len(kinds), step):
        some = kinds[k : k + step]
        packed = np.packbits(some[:, None] == r, axis=1, bitorder="little")
        out |= {s: int.from_bytes(x.tobytes(), "little") for s, x in zip(some.tolist(), packed, strict=True)}
    return out


def flags(x: int, n: int) -> np.ndarray:
    """The lowest ``n`` bits as bytes."""
    return np.unpackbits(np.frombuffer(x.to_bytes(n // 8 + 1, "little"), np.uint8), count=n, bitorder="little")


def sweep(symbols: list[int], where: dict[int, int], n: int, row: Row = (0, 0, 0)) -> Iterator[tuple[Row, Row, int, Row]]:
    """(h before, v, match, h after) for each symbol, from the row ``row`` on; v has a bit for each of columns 0 to n."""
    full = (1 << n) - 1
    h1, h2, h3 = row
    for s in symbols:
        m = where.get(s, 0)
        h0 = h1 ^ full
        p = h0 & ~m
        v3 = (p + ((m & h0) << 1)) ^ p
        v2 = (p + (((h2 ^ full) & (m | (h1 & v3))) << 1)) ^ p
        v1 = (p | ((h3 ^ full) & (m | (h2 & v3))) | (h1 & (h2 ^ full) & v2)) << 1
        m3, m2, u1, u2 = h3 | m, h2 | m, full & ~v1, full & ~v2
        new = u1 | (m2 & u2) | (m3 & ~v3), (m3 & u2) | (m2 & u1), m3 & u1
        yield (h1, h2, h3), (v1, v2, v3), m, new
        h1, h2, h3 = new


def total(row: Row) -> int:
    """The sum of a row's differences."""
    return sum(x.bit_count() for x in row)


def last_row(q: np.ndarray, where: dict[int, int], n: int) -> Row:
    row = (0, 0, 0)
    for _, _, _, row in sweep(q.tolist(), where, n):
        pass
    return row


def score(q: np.ndarray, r: np.ndarray) -> int:
    # The score is the same with the sides changed; a wider row costs less than more rows.
    q, r = (r, q) if len(q) > len(r) else (q, r)
    return total(last_row(q, masks(r), len(r))) - len(q) - len(r)


def last_column(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Scores of every query prefix, the empty one first, with the whole ref."""
    row = last_row(r, masks(q), len(q))
    return np.r_[0, np.cumsum(sum(flags(x, len(q)).astype(np.int32) for x in row))] - np.arange(len(q) + 1) - len(r)


def cells(q: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of the cells (i[k], j[k]), by one sweep over the query; ``i`` in any order."""
    out, order = [0] * len(i), np.argsort(i, kind="stable")
    at = np.searchsorted(i[order], np.arange(len(q) + 2)).tolist()
    order, columns = order.tolist(), j.tolist()
    # T on row 0 is 0 everywhere.
    for k, (_, _, _, (h1, h2, h3)) in enumerate(sweep(q.tolist(), masks(r), len(r)), 1):
        for c in order[at[k] : at[k + 1]]:
            low = (1 << columns[c]) - 1
            out[c] = (h1 & low).bit_count() + (h2 & low).bit_count() + (h3 & low).bit_count()
    return np.array(out, np.int64) - i - j


#: Bits of rows that a trace holds at once; of a longer pair only some rows are kept, and those between are made again.
HELD = 16_000_000


def trace(q: np.ndarray, r: np.ndarray, up_first: bool, held: int = HELD) -> tuple[int, bytes]:
    """(score, steps) of one best path from its end, ties diagonal, up, left, or with ``up_first`` up, diagonal, left.

    Past ``held`` bits, rows are kept at every so many only, about the root of their number; what is between them is made again, from the last part to
    the first.
    """
    m, n, symbols, where = len(q), len(r), q.tolist(), masks(r)
    part = max(m, 1) if 4 * m * n <= held else isqrt(m) + 1
    kept, best = [(0, 0, 0)], None
    if part < m:
        for k, (_, _, _, row) in enumerate(sweep(symbols, where, n), 1):
            if k % part == 0:
                kept.append(row)
    i, j, made = m, n, bytearray()
    while i > 0 and j > 0:
        first = (i - 1) // part * part
        rows = []
        for (_, h2, _), (v1, v2, _), match, row in sweep(symbols[first:i], where, n, kept[first // part]):
            # A diagonal is best where symbols match, or neither neighbour is above 1; the one above is where v is 0.
            rows.append((match, match | ~(h2 | v2), v1))
        best = total(row) if best is None else best
        while i > first and j > 0:
            match, diagonal, v1 = rows[i - first - 1]
            up = not v1 >> j & 1
            if diagonal >> (j - 1) & 1 and not (up_first and up):
                made.append(61 if match >> (j - 1) & 1 else 88)  # = or X
                i, j = i - 1, j - 1
            elif up:
                made.append(73)  # I
                i -= 1
            else:
                made.append(68)  # D
                j -= 1
    return (best or 0) - m - n, bytes(made[::-1].rjust(len(made) + i, b"I").rjust(len(made) + i + j, b"D"))
