"""The recurrences, for a lot of pairs or chains at once.

A lot is a pair of code matrices, a column for each pair. Scores and matrices go by anti-diagonals: all cells of one
depend on the two before only, so one numpy step advances all pairs by a diagonal, in 16 bits where scores fit. Lots hold
pairs of like lengths on both sides and are bounded by the longer side, so that they stay in a core's cache. Single
long pairs go by rows, where the dependence on the left neighbour is a running maximum: with t[j] the best of the two cells
above, H[j] = max over k <= j of (t[k] + k), minus j.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from plaitwork.functions import bits

#: Fixed values of the scoring scheme.
MATCH, MISMATCH, GAP = 1, -1, 1
#: Fixed values of the chaining scheme; the gap weight is a 32-bit float.
ANCHOR_SCORE, GAP_WEIGHT = 15, np.float32(0.01)

#: Values a side of a lot: pairs times the longer length. Matrices of a lot have as many cells at most.
LOT_CELLS, MATRIX_CELLS = 250_000, 2_000_000

#: Symbols of a side from which a pair's global scores, and cells from which its paths, go by bits of its own (``functions.bits``).
WIDE, TRACED = 256, 2_500


def codes(text: str | bytes | None) -> np.ndarray:
    """Symbols of a text: code points of a string, bytes of a binary."""
    if text is None:
        return np.empty(0, np.int32)
    return np.frombuffer(text, np.uint8).astype(np.int32) if isinstance(text, (bytes, bytearray)) else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


class Texts:
    """Many texts' symbols in one array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.sizes = flat, sizes.astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of(cls, values: Texts | list) -> Texts:
        """From strings, binaries or arrays of symbols."""
        if isinstance(values, Texts):
            return values
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        if all(isinstance(x, str) for x in values):
            return cls(codes("".join(values)), sizes)
        if all(isinstance(x, (bytes, bytearray)) for x in values):
            return cls(codes(b"".join(values)), sizes)
        return cls(np.concatenate([np.empty(0, np.int32), *values]).astype(np.int32), sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.flat[self.starts[k] : self.starts[k] + self.sizes[k]]

    def columns(self, own: np.ndarray, pad: int) -> np.ndarray:
        """The texts at ``own`` as columns, padded at the end."""
        size = self.sizes[own]
        at = np.arange(size.max())[:, None]
        if not len(self.flat):
            return np.full((len(at), len(own)), pad, np.int32)
        return np.where(at < size, self.flat[np.minimum(self.starts[own] + at, len(self.flat) - 1)], np.int32(pad))

    def turned(self) -> Texts:
        """Each text reversed."""
        return self.slices(np.arange(len(self)), np.zeros(len(self), np.int64), self.sizes, True)

    def slices(self, which: np.ndarray, lo: np.ndarray, hi: np.ndarray, turn: bool = False) -> Texts:
        """Text ``which[k]`` from ``lo[k]`` to ``hi[k]``, for every k."""
        size = hi - lo
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        first = self.starts[which] + lo
        return Texts(self.flat[np.repeat(first + size - 1, size) - at if turn else np.repeat(first, size) + at], size)


Lot = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _cut(queries: Texts, refs: Texts, count: Callable[[int, int], int]) -> Iterator[np.ndarray]:
    """Places of pairs whose lengths are alike on both sides, ``count(m, n)`` at a time.

    Few pairs share a lot more freely: a step over a narrow lot costs more than the padding of a wider one.
    """
    m, n = queries.sizes, refs.sizes
    ratio = 1.25 if len(m) >= 4_096 else 2.0 if len(m) >= 1_000 else 3.0
    kind = np.floor(np.log(np.c_[m, n] + 1) / np.log(ratio)).astype(np.int64)
    order = np.lexsort((m, n, kind[:, 0], kind[:, 1]))
    for own in np.split(order, np.flatnonzero((np.diff(kind[order], axis=0) != 0).any(axis=1)) + 1):
        if len(own):
            step = max(1, count(int(m[own].max()), int(n[own].max())))
            yield from (own[k : k + step] for k in range(0, len(own), step))


def lots(queries: Texts | list, refs: Texts | list, most: int | None = None, cells: bool = False) -> Iterator[Lot]:
    """(places, Q, R, query lengths, ref lengths), Q and R padded by -1 and -2; ``cells``: bounded by whole matrices."""
    queries, refs = Texts.of(queries), Texts.of(refs)
    most = most or (MATRIX_CELLS if cells else LOT_CELLS)
    size = (lambda m, n: (m + 1) * (n + 1)) if cells else (lambda m, n: max(m, n) + 1)
    for own in _cut(queries, refs, lambda m, n: most // size(m, n)):
        yield own, queries.columns(own, -1), refs.columns(own, -2), queries.sizes[own], refs.sizes[own]


def diagonals(q: np.ndarray, r: np.ndarray, local: bool, band: int | None = None, edges: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(d, lo, hi, h) for d = 0, 1, ...: h[i] is cell (i, d - i) of all pairs for lo <= i <= hi; h is valid until the next.

    With ``band``, only inner cells with 0 <= j - i < band exist, others read as 0, and lo to hi are those that exist. ``edges``: row 0
    and column 0 of all pairs, of the type that the cells get.
    """
    (m, count), n = q.shape, len(r)
    kind = edges[0].dtype.type if edges is not None else np.int16 if 2 * (m + n) < 30_000 else np.int32
    before, last, new = (np.zeros((m + 1, count), kind) for _ in range(3))
    equal, step, turned = np.empty((m, count), bool), np.empty((m, count), kind), r[::-1]
    if edges is not None:
        new[0] = edges[0][0]
    yield 0, 0, 0, new
    for d in range(1, m + n + 1):
        before, last, new = last, new, before
        lo, hi = max(1, d - n), min(m, d - 1)
        if band is not None:
            lo, hi = max(lo, (d - band) // 2 + 1), min(hi, d // 2)
            if lo > hi:
                new[:] = 0
                continue
        if lo <= hi:
            same = np.equal(q[lo - 1 : hi], turned[n - d + lo : n - d + hi + 1], out=equal[: hi - lo + 1])
            diagonal, h = step[: hi - lo + 1], new[lo : hi + 1]
            # Gaps cost what a mismatch does: all three ways lose 1, and a match then wins 2.
            np.multiply(same.view(np.int8), np.int8(MATCH - MISMATCH), out=diagonal, casting="unsafe")
            diagonal += before[lo - 1 : hi]
            np.maximum(last[lo - 1 : hi], last[lo : hi + 1], out=h)
            np.maximum(h, diagonal, out=h)
            h -= kind(GAP)
            if local:
                np.maximum(h, 0, out=h)
        if band is not None:
            new[max(0, lo - 2) : lo] = 0
            new[hi + 1 : hi + 3] = 0
            yield d, lo, hi, new
            continue
        if d <= n:
            new[0] = edges[0][d] if edges is not None else 0 if local else -d * GAP
        if d <= m:
            new[d] = edges[1][d] if edges is not None else 0 if local else -d * GAP
        yield d, max(0, d - n), min(m, d), new


def rows(q: np.ndarray, r: np.ndarray, local: bool) -> Iterator[np.ndarray]:
    """Rows 0, 1, ... of one pair's matrix."""
    step = np.arange(len(r) + 1, dtype=np.int32) * GAP
    h = np.zeros(len(r) + 1, np.int32) if local else -step
    yield h
    for i in range(len(q)):
        h = _next_row(h, q[i], r, i + 1, local, step)
        yield h


def _next_row(h: np.ndarray, symbol: int, r: np.ndarray, i: int, local: bool, step: np.ndarray) -> np.ndarray:
    t = np.empty_like(h)
    t[0] = 0 if local else -i * GAP
    np.maximum(h[:-1] + np.where(r == symbol, np.int32(MATCH), np.int32(MISMATCH)), h[1:] - GAP, out=t[1:])
    if local:
        np.maximum(t, 0, out=t)
    return np.maximum.accumulate(t + step) - step


def tile(q: np.ndarray, r: np.ndarray, top: np.ndarray, left: np.ndarray, local: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(bottom, right, best) of a rectangle of a pair's matrix, from the row above it and the column before it.

    Borders have the corner in front: ``top[0]`` is ``left[0]``. best is the largest cell inside, or the last one of an empty rectangle.
    """
    h, step = top.astype(np.int64), np.arange(len(r) + 1, dtype=np.int64) * GAP
    right, best = np.empty(len(q) + 1, np.int64), int(h[-1])
    right[0] = h[-1]
    for i in range(len(q)):
        t = np.empty_like(h)
        t[0] = left[i + 1]
        np.maximum(h[:-1] + np.where(r == q[i], MATCH, MISMATCH), h[1:] - GAP, out=t[1:])
        if local:
            np.maximum(t, 0, out=t)
        h = np.maximum.accumulate(t + step) - step
        right[i + 1] = h[-1]
        if len(r):
            best = max(best, int(h[1:].max()))
    return h, right, best


Borders = tuple[np.ndarray, np.ndarray, np.ndarray]


def tiles(queries: Texts, refs: Texts, top: Borders | None, left: Borders | None, local: bool) -> tuple[tuple, tuple, np.ndarray, np.ndarray]:
    """(bottom, right, best, corner) of many tiles, lots at a time: ``bottom`` and ``right`` are (values one after another, sizes).

    A border is (values, where each tile's begin, first): -1 for a tile at the matrix's own edge, which in a global matrix falls from ``first`` by gaps
    and in a local one is 0; None is that edge for all. best is the largest cell, corner the last one; best counts in local matrices only.
    """
    m, n = queries.sizes, refs.sizes
    best, corner = np.zeros((2, len(m)), np.int64)
    ends = [np.cumsum(x + 1) - x - 1 for x in (n, m)]
    bottom, right = np.empty((n + 1).sum(), np.int64), np.empty((m + 1).sum(), np.int64)

    def edge(border: Borders | None, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        at = np.arange(sizes.max() + 1)[:, None]
        if border is None:
            return np.zeros((len(at), len(own)), np.int64)
        flat, starts, first = border
        free = np.zeros((len(at), 1), np.int64) if local else first[own] - at * GAP
        if not len(flat):
            return np.broadcast_to(free, (len(at), len(own)))
        known = flat[np.minimum(np.maximum(starts[own], 0) + np.minimum(at, sizes), len(flat) - 1)]
        return np.where(starts[own] >= 0, known, free)

    for own, q, r, mm, nn in lots(queries, refs):
        tops, lefts = edge(top, own, nn), edge(left, own, mm)
        # Cells of a global matrix count from the corner, those of a local one from zero.
        base = np.zeros(len(own), np.int64) if local else tops[0].copy()
        tops, lefts = tops - base, lefts - base
        high = max(int(np.abs(tops).max()), int(np.abs(lefts).max())) + len(q) + len(r) + 1
        kind = np.int16 if high < 30_000 else np.int32 if high < 2**31 - 1 else np.int64
        low, side, k = np.zeros((len(r) + 1, len(own)), kind), np.zeros((len(q) + 1, len(own)), kind), np.arange(len(own))
        largest = np.full((len(q) + 1, len(own)), 0, kind)
        even = bool((mm == len(q)).all() and (nn == len(r)).all())
        for d, lo, hi, h in diagonals(q, r, local, edges=(tops.astype(kind), lefts.astype(kind))):
            if local:
                np.maximum(largest[lo : hi + 1], h[lo : hi + 1], out=largest[lo : hi + 1])
            if even:
                if d >= len(q):
                    low[d - len(q)] = h[len(q)]
                if d >= len(r):
                    side[d - len(r)] = h[d - len(r)]
                continue
            c = k[(d >= mm) & (d - mm <= nn)]
            low[d - mm[c], c] = h[mm[c], c]
            c = k[(d >= nn) & (d - nn <= mm)]
            side[d - nn[c], c] = h[d - nn[c], c]
        best[own], corner[own] = largest.max(axis=0) + base, low[nn, k] + base
        for out, first, made, size in ((bottom, ends[0], low, nn), (right, ends[1], side, mm)):
            at = np.arange(len(made))[:, None]
            there = at <= size
            out[(first[own] + at)[there]] = (made + base)[there]
    return (bottom, n + 1), (right, m + 1), best, corner


def strips(queries: Texts | list, refs: Texts | list, width: int, suffix: bool = False, most: int = MATRIX_CELLS) -> Iterator[tuple[int, int, np.ndarray]]:
    """(place, i, row) for each row i of each pair's global matrix, or suffix matrix.

    Pairs of up to ``most`` cells go by whole matrices in lots; of longer ones only a row is held at a time, and ``row`` comes in parts of
    ``width`` cells, in order.
    """
    queries, refs = Texts.of(queries), Texts.of(refs)
    large = (queries.sizes + 1) * (refs.sizes + 1) > most
    at = np.flatnonzero(~large)
    some = [x.slices(at, np.zeros(len(at), np.int64), x.sizes[at]) for x in (queries, refs)]
    for own, q, r, m, n in lots(*([x.turned() for x in some] if suffix else some), most=min(most, MATRIX_CELLS), cells=True):
        made = matrices(q, r)
        for k, place in enumerate(own):
            grid = made[: m[k] + 1, : n[k] + 1, k].astype(np.int32)
            grid = grid[::-1, ::-1] if suffix else grid
            for i in range(m[k] + 1):
                yield int(at[place]), i, grid[i]
    for place in np.flatnonzero(large):
        q, r = queries[place], refs[place]
        for i, h in enumerate(rows(q[::-1], r[::-1], False) if suffix else rows(q, r, False)):
            yield int(place), len(q) - i if suffix else i, h[::-1] if suffix else h


def _best(queries: Texts | list, refs: Texts | list, band: int | None = None) -> np.ndarray:
    out = np.zeros(len(queries), np.int32)
    for own, q, r, _, _ in lots(queries, refs):
        best = None
        for _, lo, hi, h in diagonals(q, r, True, band):
            best = np.zeros_like(h) if best is None else best
            np.maximum(best[lo : hi + 1], h[lo : hi + 1], out=best[lo : hi + 1])
        out[own] = best.max(axis=0)
    return out


def local_scores(queries: Texts | list, refs: Texts | list) -> np.ndarray:
    return _best(queries, refs)


def local_scores_by_rows(queries: Texts | list, refs: Texts | list) -> np.ndarray:
    """The same scores, pair by pair and row by row."""
    queries, refs = Texts.of(queries), Texts.of(refs)
    return np.array([max(int(h.max()) for h in rows(queries[k], refs[k], True)) for k in range(len(queries))], np.int32)


def banded_scores(queries: Texts | list, refs: Texts | list, band: int) -> np.ndarray:
    """Local scores where only cells with 0 <= j - i < band exist, and all others read as 0."""
    return _best(queries, refs, band)


def local_argmax(queries: Texts | list, refs: Texts | list) -> np.ndarray:
    """(score, i, j) of the first cell by rows that has the largest score; zeros if nothing matches."""
    out = np.zeros((len(queries), 3), np.int32)
    for own, q, r, _, _ in lots(queries, refs):
        best = at = None
        for d, lo, hi, h in diagonals(q, r, True):
            if best is None:
                best, at = np.zeros_like(h), np.zeros(h.shape, np.int32)
            # A row's first cell of its largest score comes first: its columns grow with the diagonals.
            better = h[lo : hi + 1] > best[lo : hi + 1]
            np.copyto(at[lo : hi + 1], (d - np.arange(lo, hi + 1, dtype=np.int32))[:, None], where=better)
            np.maximum(best[lo : hi + 1], h[lo : hi + 1], out=best[lo : hi + 1])
        row = best.argmax(axis=0)
        k = np.arange(len(own))
        score = best[row, k]
        out[own] = np.where((score > 0)[:, None], np.c_[score, row - 1, at[row, k] - 1], 0)
    return out


def _narrow(queries: Texts, refs: Texts, wide: np.ndarray) -> Iterator[Lot]:
    """Lots of the pairs that aren't wide."""
    at = np.flatnonzero(~wide)
    if len(at) == len(wide):
        yield from lots(queries, refs)
        return
    for own, *lot in lots(*(x.slices(at, np.zeros(len(at), np.int64), x.sizes[at]) for x in (queries, refs))):
        yield at[own], *lot


def global_scores(queries: Texts | list, refs: Texts | list) -> np.ndarray:
    queries, refs = Texts.of(queries), Texts.of(refs)
    out, wide = np.zeros(len(queries), np.int32), np.maximum(queries.sizes, refs.sizes) >= WIDE
    for k in np.flatnonzero(wide):
        out[k] = bits.score(queries[k], refs[k])
    for own, q, r, m, n in _narrow(queries, refs, wide):
        for d, _, _, h in diagonals(q, r, False):
            k = np.flatnonzero(m + n == d)
            out[own[k]] = h[m[k], k]
    return out


def last_columns(queries: Texts | list, refs: Texts | list) -> list[np.ndarray]:
    """For each pair the global scores of every query prefix with the whole ref."""
    queries, refs = Texts.of(queries), Texts.of(refs)
    out, wide = [np.empty(0, np.int32)] * len(queries), queries.sizes >= WIDE
    for k in np.flatnonzero(wide):
        out[k] = bits.last_column(queries[k], refs[k])
    for own, q, r, m, n in _narrow(queries, refs, wide):
        got = np.empty((len(q) + 1, len(own)), np.int32)
        for d, _, _, h in diagonals(q, r, False):
            k = np.flatnonzero((d >= n) & (d - n <= m))
            got[d - n[k], k] = h[d - n[k], k]
        for k, i in enumerate(own):
            out[i] = got[: m[k] + 1, k]
    return out


def matrices(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The global matrices of a lot: (rows, columns, pairs)."""
    out = None
    for d, lo, hi, h in diagonals(q, r, False):
        if out is None:
            out = np.empty((len(q) + 1, len(r) + 1, q.shape[1]), h.dtype)
        i = np.arange(lo, hi + 1)
        out[i, d - i] = h[lo : hi + 1]
    return out


def global_matrices(queries: Texts | list, refs: Texts | list) -> list[np.ndarray]:
    out: list = [None] * len(queries)
    for own, q, r, m, n in lots(queries, refs, cells=True):
        made = matrices(q, r)
        for k, i in enumerate(own):
            out[i] = made[: m[k] + 1, : n[k] + 1, k].astype(np.int32)
    return out


def suffix_matrices(queries: Texts | list, refs: Texts | list) -> list[np.ndarray]:
    """Cell (i, j): the global score of q[i:] with r[j:]."""
    return [x[::-1, ::-1] for x in global_matrices(Texts.of(queries).turned(), Texts.of(refs).turned())]


def _by_size(queries: Texts, refs: Texts, most: int) -> tuple[np.ndarray, list[Texts], np.ndarray]:
    """Places and texts of the pairs of up to ``most`` cells, and places of the others."""
    large = (queries.sizes + 1) * (refs.sizes + 1) > most
    at = np.flatnonzero(~large)
    return at, [x.slices(at, np.zeros(len(at), np.int64), x.sizes[at]) for x in (queries, refs)], np.flatnonzero(large)


def envelope_paths(queries: Texts | list, refs: Texts | list, most: int = TRACED) -> tuple[np.ndarray, list[np.ndarray]]:
    """(scores, paths): for each ref column the smallest query index on any best path.

    Pairs of up to ``most`` cells go by whole matrices in lots. Longer ones are traced by bits, going up wherever that is best: no other best
    path can pass above such a trace without a cell in common, from where both could go up. Memory grows with the lengths, not with their product.
    """
    queries, refs = Texts.of(queries), Texts.of(refs)
    scores, paths = np.zeros(len(queries), np.int32), [np.empty(0, np.int32)] * len(queries)
    at, small, large = _by_size(queries, refs, most)
    for place, score, path in _envelopes(*small):
        scores[at[place]], paths[at[place]] = score, path
    for k in large:
        scores[k], made = bits.trace(queries[k], refs[k], True)
        paths[k] = step_path(made)
    return scores, paths


def _envelopes(queries: Texts, refs: Texts) -> Iterator[tuple[int, int, np.ndarray]]:
    """(place, score, path) by whole matrices, for pairs of few cells or one column."""
    for own, q, r, m, n in lots(queries, refs, cells=True):
        f = matrices(q, r)
        # Reversed texts are padded at their end, too: cell (i, j) of a pair's suffix matrix is at (m - i, n - j).
        back = matrices(*(x.turned().columns(own, pad) for x, pad in ((queries, -1), (refs, -2))))
        k = np.arange(len(own))
        best = f[m, n, k]
        i, j = np.arange(len(q) + 1)[:, None, None], np.arange(len(r) + 1)[None, :, None]
        on = (f + back[np.maximum(m - i, 0), np.maximum(n - j, 0), k] == best) & (i <= m)
        first = on.argmax(axis=0).astype(np.int32)
        for c, place in enumerate(own):
            yield int(place), int(best[c]), first[: n[c], c]


#: The letters of an alignment's steps (equal, other symbol, query symbol alone, ref symbol alone).
EQUAL, OTHER, QUERY_ONLY, REF_ONLY = b"=XID"


def alignments(queries: Texts | list, refs: Texts | list, most: int = TRACED) -> tuple[np.ndarray, list[bytes], list[np.ndarray]]:
    """(scores, steps, paths): one best path for each pair, traced from its end with ties diagonal, then up, then left.

    Paths: for each ref column the smallest query index of the traced path. Pairs of up to ``most`` cells go by whole matrices in lots, longer
    ones by bits; memory grows with the lengths, not with their product.
    """
    queries, refs = Texts.of(queries), Texts.of(refs)
    scores, steps = np.zeros(len(queries), np.int32), [b""] * len(queries)
    at, small, large = _by_size(queries, refs, most)
    for place, score, made in _traces(*small):
        scores[at[place]], steps[at[place]] = score, made
    for k in large:
        scores[k], steps[k] = bits.trace(queries[k], refs[k], False)
    return scores, steps, [step_path(x) for x in steps]


def _traces(queries: Texts, refs: Texts) -> Iterator[tuple[int, int, bytes]]:
    """(place, score, steps) by whole matrices, for pairs of few cells or one column."""
    for own, q, r, m, n in lots(queries, refs, cells=True):
        f = matrices(q, r)
        i, j, k, made = m.copy(), n.copy(), np.arange(len(own)), []
        while (i > 0).any() or (j > 0).any():
            h = f[i, j, k]
            inner = (i > 0) & (j > 0)
            same = inner & (q[i - 1, k] == r[j - 1, k]) if len(q) and len(r) else np.zeros(len(own), bool)
            diagonal = inner & (h == f[i - 1, j - 1, k] + np.where(same, MATCH, MISMATCH))
            up = ~diagonal & (i > 0) & ((j == 0) | (h == f[i - 1, j, k] - GAP))
            left = ~diagonal & ~up & (j > 0)
            made.append(np.select([diagonal & same, diagonal, up, left], [EQUAL, OTHER, QUERY_ONLY, REF_ONLY], 0).astype(np.uint8))
            i, j = i - (diagonal | up), j - (diagonal | left)
        grid = np.stack(made[::-1], axis=1) if made else np.zeros((len(own), 0), np.uint8)
        for c, place in enumerate(own):
            yield int(place), int(f[m[c], n[c], c]), grid[c][grid[c] > 0].tobytes()


def step_path(steps: bytes) -> np.ndarray:
    """For each ref column the smallest query index of a traced path."""
    x = np.frombuffer(steps, np.uint8)
    moves = np.cumsum(np.r_[0, x != REF_ONLY])  # the query index after each step
    entered = np.r_[True, x != QUERY_ONLY]  # the first cell of each column
    return moves[entered][: int((x != QUERY_ONLY).sum())].astype(np.int32)


#: What is wrong with a path, in the order of the tests.
PATH_ERRORS = (
    "checkpoint is out of range or not monotonic",
    "checkpoint is not on an optimal full-matrix path",
    "checkpoint chain does not trace through the dp matrix",
    "traced alignment score is not globally optimal",
)


def cell_scores(queries: Texts, refs: Texts, which: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Global scores of the first i[k] symbols of query which[k] with the first j[k] of its ref, by one sweep of each pair."""
    out = np.zeros(len(which), np.int32)
    order = np.argsort(which, kind="stable")
    first = np.searchsorted(which[order], np.arange(len(queries) + 1))
    wide = np.maximum(queries.sizes, refs.sizes) >= WIDE
    for k in np.flatnonzero(wide):
        at = order[first[k] : first[k + 1]]
        out[at] = bits.cells(queries[k], refs[k], i[at], j[at])
    for own, q, r, _, _ in _narrow(queries, refs, wide):
        counts = first[own + 1] - first[own]
        lane = np.repeat(np.arange(len(own)), counts)
        at = order[np.repeat(first[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        by = np.argsort(i[at] + j[at], kind="stable")
        at, lane = at[by], lane[by]
        edge = np.searchsorted((i + j)[at], np.arange(len(q) + len(r) + 2))
        for d, _, _, h in diagonals(q, r, False):
            k = slice(edge[d], edge[d + 1])
            out[at[k]] = h[i[at[k]], lane[k]]
    return out


def check_paths(queries: Texts | list, refs: Texts | list, paths: Texts | list) -> dict[str, np.ndarray]:
    """valid, bad_ref, bad_query, point_count, score, error (a place in PATH_ERRORS, or -1) of any paths; -1 in one means no checkpoint.

    All pairs are swept together: forward and backward scores are read off at the checkpoints only, and all segments between
    them are scored at once.
    """
    queries, refs, paths = Texts.of(queries), Texts.of(refs), Texts.of(paths)
    count, m, n = len(queries), queries.sizes, refs.sizes
    which = np.repeat(np.arange(count), paths.sizes)
    i = paths.flat.astype(np.int64)
    j = np.arange(len(i)) - np.repeat(paths.starts, paths.sizes)
    real = i != -1
    which, i, j = which[real], i[real], j[real]
    new = np.r_[True, which[1:] != which[:-1]][: len(which)]
    shifted = lambda x: np.where(new, 0, np.r_[0, x[:-1]][: len(x)])
    last_i, last_j = shifted(i), shifted(j)
    # A point after a bad one doesn't count, so the point before is in order wherever it is looked at.
    bad_a = (i < 0) | (i > m[which]) | (j > n[which]) | (i < last_i)
    seen = np.cumsum(bad_a) - np.repeat(np.r_[np.cumsum(bad_a)[new] - bad_a[new]], np.diff(np.r_[np.flatnonzero(new), len(which)])) if len(which) else np.zeros(0, int)
    fine = seen == 0
    w, a, b, la, lb = (x[fine] for x in (which, i, j, last_i, last_j))
    best = global_scores(queries, refs)
    forward = cell_scores(queries, refs, w, a, b)
    backward = cell_scores(queries.turned(), refs.turned(), w, m[w] - a, n[w] - b)
    parts = global_scores(queries.slices(w, la, a), refs.slices(w, lb, b)).astype(np.int64)
    first = np.searchsorted(w, np.arange(count + 1))
    upto = np.r_[0, np.cumsum(parts)]
    traced = upto[1:] - upto[first[w]]
    error = np.where(forward + backward != best[w], 1, np.where(traced != forward, 2, -1))
    out = {c: np.full(count, -1, np.int64) for c in ("bad_ref", "bad_query", "error")} | {c: np.zeros(count, np.int64) for c in ("point_count", "score")}
    # The first bad point of each path: among those in order, else the first out of order.
    wrong = np.flatnonzero(error >= 0)
    owner, k = np.unique(w[wrong], return_index=True)
    hit = np.full(count, -1)
    hit[owner] = wrong[k]
    stop = np.where(hit >= 0, hit, first[1:])  # points that count
    out["point_count"] = stop - first[:-1]
    out["score"] = upto[stop] - upto[first[:-1]]
    at = hit[owner]
    out["bad_ref"][owner], out["bad_query"][owner], out["error"][owner] = b[at], a[at], error[at]
    out["score"][owner] += np.where(error[at] == 2, parts[at], 0)
    disordered = np.flatnonzero(bad_a & (seen == 1))
    owner, k = np.unique(which[disordered], return_index=True)
    k, owner = disordered[k][hit[owner] < 0], owner[hit[owner] < 0]
    out["bad_ref"][owner], out["bad_query"][owner], out["error"][owner] = j[k], i[k], 0
    rest = np.flatnonzero(out["error"] < 0)
    some = out["point_count"][rest] > 0
    end_i, end_j = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
    end_i[some], end_j[some] = a[stop[rest][some] - 1], b[stop[rest][some] - 1]
    out["score"][rest] += global_scores(queries.slices(rest, end_i, m[rest]), refs.slices(rest, end_j, n[rest]))
    lost = rest[out["score"][rest] != best[rest]]
    out["bad_ref"][lost], out["bad_query"][lost], out["error"][lost] = n[lost], m[lost], 3
    return out | {"valid": out["error"] < 0}


def step_scores(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """What a step adds to a chain: its gain less its gap cost, which is truncated from a 32-bit float; dx and dy are whole numbers."""
    cost = (GAP_WEIGHT * np.float32(ANCHOR_SCORE) * np.abs(dy - dx).astype(np.float32)).astype(np.int64)
    return np.minimum(np.minimum(dx, dy), ANCHOR_SCORE) - cost


def chain_scores(x: np.ndarray, y: np.ndarray, there: np.ndarray, lengths: np.ndarray, known: np.ndarray, done: np.ndarray, lookback: int) -> np.ndarray:
    """Scores of anchors, a row for each chain and a column for each place; those that aren't there never chain.

    ``known[c, :done[c]]`` are scores from before. Chains are in order of falling length.
    """
    f = known.copy()
    for i in range(x.shape[1]):
        c = int(np.searchsorted(-lengths, -i, side="left"))  # chains with more than i anchors
        lo = max(0, i - lookback)
        new = np.full(c, ANCHOR_SCORE, np.int64)
        if lo < i and c:
            gain = _gains(x[:c], y[:c], there[:c], i, lo)
            new = np.maximum(new, np.where(gain > NEVER, f[:c, lo:i] + gain, ANCHOR_SCORE).max(axis=1))
        f[:c, i] = np.where(i < done[:c], f[:c, i], new)
    return f


#: Less than any score, and far enough from the least 64-bit number to add to.
NEVER = -(2**60)


def chain_transfers(x: np.ndarray, y: np.ndarray, there: np.ndarray, lengths: np.ndarray, lookback: int) -> np.ndarray:
    """What runs of anchors make of the scores before them: (runs, lookback, lookback + 1).

    A row of each matrix is a run with the ``lookback`` anchors before it in front. [c, k, j] is what the k-th of run c's last ``lookback``
    anchors gains on the j-th anchor before the run, and [c, k, lookback] its score without any of those. Runs are in order of falling length.
    """
    last = np.full((len(x), lookback, lookback + 1), NEVER, np.int64)
    last[:, np.arange(lookback), np.arange(lookback)] = 0
    for i in range(lookback, x.shape[1]):
        c = int(np.searchsorted(-lengths, -i, side="left"))  # runs with more than i anchors
        if not c:
            break
        gain = _gains(x[:c], y[:c], there[:c], i, i - lookback)
        new = np.where((gain > NEVER)[..., None], last[:c] + gain[..., None], NEVER).max(axis=1)
        new = np.where(new < NEVER // 2, NEVER, new)
        new[:, lookback] = np.maximum(new[:, lookback], ANCHOR_SCORE)
        last[:c, :-1] = last[:c, 1:]
        last[:c, -1] = new
    return last


def _gains(x: np.ndarray, y: np.ndarray, there: np.ndarray, i: int, lo: int) -> np.ndarray:
    """What anchor i adds to chains that end in anchors lo to i - 1; ``NEVER`` where it can't follow."""
    ok = (x[:, [i]] > x[:, lo:i]) & (y[:, [i]] > y[:, lo:i]) & there[:, [i]] & there[:, lo:i]
    # Compared first: a difference of far numbers may not fit, and is then huge.
    dx, dy = (np.where(v[:, [i]] - v[:, lo:i] < 0, np.iinfo(np.int64).max, v[:, [i]] - v[:, lo:i]) for v in (x, y))
    return np.where(ok, step_scores(np.where(ok, dx, 0), np.where(ok, dy, 0)), NEVER)


def after_run(transfer: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Scores of a run's last anchors, from those of the anchors before it."""
    return (transfer + np.r_[scores, 0]).max(axis=1)
