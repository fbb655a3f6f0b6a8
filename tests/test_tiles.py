"""Scores by tiles, and matrices by strips, against whole matrices."""

import random

import numpy as np
import plain
import pytest
from plaitwork.functions import kernels as K
from plaitwork.operators import align, tiles
from pyspark.sql import functions as F


def some_pairs(seed, n=25, longest=40):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choices("ACGé", k=rng.randint(0, longest)))
    rows = [(k, text(), text()) for k in range(n)]
    return [*rows, (100, "", ""), (101, "A" * 21, ""), (102, "", "C" * 14), (103, None, "A"), (104, "A", None), (None, "GATTACA", "GCATGCU"), (105, "A" * 35, "A" * 35)]


@pytest.mark.parametrize("local", [True, False])
def test_tiles(spark, local):
    rows = some_pairs(1)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "k int, query string, ref string, ti int, best string").repartition(3)
    got = {r["k"]: r["score"] for r in tiles.wavefront_scores(df, ["k"], local=local, size=7).collect()}
    assert got == {k: None if q is None or r is None else (plain.sw if local else plain.nw)(q, r) for k, q, r in rows}


def test_tiles_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "a")], "k int, query string, ref string")
    assert [tuple(r) for r in tiles.wavefront_scores(df, ["k"]).collect()] == [(1, None)]
    assert tiles.wavefront_scores(df.limit(0), ["k"]).collect() == []
    with pytest.raises(ValueError):
        tiles.wavefront_scores(df, ["k"], size=0)


def test_one_long_pair_over_tasks(spark):
    rng = random.Random(4)
    q = "".join(rng.choices("ACGT", k=3_000))
    r = "".join(c for c in q if rng.random() > 0.2) + "T" * 500
    df = spark.createDataFrame([("a", q, r)], "k string, query string, ref string")
    assert tiles.wavefront_scores(df, ["k"], size=600).first()["score"] == K.local_scores([q], [r])[0]
    assert tiles.wavefront_scores(df, ["k"], local=False, size=600).first()["score"] == K.global_scores([q], [r])[0]


def test_tile_borders():
    rng = np.random.default_rng(5)
    q, r = rng.integers(0, 3, 20), rng.integers(0, 3, 30)
    whole = np.array([h for h in K.rows(q, r, False)])
    bottom, right, best = K.tile(q[5:12], r[8:25], whole[5, 8:26], whole[5:13, 8], False)
    assert (bottom == whole[12, 8:26]).all() and (right == whole[5:13, 25]).all() and best == whole[6:13, 9:26].max()


@pytest.mark.parametrize("suffix", [False, True])
def test_strips(spark, suffix):
    rows = some_pairs(2, 12)
    df = spark.createDataFrame([(*r, 1) for r in rows], "k int, query string, ref string, matrix int").repartition(2)
    got = align.nw_strips(df, ["k"], width=6, suffix=suffix)
    assert got.agg(F.max(F.size("h"))).first()[0] <= 6
    cells = {(r["k"], r["i"], r["j"]): r["h"] for r in align.strip_cells(got, ["k"]).collect()}
    array = (align.nw_suffix_matrix if suffix else align.nw_matrix)(df.drop("matrix"))
    assert cells == {(r["k"], r["i"], r["j"]): r["h"] for r in align.cells(array, ["k"]).collect()}
    assert {k for k, _, _ in cells} == {k for k, q, r in rows if q is not None and r is not None}
    with pytest.raises(ValueError):
        align.nw_strips(df.withColumnRenamed("k", "i"), ["i"])


@pytest.mark.parametrize("suffix", [False, True])
def test_strips_of_long_pairs_hold_a_row(suffix):
    rng = random.Random(6)
    qs, rs = (["".join(rng.choices("ACG", k=rng.randint(0, 30))) for _ in range(20)] for _ in range(2))
    whole = (K.suffix_matrices if suffix else K.global_matrices)(qs, rs)
    for most in (1, 200):
        got = [{} for _ in qs]
        for place, i, h in K.strips(qs, rs, 5, suffix, most):
            got[place][i] = h.tolist()
        assert [[x[i] for i in range(len(x))] for x in got] == [m.tolist() for m in whole]


@pytest.mark.parametrize("local", [True, False])
def test_many_tiles_at_once(local):
    rng = np.random.default_rng(7)
    wholes, qs, rs, tops, lefts = [], [], [], [], []
    for k in range(60):
        q, r = rng.integers(0, 3, 20).astype(np.int32), rng.integers(0, 3, 30).astype(np.int32)
        whole = np.array([h for h in K.rows(q, r, local)]) + (0 if local else 40_000 * (k % 2))
        (i0, i1), (j0, j1) = np.sort(rng.integers(1, 21, 2)), np.sort(rng.integers(1, 31, 2))
        wholes.append((whole[i1, j0 : j1 + 1], whole[i0 : i1 + 1, j1], whole[i0 + 1 : i1 + 1, j0 + 1 : j1 + 1]))
        qs, rs = [*qs, q[i0:i1]], [*rs, r[j0:j1]]
        tops, lefts = [*tops, whole[i0, j0 : j1 + 1]], [*lefts, whole[i0 : i1 + 1, j0]]
    border = lambda x: (np.concatenate(x).astype(np.int64), np.cumsum([0, *map(len, x)])[:-1], np.zeros(len(x), np.int64))
    bottom, right, best, corner = K.tiles(K.Texts.of(qs), K.Texts.of(rs), border(tops), border(lefts), local)
    assert bottom[0].tolist() == np.concatenate([x[0] for x in wholes]).tolist() and right[0].tolist() == np.concatenate([x[1] for x in wholes]).tolist()
    assert corner.tolist() == [x[0][-1] for x in wholes]
    if local:
        assert all(b >= x[2].max() for b, x in zip(best, wholes, strict=True) if x[2].size)


def test_tiles_broadcast_nothing(spark):
    from plaitwork.operators import tiles as T

    df = spark.createDataFrame([(k, "GATTACA" * 2, "GCATGCU") for k in range(50)], "k int, query string, ref string")
    got = T.wavefront_scores(df, ["k"], size=4)
    assert got.count() == 50
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
