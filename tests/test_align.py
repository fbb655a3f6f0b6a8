import random
import tracemalloc

import numpy as np
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plaitwork.functions import kernels as K
from plaitwork.functions import native
from plaitwork.functions import sql as functions_sql
from plaitwork.operators import align, checks
from pyspark.sql import functions as F

#: query, ref, local score, argmax, global score, banded scores for 1, 2, 4, 8, path
VECTORS = [
    ("GATTACA", "GCATGCU", 2, (2, 3), 0, (1, 2, 2, 2), [0, 1, 1, 2, 3, 4, 6]),
    ("ACACACTA", "AGCACACA", 5, (4, 7), 5, (1, 5, 5, 5), [0, 1, 1, 2, 3, 4, 5, 6]),
    ("AAAA", "AAAA", 4, (3, 3), 4, (4, 4, 4, 4), [0, 1, 2, 3]),
    ("AAAA", "CCCC", 0, (0, 0), -4, (0, 0, 0, 0), [0, 1, 2, 3]),
    ("TGTTACGG", "GGTTGACT", 4, (5, 6), 1, (3, 4, 4, 4), [0, 1, 2, 3, 4, 4, 5, 6]),
    ("ACGTACGT", "TACGTACG", 7, (6, 7), 5, (0, 7, 7, 7), [0, 0, 1, 2, 3, 4, 5, 6]),
]
TEXT = st.text("ACé", max_size=14)


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(5)
    rows = [(i, v[0], v[1]) for i, v in enumerate(VECTORS)]
    rows += [(100 + i, "".join(rng.choices("ABé𝄞", k=rng.randint(0, 20))), "".join(rng.choices("ABé𝄞", k=rng.randint(0, 20)))) for i in range(40)]
    rows += [(900, None, "A"), (901, "A", None), (902, "", ""), (903, "", "ABC"), (904, "ABC", "")]
    return spark.createDataFrame(rows, "seq_id long, query string, ref string").cache()


def by_id(df, *columns):
    return {r["seq_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def expected(pairs, f):
    return {r["seq_id"]: None if r["query"] is None or r["ref"] is None else f(r["query"], r["ref"]) for r in pairs.collect()}


@pytest.mark.parametrize("v", VECTORS)
def test_hand_vectors(v):
    q, r = K.codes(v[0]), K.codes(v[1])
    assert K.local_scores([q], [r])[0] == K.local_scores_by_rows([q], [r])[0] == v[2]
    assert tuple(K.local_argmax([q], [r])[0]) == (v[2], *v[3])
    assert K.global_scores([q], [r])[0] == v[4]
    assert [K.banded_scores([q], [r], b)[0] for b in (1, 2, 4, 8)] == [*v[5]]
    score, path = (x[0] for x in K.envelope_paths([q], [r]))
    assert (score, path.tolist()) == (v[4], v[6])
    assert K.check_paths([q], [r], [path])["valid"][0]


@settings(max_examples=150, deadline=None)
@given(TEXT, TEXT)
def test_kernels_against_loops(q, r):
    a, b = K.codes(q), K.codes(r)
    assert K.local_scores([a], [b])[0] == plain.sw(q, r) == K.local_scores_by_rows([a], [b])[0]
    assert K.global_scores([a], [b])[0] == plain.nw(q, r)
    assert K.global_matrices([a], [b])[0].tolist() == plain.matrix(q, r, False)
    assert tuple(K.local_argmax([a], [b])[0]) == plain.argmax(q, r)
    for band in (1, 3, 20):
        assert K.banded_scores([a], [b], band)[0] == plain.banded(q, r, band)
    whole, blocks = [(x[0], y[0]) for x, y in (K.envelope_paths([a], [b]), K.envelope_paths([a], [b], most=0))]
    assert whole[1].tolist() == blocks[1].tolist() == plain.path(q, r)
    assert whole[0] == blocks[0] == plain.nw(q, r)
    done = K.check_paths([a], [b], [whole[1]])
    assert (done["valid"][0], done["bad_ref"][0], done["bad_query"][0]) == (True, -1, -1)
    for most in (2_000_000, 0):
        scores, steps, paths = K.alignments([a], [b], most=most)
        assert (scores[0], steps[0].decode(), paths[0].tolist()) == plain.trace(q, r)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=8))
def test_lots_keep_places(both):
    q, r = [K.codes(x[0]) for x in both], [K.codes(x[1]) for x in both]
    assert K.local_scores(q, r).tolist() == [plain.sw(*x) for x in both]
    assert K.global_scores(q, r).tolist() == [plain.nw(*x) for x in both]
    assert [x.tolist() for x in K.last_columns(q, r)] == [[row[-1] for row in plain.matrix(*x, False)] for x in both]


@pytest.mark.parametrize("method", ["rows", "wavefront", "native"])
def test_local_scores(pairs, method):
    assert by_id(align.sw_scores(pairs, method=method), "score") == expected(pairs, plain.sw)


@pytest.mark.parametrize("method", ["rows", "native"])
def test_global_scores(pairs, method):
    assert by_id(align.nw_scores(pairs, method=method), "score") == expected(pairs, plain.nw)


def test_banded_and_argmax(pairs):
    assert by_id(align.sw_banded_scores(pairs, 4), "score") == expected(pairs, lambda q, r: plain.banded(q, r, 4))
    got = by_id(align.sw_argmax(pairs), "score", "i", "j")
    assert {k: None if v == (None,) * 3 else v for k, v in got.items()} == expected(pairs, plain.argmax)
    with pytest.raises(ValueError):
        align.sw_banded_scores(pairs, 0)


def test_binary_sides_compare_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"\xc3\xa9"), bytearray(b"\xc3\xa8"))], "query binary, ref binary")
    assert align.sw_scores(df).first()["score"] == 1


def test_matrix_path_split_segment(pairs):
    got = {}
    for r in align.cells(align.nw_matrix(pairs), ["seq_id"]).collect():
        got.setdefault(r["seq_id"], {})[r["i"], r["j"]] = r["h"]
    want = {k: {(i, j): h for i, row in enumerate(m) for j, h in enumerate(row)} for k, m in expected(pairs, lambda q, r: plain.matrix(q, r, False)).items() if m is not None}
    assert got == want
    assert by_id(align.nw_paths(pairs), "path") == expected(pairs, plain.path)
    checked = checks.check_paths(align.nw_paths(pairs).where("path is not null"))
    assert checked.where("not check.valid or check.score <> score").count() == 0
    split = by_id(align.nw_split(pairs), "score", "split")
    for k, v in expected(pairs, lambda q, r: (plain.nw(q, r), (plain.path(q, r) + [0])[len(r) // 2] if r else None)).items():
        if v is not None and v[1] is not None:
            assert split[k] == v
    seg = align.nw_segment_scores(pairs, F.lit(1), F.length("query"), F.lit(0), F.lit(2))
    assert by_id(seg, "score") == expected(pairs, lambda q, r: plain.nw(q[1:], r[:2]))


def test_suffix_matrix():
    q, r = K.codes("GATTACA"), K.codes("GCAT")
    s = K.suffix_matrices([q], [r])[0]
    assert all(s[i, j] == plain.nw("GATTACA"[i:], "GCAT"[j:]) for i in range(8) for j in range(5))


@pytest.mark.parametrize(
    ("path", "error"),
    [([0, 9, 1, 2, 3, 4, 6], 0), ([3, 2, 3, 3, 4, 5, 6], 1), ([0, 2, 1, 2, 3, 4, 6], 1), ([0, 1, 1, 2, 4, 5, 6], None), ([-1] * 7, None)],
)
def test_path_rules(path, error):
    done = K.check_paths([K.codes("GATTACA")], [K.codes("GCATGCU")], [np.array(path)])
    assert done["error"][0] == (-1 if error is None else error)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT, st.lists(st.integers(-1, 6), max_size=16), st.booleans()), max_size=6))
def test_path_checks_against_loops(rows):
    """Any paths, right ones with some points changed among them."""
    q, r = [x[0] for x in rows], [x[1] for x in rows]
    paths = [(x[2] + [-1] * len(x[1]))[: len(x[1])] if x[3] else [v if k % 3 else w for k, (v, w) in enumerate(zip(plain.path(x[0], x[1]), (x[2] + [-1] * 20), strict=False))] for x in rows]
    done = K.check_paths(q, r, [np.array(p, np.int32) for p in paths])
    columns = ("valid", "bad_ref", "bad_query", "point_count", "score", "error")
    got = [tuple(int(done[c][k]) for c in columns) for k in range(len(rows))]
    assert got == [plain.check(*x) for x in zip(q, r, paths, strict=True)]


def test_lots_are_bounded_on_both_sides():
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 4, n).astype(np.int32)
    q, r = [draw(20_000), *(draw(5) for _ in range(4_000))], [draw(5) for _ in range(4_001)]
    made = [*K.lots(q, r)]
    assert sorted(i for x in made for i in x[0]) == [*range(4_001)]
    assert max(max(x[1].size, x[2].size) for x in made) <= K.LOT_CELLS + 20_001
    tracemalloc.start()
    scores = K.local_scores(q, r)
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()
    assert scores[7] == K.local_scores([q[7]], [r[7]])[0] and scores[0] == K.local_scores_by_rows(q[:1], r[:1])[0]


def test_long_pairs_are_divided():
    """Paths and traces of parts are those of whole matrices, wherever pairs are divided."""
    rng = random.Random(9)
    changed = lambda t: "".join(c if rng.random() < 0.8 else rng.choice(["", "A", "CG"]) for c in t)
    qs = ["".join(rng.choices("ACG", k=rng.randint(0, 60))) for _ in range(150)]
    rs = [changed(q) if rng.random() < 0.7 else "".join(rng.choices("ACG", k=rng.randint(0, 50))) for q in qs]
    scores, paths = K.envelope_paths(qs, rs)
    traced = K.alignments(qs, rs)
    for most in (1, 10, 60, 400):
        some, parts = K.envelope_paths(qs, rs, most)
        assert (some == scores).all() and all((a == b).all() for a, b in zip(parts, paths, strict=True))
        some, steps, low = K.alignments(qs, rs, most)
        assert (some == traced[0]).all() and steps == traced[1] and all((a == b).all() for a, b in zip(low, traced[2], strict=True))


def test_long_pairs_take_memory_of_their_length():
    rng = random.Random(10)
    q = "".join(rng.choices("ACGT", k=6_000))
    r = "".join(c for c in q if rng.random() > 0.1) + "".join(rng.choices("ACGT", k=200))
    tracemalloc.start()
    (score,), (path,) = K.envelope_paths([q], [r], 100_000)
    (same,), (steps,), _ = K.alignments([q], [r], 100_000)
    assert tracemalloc.get_traced_memory()[1] < 8_000_000  # a matrix has 33,000,000 cells
    tracemalloc.stop()
    assert score == same == K.global_scores([q], [r])[0] and len(path) == len(r)
    assert K.check_paths([q], [r], [path])["valid"][0]
    assert steps.count(b"=") - len(steps.replace(b"=", b"")) == score


def test_alignments(pairs):
    got = by_id(align.nw_alignments(pairs), "score", "steps", "path")
    assert {k: None if v[0] is None else (v[0], v[1], v[2]) for k, v in got.items()} == expected(pairs, plain.trace)


def test_paths_that_are_no_best_ones(pairs):
    found = align.nw_paths(pairs).withColumn("path", F.when(F.col("seq_id") % 2 == 0, F.col("path")).otherwise(F.transform("path", lambda x: F.length("query") - x)))
    checked = checks.check_paths(found)
    assert checked.where("path is null and check is not null").count() == 0
    bad = checks.suboptimal_paths(found)
    assert bad.where("seq_id % 2 = 0").count() == 0 and bad.where("not check.valid and check.score <> expected").count() == bad.count() > 5


def test_clashing_names_are_an_error(pairs):
    for f in (align.sw_scores, align.nw_scores, align.nw_paths, align.nw_alignments, align.nw_split):
        with pytest.raises(ValueError, match="score"):
            f(pairs.withColumn("Score", F.lit(1)))
    assert align.sw_scores(pairs.withColumn("score", F.lit(1)), out="best").columns[-2:] == ["score", "best"]


def test_invariants(pairs):
    rows = align.nw_scores(align.sw_banded_scores(align.sw_scores(pairs), 3, out="b"), out="n").where("score is not null")
    assert rows.where("b > score or n > score").count() == 0
    turned = align.sw_scores(pairs.select("seq_id", F.col("ref").alias("query"), F.col("query").alias("ref")))
    assert by_id(turned, "score") == by_id(align.sw_scores(pairs), "score")
    own = align.sw_scores(pairs.select("seq_id", "query", F.col("query").alias("ref")))
    assert own.where("score <> length(query)").count() == 0


def test_sql_functions(spark, pairs):
    functions_sql.register(spark)
    pairs.createOrReplaceTempView("pairs")
    got = spark.sql("select seq_id, sw_score(query, ref) s, nw_score(query, ref) n, sw_banded_score(query, ref, 2) b, nw_path(query, ref) p from pairs")
    assert by_id(got, "s") == expected(pairs, plain.sw)
    assert by_id(got, "n") == expected(pairs, plain.nw)
    assert by_id(got, "b") == expected(pairs, lambda q, r: plain.banded(q, r, 2))
    assert by_id(got, "p") == expected(pairs, plain.path)


def test_native_gap_cost(spark):
    df = spark.range(0, 20_001, 7).select("id", native.chain_gap_cost(F.lit(0), F.col("id")).alias("c"))
    assert all(r["c"] == int(np.float32(0.01) * np.float32(15) * np.float32(r["id"])) for r in df.collect())


def test_mismatches(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (3, None), (5, None)], "k int, v int")
    e = spark.createDataFrame([(1, 5), (2, 7), (4, 1), (3, None), (6, None)], "k int, v int")
    assert {tuple(r) for r in checks.mismatches(a, e, ["k"], "v").collect()} == {(2, 6, 7), (4, None, 1), (5, None, None), (6, None, None)}
    assert tuple(checks.verdict(a, a, ["k"], "v").first()) == (0, True)


def test_columns_become_symbols_at_once():
    import pyarrow as pa
    from plaitwork.operators._workers import texts_of

    words = ["", "aé", "日本𝄞", "x" * 70, ""]
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(["drop", *words, "me"], kind)
        for column in (pa.array(words, kind), whole.slice(1, 5), whole.filter(pa.array([False, *[True] * 5, False]))):
            got = texts_of(column)
            assert [got[k].tolist() for k in range(5)] == [[ord(c) for c in w] for w in words]
    for kind in (pa.binary(), pa.large_binary()):
        got = texts_of(pa.array([b"ab", b"", b"\xff\x00"], kind).slice(1))
        assert [got[k].tolist() for k in range(2)] == [[], [255, 0]]
    assert len(texts_of(pa.array([], pa.string()))) == 0 and texts_of(pa.array([""], pa.string()))[0].tolist() == []


@pytest.mark.parametrize("held", [0, 10**9])
def test_bits_against_matrices(held):
    from plaitwork.functions import bits

    rng = random.Random(11)
    both = [["".join(rng.choices("ACGé"[: rng.randint(1, 4)], k=rng.randint(0, 45))) for _ in range(2)] for _ in range(150)]
    both += [["", ""], ["A", ""], ["", "C"], ["A" * 70, "A" * 65], ["A" * 70, "C" * 65]]
    for q, r in both:
        a, b = K.codes(q), K.codes(r)
        grid = np.array(plain.matrix(q, r, False))
        assert bits.score(a, b) == grid[-1, -1]
        assert bits.last_column(a, b).tolist() == grid[:, -1].tolist()
        i, j = np.array([rng.randint(0, len(q)) for _ in range(9)]), np.array([rng.randint(0, len(r)) for _ in range(9)])
        assert bits.cells(a, b, i, j).tolist() == grid[i, j].tolist()
        scores, steps, _ = K.alignments([a], [b], 10**6)
        assert bits.trace(a, b, False, held) == (scores[0], steps[0])
        (score,), (path,) = K.envelope_paths([a], [b], 10**6)
        made = bits.trace(a, b, True, held)
        assert made[0] == score and K.step_path(made[1]).tolist() == path.tolist()


def test_long_rows_are_checked_few_at_a_time(spark, monkeypatch):
    from plaitwork.operators import _workers

    seen = spark.createDataFrame([(k, "ACGT" * (300 if k % 2 else 1)) for k in range(40)], "k int, t string").coalesce(1)
    got = _workers.with_results(seen, ["t"], "n int", lambda v: [np.full(len(v[0]), int(v[0].sizes.sum()))], symbols=3_000)
    assert 1_200 <= max(r["n"] for r in got.collect()) <= 3_000
