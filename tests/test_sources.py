import os
import random

import pytest
from plaitwork.functions import prep
from plaitwork.operators import checks, schedule
from plaitwork.sources import generators, records, scratch, sinks
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("n", "lo", "hi", "quantum", "want"),
    [(8, 64, 512, 8, [344, 360, 408, 376, 320, 448, 336, 80]), (8, 4, 16, 1, [14, 15, 5, 12, 8, 11, 6, 14]), (3, 7, 7, 1, [7, 7, 7])],
)
def test_lengths(spark, n, lo, hi, quantum, want):
    df = spark.createDataFrame([(1,)], "seed long")
    assert [r["len"] for r in generators.lengths(df, "seed", "seed", n, lo, hi, quantum).orderBy("nr").collect()] == want
    assert n < 8 or lo < 64 or sum(r["len"] for r in generators.lengths(df, "seed", "seed", 64, lo, hi, quantum).collect()) == 20_800


def test_team_sizes_and_chunks(spark):
    lens = [344, 360, 408, 376, 320, 448, 336, 80]
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([*lens, 0, 5_000])], "k int, ref string")
    got = schedule.team_sizes(df, F.length("ref"), 8, 128).orderBy("k").collect()
    assert [r["team_size"] for r in got] == [43, 45, 51, 47, 40, 56, 42, 10, 1, 128]
    parts = schedule.chunks(df, F.length("ref"), 8, 128, ["k"]).orderBy("k", "lane").collect()
    for k, n in enumerate([*lens, 0, 5_000]):
        own = [(r["lo"], r["hi"]) for r in parts if r["k"] == k]
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))


def test_deal(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.choice((0, 5, 60, 700)), "y" * rng.choice((1, 40, 900))) for i in range(3_000)] + [(9_000, None, "y"), (9_001, "x", None)]
    df = spark.createDataFrame(rows, "k int, query string, ref string").repartition(5)
    dealt = schedule.by_cost(df, 12, keys=["k"])
    assert dealt.columns == df.columns and sorted(r["k"] for r in dealt.collect()) == sorted(r[0] for r in rows)
    cells = F.sum((F.coalesce(F.length("query"), F.lit(0)) + 1).cast("long") * (F.coalesce(F.length("ref"), F.lit(0)) + 1))
    loads = [r["c"] for r in dealt.groupBy(F.spark_partition_id()).agg(cells.alias("c")).collect()]
    assert len(loads) == 12 and max(loads) <= 1.2 * sum(loads) / 12
    assert schedule.round_robin(df, 3).rdd.getNumPartitions() == 3
    assert schedule.by_cost(df.limit(0), 3).collect() == []
    with pytest.raises(ValueError):
        schedule.by_cost(df, 0)


def test_bins_are_the_greedy_ones(spark):
    df = spark.createDataFrame([(k, "a" * (k % 37), "b" * (k % 11)) for k in range(400)], "k int, query string, ref string")
    got = schedule.cost_bins(schedule.cell_buckets(df, bucket=F.col("k") % 20), 5).collect()
    loads = [0] * 5
    for r in sorted(got, key=lambda r: (-r["cells"], r["__class"], r["__bucket"])):
        assert r["bin"] == loads.index(min(loads))
        loads[r["bin"]] += r["cells"]
    assert sum(r["n"] for r in got) == 400 and all(r["cells"] < r["n"] * 2 ** (r["__class"] + 1) for r in got)


def test_rank(spark):
    rows = [(i * 40_000 - 100_000, "x" * (i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, t string")
    got = {r["k"]: r["rank"] for r in schedule.ranked_by_length(df, F.length("t"), "k").collect()}
    assert got == {k: n for n, (_, k) in enumerate(sorted((len(t), k) for k, t in rows))}


def test_rank_keeps_every_row(spark):
    """Null lengths and keys come last, keys are of any type, repeated rows have ranks of their own."""
    rows = [(None, "ab"), ("k1", None), (None, None), ("k2", "ab"), ("k2", "ab"), ("k10", "ab"), ("z", "")] * 40
    df = spark.createDataFrame(rows, "k string, t string").repartition(4)
    got = sorted((r["rank"], r["k"], r["t"]) for r in schedule.ranked_by_length(df, F.length("t"), "k").collect())
    last = lambda v: (v is None, v if v is not None else 0)
    want = sorted(rows, key=lambda r: (last(None if r[1] is None else len(r[1])), (r[0] is None, r[0] or "")))
    assert [g[0] for g in got] == [*range(len(rows))] and [g[1:] for g in got] == want
    assert schedule.ranked_by_length(df.limit(0), F.length("t"), "k").collect() == []


def test_mismatches_with_nulls(spark):
    rows = [(None, None, 1), (None, "b", None), (1, "a", 3), (2, None, 4)]
    df = spark.createDataFrame(rows, "k int, l string, v int")
    assert checks.mismatches(df, df, ["k", "l"], "v").collect() == []
    other = spark.createDataFrame([(None, None, 2), (None, "b", None), (2, None, 4), (3, "a", None)], "k int, l string, v int")
    got = checks.mismatches(df, other, ["k", "l"], "v")
    assert got.columns == ["k", "l", "actual", "expected"]
    assert {tuple(r) for r in got.collect()} == {(None, None, 1, 2), (1, "a", 3, None), (3, "a", None, None)}
    assert tuple(checks.verdict(df, df, ["k", "l"], "v").first()) == (0, True)
    with pytest.raises(ValueError):
        checks.mismatches(df.withColumnRenamed("k", "Actual"), df.withColumnRenamed("k", "Actual"), ["Actual"], "v")


def test_scratch_tables_are_deleted(spark):
    table = scratch.staged(spark.range(3), "some")
    assert table.count() == 3
    folder = table.inputFiles()[0].rsplit("/", 1)[0].split(":", 1)[-1]
    scratch.dropped(spark, table)
    assert not os.path.exists("/" + folder.lstrip("/"))


def test_prep(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert tuple(value(prep.band_limits(F.lit(30), F.lit(32), 8))) == (30, 32)
    assert [value(x) for x in prep.clamp_bounds(F.lit(0), F.lit(-4))] == [1, 1]
    assert value(prep.quantise(F.lit(13), F.lit(1), F.lit(4), F.lit(16))) == 13
    assert value(prep.quantise(F.lit(509), F.lit(8), F.lit(64), F.lit(510))) == 504


def test_records(spark, tmp_path):
    (tmp_path / "r.txt").write_text(">a ACGT\n>b\n" + "G" * 40 + "\n>c TT\n>odd")
    got = records.read_records(spark, str(tmp_path / "r.txt"), 3).orderBy("rec_no").collect()
    assert [tuple(r) for r in got] == [(0, ">a", "ACGT"), (1, ">b", "G" * 32), (2, ">c", "TT")]
    with pytest.raises(ValueError, match="3 records"):
        records.read_records(spark, str(tmp_path / "r.txt"), 4)


def test_concat_and_wrap(spark):
    df = spark.createDataFrame([(1, "a AA b BB c CC"), (2, ""), (3, None), (4, "x XX")], "doc_id int, text string")
    recs = records.records(df, "doc_id", "text")
    got = {(r["doc_id"], r["seq_no"]): r["seq"] for r in records.concat_records(recs, "doc_id", 2, 3).collect()}
    assert got == {(1, 0): "AAB", (1, 1): "CC", (4, 0): "XX"}
    counted = recs.join(recs.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    wrapped = records.wrap_records(counted, "doc_id", F.col("n"), 5).orderBy("doc_id", "slot").collect()
    assert [r["seq"] for r in wrapped] == ["AA", "BB", "CC", "AA", "BB"] + ["XX"] * 5


def test_cut(spark):
    df = spark.createDataFrame([("é" * 33 + "\n",), ("",), (None,)], "t string")
    assert [r["c"] for r in df.select(records.cut(F.col("t")).alias("c")).collect()] == [["é" * 32, "é\n"], [], []]


def test_random_anchors(spark):
    got = generators.anchors(spark, 3, 50, 1).orderBy("chain_id", "idx").collect()
    assert len(got) == 150
    for c in range(3):
        own = [r for r in got if r["chain_id"] == c]
        steps = [b["x"] - a["x"] for a, b in zip(own, own[1:], strict=False)]
        assert 1 <= min(steps) and max(steps) <= 10 and all(0 <= r["y"] < r["x"] + 50 for r in own)


def test_summary_file(spark, tmp_path):
    df = spark.createDataFrame([("b", "sw", "t", 0, "l"), ("b", "nw", "t", 2, "l")], "batch string, app string, test string, n_bad int, log string")
    sinks.write_summary(df.withColumn("status", sinks.run_status()).coalesce(1), str(tmp_path / "s"))
    text = "".join(p.read_text() for p in (tmp_path / "s").glob("*.csv"))
    assert text.splitlines()[0].split("\t") == ["batch", "app", "test", "status", "log"]
    assert "passed" in text and "failed(2)" in text


def test_record_files_are_read_in_splits(spark, tmp_path):
    """Records that span lines and splits, and files read in order of name."""
    rng = random.Random(2)
    tokens = [f"t{i}" + "x" * rng.randint(0, 60) for i in range(701)]
    text = "".join(t + rng.choice([" ", "\n", "\n\n", "\t "]) for t in tokens)
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.txt").write_text(text[:9_000])
    (tmp_path / "r/b.txt").write_text(text[9_000:] if text[8_999].isspace() or text[9_000].isspace() else " " + text[9_000:])
    left, right = ((tmp_path / f"r/{n}.txt").read_text().split() for n in "ab")
    tokens = [*left, *right]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = sorted(tuple(r) for r in records.read_records(spark, str(tmp_path / "r")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == [(k, tokens[2 * k], tokens[2 * k + 1][:32]) for k in range(len(tokens) // 2)]


def test_written_results_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "sw", 5), (2, "nw", -3)], "seq_id long, app string, score int")
    sinks.write_results(df, str(tmp_path / "scores"), by=["app"])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "scores")).select("seq_id", "app", "score").collect()} == {(1, "sw", 5), (2, "nw", -3)}
    sinks.write_texts(spark.createDataFrame([(2, "b c"), (1, "a"), (3, None)], "k int, t string"), "t", "k", str(tmp_path / "texts"))
    assert [(r["label"], r["seq"]) for r in records.read_records(spark, str(tmp_path / "texts")).collect()] == [("a", "b")]


@pytest.mark.parametrize("tokens", [1, 2, 5, 6, 37])
def test_wrapped_files(spark, tmp_path, tokens):
    """Past the end comes the first token, so an odd number of tokens turns labels into sequences."""
    words = [f"w{k}" + "x" * (40 if k == 3 else 0) for k in range(tokens)]
    (tmp_path / "a.txt").write_text("\n".join(" ".join(words[k : k + 3]) for k in range(0, min(9, tokens), 3)))
    (tmp_path / "b.txt").write_text(" \n" + "  ".join(words[9:]))
    for wanted in (0, 1, tokens, 3 * tokens + 1):
        got = sorted(tuple(r) for r in records.read_wrapped(spark, str(tmp_path), wanted).collect())
        assert got == [(r, words[2 * r % tokens], words[(2 * r + 1) % tokens][:32]) for r in range(wanted)]


def test_nothing_to_wrap(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" \n")
    assert records.read_wrapped(spark, str(tmp_path), 0).collect() == []
    with pytest.raises(ValueError, match="no records"):
        records.read_wrapped(spark, str(tmp_path), 1)


def test_lines_are_not_brought_together_by_split(spark, tmp_path):
    tokens = [f"w{k}" for k in range(3_001)]
    for n, (lo, hi) in enumerate([(0, 1_000), (1_000, 2_501), (2_501, 3_001)]):
        (tmp_path / f"part-{n}.txt").write_text("\n".join(" ".join(tokens[k : min(k + 7, hi)]) for k in range(lo, hi, 7)) + "\n")
    size, rows = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = records.read_records(spark, str(tmp_path))
        assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString().replace("Window [sum(n", "").replace("Window [lag(last", "")
        got = sorted((r["rec_no"], r["label"], r["seq"]) for r in df.collect())
        assert got == [(k, tokens[2 * k], tokens[2 * k + 1]) for k in range(1_500)]
        wrapped = sorted((r["rec_no"], r["label"], r["seq"]) for r in records.read_wrapped(spark, str(tmp_path), 4_000).collect())
        assert wrapped == [(k, tokens[2 * k % 3_001], tokens[(2 * k + 1) % 3_001]) for k in range(4_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
