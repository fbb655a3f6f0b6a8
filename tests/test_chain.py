import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F
from plaitwork.operators import chain
from plaitwork.streaming.chain import chain_scores_online

X, Y = (1, 4, 9, 15, 40, 41, 60, 100), (2, 5, 8, 30, 33, 34, 80, 120)


def scores(df):
    return [r["score"] for r in df.orderBy("chain_id", "idx").collect()]


@pytest.mark.parametrize(("lookback", "want"), [(1, [15, 18, 21, 25, 25, 26, 37, 52]), (2, [15, 18, 21, 27, 36, 37, 48, 63]), (8, [15, 18, 21, 27, 36, 37, 48, 63])])
def test_hand_vector(spark, lookback, want):
    df = spark.createDataFrame([("a", i, x, y) for i, (x, y) in enumerate(zip(X, Y, strict=True))], "chain_id string, idx int, x int, y int")
    assert scores(chain.chain_scores(df, lookback)) == want


def test_gap_cost_is_a_32_bit_float(spark):
    df = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 30, 50)], "chain_id long, idx int, x int, y int")
    assert scores(chain.chain_scores(df, 2)) == [15, 28]


def chains(seed, n=30):
    rng = random.Random(seed)
    return {c: [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.choice((1, 2, 9, 40)))] for c in range(n)}


def test_random_chains_with_nulls(spark):
    made = chains(3)
    rows = [(c, i, x, y) for c, own in made.items() for i, (x, y) in enumerate(own)]
    df = spark.createDataFrame([*rows, (99, 0, None, 3), (99, 1, 5, None), (99, 2, 9, 9)], "chain_id long, idx int, x int, y int")
    want = [s for own in made.values() for s in plain.chain([p[0] for p in own], [p[1] for p in own], 4)] + [15, 15, 15]
    assert scores(chain.chain_scores(df, 4)) == want


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_batches_carry_on(size):
    made = chains(8)
    ids, x, y = (np.array(v, np.int64) for v in zip(*[(c, *p) for c, own in made.items() for p in own], strict=True))
    got, carry = [], None
    for at in range(0, len(ids), size):
        s, carry = chain.scored_runs(ids[at : at + size], x[at : at + size], y[at : at + size], np.ones(len(ids[at : at + size]), bool), carry, 4)
        got += s.tolist()
    assert got == [s for own in made.values() for s in plain.chain([p[0] for p in own], [p[1] for p in own], 4)]


def test_longer_look_back_never_lowers(spark):
    rows = [(c, i, x, y) for c, own in chains(4).items() for i, (x, y) in enumerate(own)]
    df = spark.createDataFrame(rows, "chain_id long, idx int, x int, y int")
    a, b = scores(chain.chain_scores(df, 2)), scores(chain.chain_scores(df, 8))
    assert all(p <= q for p, q in zip(a, b, strict=True))
    with pytest.raises(ValueError):
        chain.chain_scores(df, 0)


def test_edges(spark):
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(zip(X, Y, strict=True))], "chain_id long, idx int, x int, y int")
    got = {(r["idx"], r["prev"]): (r["gain"], r["cost"]) for r in chain.chain_edges(df, 2).collect()}
    want = {(i, j): (min(X[i] - X[j], Y[i] - Y[j], 15), int(np.float32(0.15) * abs(Y[i] - Y[j] - X[i] + X[j]))) for i in range(8) for j in range(max(0, i - 2), i)}
    assert got == want


def test_empty(spark):
    assert chain.chain_scores(spark.createDataFrame([], "chain_id long, idx int, x int, y int"), 4).count() == 0


def test_online_equals_batch(spark, tmp_path):
    made = chains(6, 5)
    rows = [(c, i, x, y) for c, own in made.items() for i, (x, y) in enumerate(own)]
    schema = "chain_id long, idx long, x long, y long"
    for k in range(2):  # the first half of every chain arrives first
        part = [r for r in rows if (r[1] >= len(made[r[0]]) // 2) == bool(k)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = chain_scores_online(stream, 4).writeStream.format("memory").queryName("online").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {(r["chain_id"], r["idx"]): r["score"] for r in spark.table("online").collect()}
    want = {(r["chain_id"], r["idx"]): r["score"] for r in chain.chain_scores(spark.createDataFrame(rows, schema), 4).collect()}
    assert got == want


def test_far_coordinates_are_whole_numbers(spark):
    big = 2**60
    rows = [(1, 0, big, big), (1, 1, big + 1, big + 1), (2, 0, -(2**62), 5), (2, 1, 2**62, 9), (3, 0, None, 1), (3, 1, 4, 2), (3, 2, 5, 3)]
    got = chain.chain_scores(spark.createDataFrame(rows, "chain_id long, idx long, x long, y long"), 4)
    scores = {(r["chain_id"], r["idx"]): r["score"] for r in got.collect()}
    assert scores == {(1, 0): 15, (1, 1): 16, (2, 0): 15, (2, 1): 15, (3, 0): 15, (3, 1): 15, (3, 2): 16}


@pytest.mark.parametrize(("lookback", "run"), [(4, 5), (2, 2), (8, 16), (16, 1_000)])
@pytest.mark.parametrize("merged", ["true", "false"])
def test_long_chains_by_runs(spark, lookback, run, merged):
    """Runs of a few anchors, chains that end at, before and after a run's end, ranges that hold less than a look back."""
    rng = random.Random(lookback)
    made = {c: [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(n)] for c, n in enumerate([1, 2, 9, 40, 300, 3, 15, 16, 17, 31, 1])}
    rows = [(c, i, x, y) for c, own in made.items() for i, (x, y) in enumerate(own)]
    rows += [(99, 0, None, 3), (99, 1, 5, None), (99, 2, 9, 9), (None, 0, 1, 1), (None, 1, 5, 5), (50, 0, 2**62, 1), (50, 1, -(2**62), 2)]
    df = spark.createDataFrame(rows, "chain_id long, idx int, x long, y long").repartition(3)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    try:
        got = {(r["chain_id"], r["idx"]): r["score"] for r in chain.long_chain_scores(df, lookback, run).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    want = {(c, i): s for c, own in made.items() for i, s in enumerate(plain.chain([p[0] for p in own], [p[1] for p in own], lookback))}
    assert got == want | {(99, 0): 15, (99, 1): 15, (99, 2): 15, (None, 0): 15, (None, 1): got[None, 1], (50, 0): 15, (50, 1): 15} and got[None, 1] > 15


def test_long_chain_uses_many_tasks(spark):
    n = 40_000
    one = spark.range(n).select(F.lit("a").alias("chain_id"), F.col("id").alias("idx"), (F.col("id") * 3).alias("x"), F.pmod(F.xxhash64("id"), F.lit(90_000)).alias("y"))
    got = chain.long_chain_scores(one, 8, 1_000)
    want = chain.chain_scores(one, 8)
    assert got.join(want.withColumnRenamed("score", "other"), "idx").where("score <> other").count() == 0 and got.count() == n
    assert got.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1
    assert chain.long_chain_scores(one.limit(0), 8).collect() == []
    with pytest.raises(ValueError):
        chain.long_chain_scores(one, 8, 4)


def test_late_anchors_are_scored_in_order(spark, tmp_path):
    """Anchors in any order inside the delay: the scores are those of a batch; the state holds what waits and a look back."""
    from datetime import datetime, timedelta, timezone

    from plaitwork.streaming.chain import chain_scores_in_order

    rng = random.Random(11)
    schema = "chain_id long, at timestamp, idx long, x long, y long"
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    made = {c: [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(30)] for c in range(4)}
    rows = [(c, start + timedelta(seconds=i), i, x, y if i != 7 else None) for c, own in made.items() for i, (x, y) in enumerate(own)]
    late = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=rng.uniform(0, 8)), r[0]))
    parts = [late[k : k + 24] for k in range(0, len(late), 24)] + [[(99, start + timedelta(hours=1), 0, 1, 1)], [(99, start + timedelta(hours=3), 1, 2, 2)], [(0, start, 500, 1, 1)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    import os
    import time

    for k, f in enumerate(sorted((tmp_path / "in").glob("part-*.parquet"), key=lambda f: f.stat().st_mtime_ns)):
        os.utime(f, (time.time() - 1_000 + k, time.time() - 1_000 + k))
    key = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = chain_scores_in_order(stream, 4, "10 seconds", idle_ms=60_000)
        query = out.writeStream.format("memory").queryName("in_order").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        got = {(r["chain_id"], r["idx"]): r["score"] for r in spark.table("in_order").collect() if r["chain_id"] != 99}
    finally:
        spark.conf.set(key, kept)
    batch = chain.chain_scores(spark.createDataFrame(rows, schema), 4)
    assert got == {(r["chain_id"], r["idx"]): r["score"] for r in batch.collect()} and len(got) == 120  # the row after three hours is too late
