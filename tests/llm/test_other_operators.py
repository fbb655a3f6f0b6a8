import random
import zlib
from collections import Counter

import corpus
import numpy as np
import pytest
from plaitwork.llm import embedding_dedup, sharding, toxicity
from plaitwork.llm._util import components
from plaitwork.llm.registry import learnable
from pyspark.sql import functions as F


def plain_vectors(rows, threshold=0.9):
    fine = [(k, np.array(v, float)) for k, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = Counter()
    near = {k: set() for k, _ in rows}
    for i, (k, a) in enumerate(fine):
        for j, (m, b) in enumerate(fine):
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[k] += 1
                near[k].add(m)
    least = {}
    for k in near:
        seen, todo = {k}, [k]
        while todo:
            todo += near[(x := todo.pop())] - seen
            seen |= near[x]
        least[k] = min(seen)
    return {k: (links[k], least[k], least[k] == k) for k in near}


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = [(int(k), [float(x) for x in (centres[k % 6] + rng.normal(size=8) * (0.15 if k % 2 else 1.0))]) for k in range(160)]
    rows += [(200 + k, rows[k][1]) for k in range(10)] + [(220, [x * 3 for x in rows[1][1]])]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0, None] * 4), (304, [float("nan")] * 8), (305, [float("inf")] * 8), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [1e-200, 2e-200]), (309, [0.0] * 7 + [5.0])]
    return rows


@pytest.mark.parametrize(("net", "block", "trees"), [(2_048, 2_097_152, 8), (20, 16 * 8 * 16, 8), (20, 16 * 8 * 16, 1)])
def test_vectors(spark, net, block, trees):
    rows = [(k, v, 1, "x") for k, v in vectors()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v string").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, net_rows=net, block_bytes=block, trees=trees).collect()}
    want = plain_vectors(vectors())
    want[308] = (2, 306, False)  # tiny numbers, whose squares a plain product loses
    want[306], want[307] = (2, 306, True), (2, 306, False)
    assert got == want


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embedding_dedup.near_duplicates(one).collect()] == [(1, 0, 1, True)]


def test_repeated_ids_with_different_vectors(spark):
    """Rows count by their own vector, and a component has the name of its least id."""
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.02]), (4, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 1.0]), (5, [1.0, 0.02, 0.0]), (5, None), (0, [0.0, 0.99, 0.03])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == Counter([(1, 2, 1, True), (1, 2, 0, False), (2, 2, 1, False), (3, 2, 0, False), (4, 1, 4, True), (4, 1, 4, True), (5, 2, 1, False), (5, 0, 5, True), (0, 2, 0, True)])


def test_traversal_prunes_and_loses_nothing():
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(size=(80, 16)) * 0.05 for c in rng.normal(size=(20, 16))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    for tree in (embedding_dedup.Tree(x, levels=4), embedding_dedup.Tree(x, levels=4, most=30), embedding_dedup.lower_tree(x)):
        for level, (up, parents) in enumerate(zip(tree.centres, tree.parents[1:], strict=False)):
            assert set(up) <= set(tree.centres[level + 1]) and (np.diff(parents) >= 0).all()
        got = {(int(i), int(j)) for a, b in embedding_dedup.traverse(tree, tree, x, x, 0.97) for i, j in zip(a, b, strict=True)}
        assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.97), strict=True)}
    tree = embedding_dedup.Tree(x, levels=4)
    i, _, looked = embedding_dedup.open_leaves(tree, tree, embedding_dedup.reach_of(0.97))
    leaves = len(tree.centres[-1]) ** 2
    assert len(i) < 0.15 * leaves and looked < 0.5 * leaves  # pairs pruned above aren't looked at below


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*edges, (7, None), (9, 9)], "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scratch_tables_go_when_asked(spark):
    import os

    from plaitwork.llm import _util

    kept, gone = _util.staged(spark.range(5), "kept"), _util.staged(spark.range(7), "gone")
    folder = _util._made[-1][1]
    _util.drop_scratch(spark, gone)
    assert not os.path.exists(folder) and kept.count() == 5


def toxic_rows(seed=3, n=600):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    bad = ["vilething", "nastyword", "badterm"]
    docs, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.2
        own = rng.choices(vocab, k=rng.randint(5, 80))
        for _ in range(3 if toxic else 0):
            own.insert(rng.randrange(len(own)), rng.choice(bad))
        docs.append(corpus.row(k, " ".join(own)))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_weights_against_a_plain_loop():
    rng = random.Random(17)
    bits, size = 6, 65
    rows = [np.array([*sorted(rng.sample(range(64), rng.randint(0, 9))), 64], np.int32) for _ in range(120)]
    y = np.array([float(bool({3, 7} & {*x.tolist()})) for x in rows])
    z, n = [0.0] * size, [0.0] * size

    def weight(k):
        lam = 0.0 if k == 64 else toxicity.L1
        if abs(z[k]) <= lam:
            return 0.0
        return -(z[k] - (lam if z[k] > 0 else -lam)) / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(0)
    for _ in range(3):
        for e in order.permutation(len(rows)):
            w = {k: weight(k) for k in rows[e].tolist()}
            g = 1 / (1 + np.exp(-min(35, max(-35, sum(w.values()))))) - y[e]
            for k in w:
                sigma = ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / toxicity.ALPHA
                z[k] += g - sigma * w[k]
                n[k] += g * g
    assert np.allclose(toxicity.fit(rows, y, bits, 3), [weight(k) for k in range(size)])
    assert weight(3) > 0 and weight(7) > 0


def test_long_texts_make_more_shards(spark, monkeypatch):
    docs, labels = toxic_rows(n=200)
    df, lab = spark.createDataFrame(docs, corpus.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = toxicity.train(df, lab)
    many = toxicity.train(df, lab, shard_slots=5_000)
    assert len(one[0]) and not np.array_equal(np.sort(one[1]), np.sort(many[1]))


def test_toxicity(spark):
    docs, labels = toxic_rows()
    odd = [corpus.row(5_000, None), corpus.row(5_001, ""), docs[0], corpus.row(5_002, "x " * 50_000)]
    df = spark.createDataFrame([*docs, *odd], corpus.SCHEMA).repartition(3)
    lab = spark.createDataFrame([*labels, (5_000, 1, None), (None, 1, 1), (77_777, 0, 1), (5_001, 0, 9), labels[0]], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab, learnable())
    assert 0 < len(model[0]) < 2_000  # sparse
    scores = toxicity.score(df, model)
    assert scores.count() == len(docs) + len(odd)
    got = {r["doc_id"]: r["score"] for r in scores.collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[5_000] == got[5_001]
    held = [(got[k], y) for k, _, y in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(s >= 0.7) == bool(y) for s, y in held]) > 0.97
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in [*docs, *odd] if got[r[0]] < 0.7)
    # Labels that may not be learned from change nothing.
    turned = lab.withColumn("toxic", F.when(learnable(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    other = toxicity.train(df, turned, learnable())
    assert dict(zip(*model, strict=True)) == dict(zip(*other, strict=True))


def test_rows_without_an_id_are_not_held_out(spark, tmp_path):
    from plaitwork.llm import registry

    docs, labels = toxic_rows(n=60)
    spark.createDataFrame([*docs, corpus.row(None, "no id"), corpus.row(None, None)], corpus.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    got = registry.op7_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 62 and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_toxicity_without_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    assert toxicity.score(docs, model).where("score > 0.01").count() == 0
    assert toxicity.score(no_docs, model).count() == 0


def plan(rows, n):
    df = sharding.slotted(rows, heavy=sharding.heavy_texts(rows, n))
    sizes = sharding.slot_bytes(df)
    return df, sizes, sharding.slot_map(sizes, n)


def test_sharding(docs):
    rows, sizes, slots = plan(docs, 4)
    got = sharding.assign(rows, slots, sizes).collect()
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus.rows())
    for shard in range(4):
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == [*range(len(own))]
    # The two texts that outweigh a share are alone; the rest are even.
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert sorted(load.values())[1] - sorted(load.values())[0] < 2_000
    assert all(len(v) == 1 for v in {c: {r["shard"] for r in got if r["text_crc32"] == c} for c in {r["text_crc32"] for r in got}}.values())


def test_shards_against_a_plain_deal(docs):
    """The law again by plain loops: slots by hash, heavy slots by part, largest first to the lightest shard."""
    import xxhash

    rows, sizes, slots = plan(docs, 4)
    pos = lambda h, n: ((h - 2**64 if h >= 2**63 else h) % n)
    weight, own = Counter(), Counter()
    for r in corpus.rows():
        own[r[1] or ""] += len((r[1] or "").encode()) + 1
    for r in rows.collect():
        text = next((x[1] or "" for x in corpus.rows() if x[0] == r["id"] and zlib.crc32((x[1] or "").encode()) == r["text_crc32"]))
        heavy = own[text] > sum(own.values()) / 4
        slot = pos(xxhash.xxh64_intdigest(text.encode(), seed=42), 4_096)
        assert r["vslot"] == (-1 - slot if heavy else slot)
        weight[r["vslot"], r["part"]] += r["size"]
    items = Counter()
    for (v, p), n in weight.items():
        items[v, p if v < 0 else None] += n
    load, want = [0] * 4, {}
    for (v, p), n in sorted(items.items(), key=lambda x: (x[1], x[0][0], -1 if x[0][1] is None else x[0][1]), reverse=True):
        shard = load.index(min(load))
        load[shard] += n
        want[v, p] = shard
    assert {(r["vslot"], r["part"]): r["shard"] for r in slots.collect()} == want


def test_a_text_in_most_rows_is_split(spark):
    rows = [(k, "same text") for k in range(3_000)] + [(3_000 + k, f"text {k}") for k in range(1_000)]
    df, sizes, slots = plan(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    load = {r["shard"]: r["b"] for r in sharding.assign(df, slots, sizes).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(load) == 8 and max(load.values()) - min(load.values()) < 1_500


def test_other_texts_of_a_heavy_texts_slot_stay_together(spark):
    """Few slots, so that each holds many texts: only the text that outweighs a share is dealt by id."""
    rows = [(k, "same text") for k in range(3_000)] + [(k, f"text {k % 50}") for k in range(1_000)] + [(None, None), (None, "")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    df = sharding.slotted(docs, slots=4, heavy=sharding.heavy_texts(docs, 8))
    sizes = sharding.slot_bytes(df)
    placed = sharding.assign(df, sharding.slot_map(sizes, 8), sizes)
    shards = {r["text_crc32"]: r["n"] for r in placed.groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).collect()}
    assert shards.pop(zlib.crc32(b"same text")) == 8 and set(shards.values()) == {1} and len(shards) == 51
    assert placed.count() == len(rows)


def test_query_shards_whole_tables(spark, docs, tmp_path):
    from plaitwork.llm import registry

    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op10_sharding(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text_crc32"]) for r in got) == Counter((r[0], zlib.crc32((r[1] or "").encode())) for r in corpus.rows())
    by_text = {}
    for r in got:
        by_text.setdefault(r["text_crc32"], set()).add(r["shard"])
        assert 0 <= r["shard"] < 16 and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(v) == 1 for v in by_text.values())
    for shard in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == [*range(len(own))]


def test_maps_have_versions_and_move_little(spark, tmp_path):
    rows = [(k, f"text number {k} " * (k % 7)) for k in range(4_000)]
    df, sizes, slots = plan(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    sharding.write_map(slots, str(tmp_path / "map"))
    sharding.write_map(sharding.rebalance(sharding.read_map(spark, str(tmp_path / "map")), sizes, 9), str(tmp_path / "map"))
    old, new = sharding.read_map(spark, str(tmp_path / "map"), 1), sharding.read_map(spark, str(tmp_path / "map"))
    assert new.first()["version"] == 2
    a, b = ({(r["vslot"], r["part"]): r["shard"] for r in m.collect()} for m in (old, new))
    assert a.keys() == b.keys()
    moved = [k for k in a if a[k] != b[k]]
    weight = {r["vslot"]: r["b"] for r in sizes.groupBy("vslot").agg(F.sum("bytes").alias("b")).collect()}
    assert 0 < sum(weight[k[0]] for k in moved) < 0.15 * sum(weight.values())
    load = {r["shard"]: r["b"] for r in sharding.assign(df, new, sizes).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(load) == 9 and max(load.values()) < 1.05 * sum(load.values()) / 9


def test_no_rows_to_shard(no_docs):
    df, sizes, slots = plan(no_docs, 4)
    assert sharding.assign(df, slots, sizes).count() == 0
