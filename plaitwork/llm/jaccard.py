"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

A text's set holds the 64-bit hashes of its runs of ``n`` consecutive words (``_util.words``); a text of
fewer words, but not none, has one run, and a text without words no set: it links with nothing.

1. Texts with equal sets form a class, known by 128 bits of hash of the set, with the number of its documents.
2. ``bands`` and ``rows`` are the cheapest pair that finds a pair of exactly the threshold with the target
   recall (``plan``). Each class has a hash for each band; the shuffle is on (band, hash). Of a bucket of several
   classes the least is the head.
3. A class belongs to the least head of its buckets, so that near copies come together; the classes of a head are cut into
   blocks of a bounded number of texts and n-grams. Two blocks are compared only if a bucket has classes of both, which a join of the
   buckets' blocks with themselves finds, a bucket of many blocks in many parts; each
   pair of blocks is a task's work: it compares all full sets of the two and returns, for each class, the number of its
   links and one link of a spanning forest. No pair is left out by a cap, and pairs of texts are never a table.
4. Parts connected by links are the groups of near duplicates.

Every pair with a common bucket is compared on full sets, so nothing under the threshold is linked and recall
is at least the target. A document is a row: rows that share an id, or have none, and differ in text are told apart by
96 bits of hash of id and text; rows with equal id and text are one document. Null ids come last in the order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaitwork.llm._util import components, fresh, prepare, staged, text_key, word_hashes

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
BLOCK_DOCS, BLOCK_GRAMS = 128, 400_000
#: Blocks of a bucket that a task pairs with all of the bucket's blocks.
SQUARE = 64


def plan(threshold: float, recall: float, most: int = 512) -> tuple[int, int]:
    """(bands, rows) of the steepest banding of at most ``most`` hashes with the recall at the threshold.

    More rows a band mean fewer false candidates; bands are as few as the recall allows. The choice is
    the one with the most rows whose hashes stay under 200, or the least number of hashes above.
    """
    found = []
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= most:
            found.append((bands, rows))
    small = [x for x in found if x[0] * x[1] <= 200]
    return max(small, key=lambda x: x[1]) if small else min(found, key=lambda x: x[0] * x[1])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted different hashes of the runs of ``n`` words; one run if there are fewer, none if there are none."""
    h = hashes.astype(np.int64).view(np.uint64)
    if not len(h):
        return np.empty(0, np.uint64)
    k = min(n, len(h))
    g = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(g)]
        return np.unique(_mix(g))


def band_hashes(grams: np.ndarray, bands: int, rows: int, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A hash for each band of the MinHash signature of one set."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    a, b = seeds
    sig = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        x = low[at : at + 256]
        np.minimum(sig, (a[:, None] * x[None, :] + b[:, None]).min(axis=1), out=sig)
    out = np.zeros(bands, np.uint64)
    for r in range(rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + sig.reshape(bands, rows)[:, r].astype(np.uint64) + np.uint64(1))
    return out.view(np.int64)


def seeds_of(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_101)
    return rng.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, count, dtype=np.uint32)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of every set of ``left`` with every one of ``right``."""
    if not left or not right:
        return np.zeros((len(left), len(right)), np.int64)
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, code, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[code] > 1
    code, owner = code[shared], owner[shared]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    total, out, width = int(code[-1]) + 1 if len(code) else 0, np.zeros((len(left), len(right)), np.float32), 4_096
    for lo in range(0, total, width):
        k = slice(*np.searchsorted(code, [lo, lo + width]))
        grid = np.zeros((len(left) + len(right), width), np.float32)
        grid[owner[k], code[k] - lo] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return np.rint(out).astype(np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the pairs ``a[i], b[i]`` with the least node of its connected part."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = code[: len(a)], code[len(a) :], np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def compare(block: pd.DataFrame, same: bool, threshold: float) -> pd.DataFrame:
    """Links among the sets of one block (``same``), or between those of side 0 and of side 1."""
    block = block.drop_duplicates(["side", "rep"])  # rows that repeat an id and its text
    sides = [block[block["side"] == 0], block[block["side"] == 1]]
    left, right = sides[0], sides[0] if same else sides[1]
    sets = [[np.frombuffer(x, np.uint64) for x in s["grams"]] for s in (left, right)]
    common = overlaps(*sets)
    sizes = [np.array([len(x) for x in s], np.int64) for s in sets]
    union = sizes[0][:, None] + sizes[1][None, :] - common
    # The threshold as a fraction of whole numbers, so that a pair exactly on it counts.
    linked = common * 1_000_000 >= union * round(threshold * 1_000_000)
    if same:
        linked &= ~np.eye(len(left), dtype=bool)
    i, j = np.nonzero(linked)
    ids = [left["rep"].to_numpy(), right["rep"].to_numpy()]
    copies = [left["copies"].to_numpy(), right["copies"].to_numpy()]
    links = pd.Series(linked @ copies[1], ids[0])
    if not same:
        links = pd.concat([links, pd.Series(linked.T @ copies[0], ids[1])])
    links = links[links > 0]
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    nodes, roots = forest(ids[0][i], ids[1][j])
    return pd.DataFrame({"rep": links.index.to_numpy(), "links": links.to_numpy()}).merge(pd.DataFrame({"rep": nodes, "root": roots}), on="rep", how="left") if len(links) else pd.DataFrame({"rep": [], "links": [], "root": []})


def judged(docs: DataFrame, id_col: str, text_col: str, n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, block_docs: int = BLOCK_DOCS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(key, key2, id, n_links, component_id, kept) for each row of ``docs``; key, key2: its id's and text's hash."""
    prepare(docs.sparkSession)
    bands, rows = plan(threshold, recall)
    keys = [k.alias(c) for k, c in zip(text_key(id_col, text_col), ("key", "key2"), strict=True)]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), *keys, F.col(text_col).alias("text"))

    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seeds = seeds_of(bands * rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [gram_set(x.values.to_numpy(zero_copy_only=False), n) for x in part.column("wh")]
                # Texts without a set get a value of their own, so that they don't meet in one task.
                own = [_digest(s if len(s) else np.array([k], np.int64)) for s, k in zip(sets, part.column("key").to_pylist(), strict=True)]
                marks = [band_hashes(s, bands, rows, seeds) if len(s) else np.empty(0, np.int64) for s in sets]
                kept = [part.column(c) for c in ("id", "key", "key2")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(own, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(marks, pa.list_(pa.int64()))], names=["id", "key", "key2", "set", "n", "bands"])

    hashed = texts.select("id", "key", "key2", word_hashes(F.col("text")).alias("wh"))
    table = staged(hashed.mapInArrow(sketch, "id long, key long, key2 int, set binary, n int, bands array<long>"), "sketches")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key", "key2")
    once = table.where("n > 0").groupBy("set", "key", "key2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = staged(once.groupBy("set").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select(F.col("set").alias("rep"), F.posexplode("bands").alias("band", "h"))
    heads = staged(buckets.groupBy("band", "h").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "heads")
    met = staged(buckets.join(heads, ["band", "h"]), "buckets")
    cells = met.groupBy("rep").agg(F.min("head").alias("cell")).join(classes.select(F.col("set").alias("rep"), "least", "copies", "n"), "rep")
    cells = staged(cells, "cells")
    sizes = staged(cells.groupBy("cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("n") / block_grams)).cast("int").alias("parts")), "cell-sizes")
    block = F.concat("cell", F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64("rep"), F.col("parts"))), 8, "0")))
    members = staged(cells.join(sizes, "cell").select("rep", block.alias("block"), "least.key", "least.key2", "copies"), "members")
    # The blocks that share a bucket, an entry for each block, not for each text; a bucket of many blocks is cut into squares, a task each.
    entries = staged(met.join(members.select("rep", "block"), "rep").select("band", "h", "block").distinct(), "bucket-blocks")
    squares = entries.groupBy("band", "h").agg(F.ceil(F.count(F.lit(1)) / SQUARE).cast("int").alias("squares"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    dealt = staged(entries.join(squares, ["band", "h"]), "bucket-squares")
    left = dealt.select("band", "h", F.pmod(F.xxhash64("block"), F.col("squares")).cast("int").alias("square"), F.col("block").alias("i"))
    right = dealt.select("band", "h", F.explode(F.sequence(F.lit(0), F.col("squares") - 1)).alias("square"), F.col("block").alias("j"))
    pairs = left.join(right, ["band", "h", "square"]).where("i < j").select("i", "j").distinct()
    pairs = staged(members.select(F.col("block").alias("i"), F.col("block").alias("j")).distinct().unionByName(pairs), "block-pairs")
    side = lambda c, k: pairs.select(F.col(c).alias("block"), F.struct("i", "j", F.lit(k).alias("side")).alias("to"))
    ends = side("i", 0).unionByName(side("j", 1).where("to.i <> to.j"))
    asked = members.join(ends, "block").groupBy("rep", "key", "key2", "copies").agg(F.collect_list("to").alias("to"))

    def sets_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                grams = pa.array([gram_set(x.values.to_numpy(zero_copy_only=False), n).tobytes() for x in part.column("wh")], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rep", "copies", "to")), grams], names=["rep", "copies", "to", "grams"])

    # Merged at every size: members grow with the texts, so they are never broadcast.
    wanted = texts.drop("id").join(asked.hint("merge"), ["key", "key2"]).select("rep", "copies", "to", word_hashes(F.col("text")).alias("wh"))
    full = wanted.mapInArrow(sets_of, "rep binary, copies long, to array<struct<i: binary, j: binary, side: int>>, grams binary")
    sides = full.select("rep", "copies", "grams", F.explode("to").alias("to")).select("to.*", "rep", "copies", "grams")

    def verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return compare(pdf, key[0] == key[1], threshold)

    found = staged(sides.groupBy("i", "j").applyInPandas(verify, "rep binary, links long, root binary"), "links")
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component")
    linked = staged(cells.select("rep", "least").join(degree, "rep").join(parts, "rep"), "linked")
    best = staged(linked.groupBy("component").agg(F.min("least").alias("best")), "bests")
    by_class = linked.join(best, "component").select(F.col("rep").alias("set"), "links", "best")
    grouped = classes.select("set", "copies", "least").join(by_class, "set", "left").where("copies > 1 or links is not null")
    ranked = staged(grouped.select("set", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("best", "least").alias("best")), "ranked")
    out = table.select("id", "key", "key2", "set").join(ranked, "set", "left")
    alone = F.col("best").isNull()
    return out.select("key", "key2", "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("component_id"), (alone | (place == F.col("best"))).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(``id_col``, n_links, component_id, kept) for each row of ``docs``; ids are whole numbers.

    n_links counts the other documents, copies included, of similarity ``threshold`` or more;
    component_id is the least id reached by links; kept marks the document of least id. A row without links has its own id.
    """
    return judged(docs, id_col, text_col, **options).select(F.col("id").alias(id_col), "n_links", "component_id", "kept")


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the document of the least id of each group of near duplicates; others unchanged.

    Rows with equal id and text are one document and stay or go together.
    """
    key, key2 = fresh(docs, "key"), fresh(docs, "key2")
    gone = judged(docs, id_col, text_col, **options).where("not kept").select(F.col("key").alias(key), F.col("key2").alias(key2)).distinct()
    return docs.withColumns(dict(zip((key, key2), text_key(id_col, text_col), strict=True))).join(gone, [key, key2], "left_anti").select(*docs.columns)
