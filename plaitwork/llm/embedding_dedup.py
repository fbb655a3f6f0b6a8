"""Embedding near-dedup: cover-tree dual traversal over unit vectors.

On unit vectors, cosine >= c is distance <= sqrt(2 - 2c), the reach. A tree has nested nets as levels, with halving radii
1, 1/2, 1/4, ...: each centre of a level is one of the next, and every centre has its parent, the nearest centre of the level
above. A node's covering radius is the largest distance from its centre to any vector under it, so its bounds hold
for all vectors, not for a sample. The dual traversal takes pairs of nodes from the top: a pair is pruned, with all
below it, when d(p, q) - r_p - r_q is over the reach; else its children's pairs follow.

1. The upper tree of a dimension is made of at most ``net_rows`` vectors, those of least hashed id, and of no more than an
   eighth of all. This documented sample only places the centres: every vector goes to its nearest leaf, and radii
   come from all vectors. Its traversal leaves pairs of leaves, far fewer than pairs of vectors.
2. Neighbouring leaves are joined into, or large ones split over, blocks of at most ``block_bytes``. A pair of blocks with an
   open pair of leaves is a task's work: each block's vectors get the lower levels of the tree, from their leaf on, and the
   traversal goes on down to nodes of a few vectors; what is left is compared in double precision. A task returns
   each vector's number of links and one link of a spanning forest, never the pairs.

Where vectors have structure, most pairs are pruned high up; vectors spread evenly over a sphere of many dimensions can't be
pruned by any metric bound, and every pair of blocks is then computed.

The most frequent ``TREES`` dimensions have trees; vectors of all other dimensions are compared exactly in blocks by
dimension, without pruning. Equal vectors are one representative with a number of rows. Vectors that are null, empty, zero
or hold null or non-finite components link with nothing, and vectors of different dimensions don't link. Rows that
repeat an id count as rows, each with the links of its own vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaitwork.llm._util import components, prepare, staged
from plaitwork.llm.jaccard import forest

THRESHOLD, NET_ROWS, BLOCK_BYTES, NODE_ROWS, TREES, LOOKED = 0.9, 1_024, 2_097_152, 32, 8, 131_072
#: Rounding of distances between unit vectors in double precision is far below this.
SLACK = 1e-6


def units(vectors: list) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first, so that no square leaves the range."""
    x = np.stack([np.asarray(v, float) for v in vectors])
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def reach_of(threshold: float) -> float:
    return float(np.sqrt(2.0 - 2.0 * threshold)) + SLACK


class Tree:
    """Nested nets over ``x``: ``centres[l]``, rows of x, and ``parents[l]``, places in ``centres[l - 1]``.

    Leaves are in the order of their paths from the top, so that subtrees are neighbours. ``radii[l]`` are covering
    radii, from the rows of x until ``widen`` puts in those of all vectors.
    """

    def __init__(self, x: np.ndarray, radius: float = 1.0, levels: int = 3, most: int = NET_ROWS) -> None:
        chosen, near, sizes = [0], distances(x, x[:1])[:, 0], []
        for level in range(levels):
            while near.max() > radius / 2**level and len(chosen) < most:
                k = int(near.argmax())
                chosen.append(k)
                near = np.minimum(near, distances(x, x[[k]])[:, 0])
            sizes.append(len(chosen))
        ids = np.array(chosen)
        near = [distances(x[ids[: sizes[max(0, k - 1)]]], x[ids[:n]]).T.argmin(axis=1) for k, n in enumerate(sizes)]
        # Order by path from the top: a level's centres lie where their parents do.
        self.centres, self.parents, place = [], [], None
        for k, n in enumerate(sizes):
            parent = np.zeros(n, np.int64) if k == 0 else place[near[k]]
            order = np.lexsort((np.arange(n), parent))
            self.centres.append(ids[:n][order])
            self.parents.append(parent[order])
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
        self.points = [x[c] for c in self.centres]
        self.leaf = np.concatenate([distances(x[i : i + 1_024], self.points[-1]).argmin(axis=1) for i in range(0, len(x), 1_024)])
        self.widen(self.leaf, self.gaps(x, self.leaf))

    def ancestors(self, leaf: np.ndarray) -> list[np.ndarray]:
        """For each level, the places of the nodes above these leaves."""
        out = [leaf]
        for parents in reversed(self.parents[1:]):
            out.append(parents[out[-1]])
        return out[::-1]

    def gaps(self, x: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """For each row, the distances to the centres above it, a column for each level."""
        return np.stack([np.sqrt(np.maximum(2.0 - 2.0 * np.einsum("ij,ij->i", x, self.points[k][at]), 0.0)) for k, at in enumerate(self.ancestors(leaf))], axis=1)

    def widen(self, leaf: np.ndarray, gaps: np.ndarray) -> None:
        """Covering radii from leaves and largest distances, by level, of what is under them; -1 for nodes without any."""
        self.radii = [np.full(len(c), -1.0) for c in self.centres]
        for k, at in enumerate(self.ancestors(leaf)):
            np.maximum.at(self.radii[k], at, gaps[:, k])


def open_leaves(a: Tree, b: Tree, reach: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The dual traversal of two trees of as many levels: pairs of leaves that no bound prunes, and how many bounds were looked at."""
    i, j, looked = np.zeros(1, np.int32), np.zeros(1, np.int32), 0  # the root above both tops
    for level in range(len(a.centres)):
        # Children of the open pairs, ``LOOKED`` at a time: parents are sorted, so children are ranges.
        lo_a, lo_b = (np.searchsorted(t.parents[level], np.arange((len(t.centres[level - 1]) if level else 1) + 1)) for t in (a, b))
        count = np.diff(lo_a)[i]
        left = (np.repeat(lo_a[i] - (np.cumsum(count) - count), count) + np.arange(count.sum())).astype(np.int32)
        up = np.repeat(j, count)
        size = np.diff(lo_b)[up]
        upto = np.cumsum(size)
        kept_i, kept_j, at = [], [], 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LOOKED, side="right")))
            n = size[at:to]
            p = np.repeat(left[at:to], n)
            q = np.repeat(lo_b[up[at:to]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            apart = np.sqrt(np.maximum(2.0 - 2.0 * np.einsum("ij,ij->i", a.points[level][p], b.points[level][q]), 0.0))
            r, s = a.radii[level][p], b.radii[level][q]
            keep = (apart <= r + s + reach + SLACK) & (r >= 0) & (s >= 0)
            kept_i.append(p[keep].astype(np.int32))
            kept_j.append(q[keep].astype(np.int32))
            looked, at = looked + len(p), to
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (kept_i, kept_j))
    return i, j, looked


def lower_tree(x: np.ndarray, most: int = NODE_ROWS) -> Tree:
    """A block's own levels, halving from its widest distance to nodes of about ``most`` vectors."""
    return Tree(x, 1.0, 4, max(1, len(x) // most))


def traverse(a: Tree, b: Tree, x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of x, rows of y) of cosine ``threshold`` or more, in lots; a and b are trees over x and y."""
    i, j, _ = open_leaves(a, b, reach_of(threshold))
    rows = [np.flatnonzero(a.leaf == k) for k in range(len(a.centres[-1]))]
    cols = [np.flatnonzero(b.leaf == k) for k in range(len(b.centres[-1]))]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    for p, q in zip(*(np.split(v, np.flatnonzero(np.diff(i)) + 1) for v in (i, j)), strict=True):
        if not len(p):
            continue
        right = np.concatenate([cols[k] for k in q])
        left = rows[p[0]]
        for at in range(0, len(left), 512):
            m, n = np.nonzero(x[left[at : at + 512]] @ y[right].T >= threshold)
            if len(m):
                yield left[at : at + 512][m], right[n]


def compare_blocks(left: dict, right: dict, same: bool, threshold: float) -> pd.DataFrame:
    """(rep, links, root): links of the vectors of two blocks with each other, or of one with itself."""
    links = [np.zeros(len(x["rep"]), np.int64) for x in (left, right)]
    tree: dict[int, int] = {}

    def find(x: int) -> int:
        while tree.setdefault(x, x) != x:
            tree[x] = tree[tree[x]]
            x = tree[x]
        return x

    a = lower_tree(left["x"])
    b = a if same else lower_tree(right["x"])
    for i, j in traverse(a, b, left["x"], right["x"], threshold):
        if same:
            i, j = i[i != j], j[i != j]
        np.add.at(links[0], i, right["copies"][j])
        if not same:
            np.add.at(links[1], j, left["copies"][i])
        for x, y in zip(*(z.tolist() for z in forest(left["rep"][i], right["rep"][j])), strict=True):
            p, q = find(x), find(y)
            if p != q:
                tree[max(p, q)] = min(p, q)
    reps = np.concatenate([left["rep"], *([] if same else [right["rep"]])])
    n = np.concatenate([links[0], *([] if same else [links[1]])])
    reps, n = reps[n > 0], n[n > 0]
    return pd.DataFrame({"rep": reps, "links": n, "root": [find(x) for x in reps.tolist()]})


def vector_key(v: Column) -> list[Column]:
    """128 bits of hash of a vector, in two columns."""
    return [F.xxhash64(v), F.xxhash64(F.lit(7), v)]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, net_rows: int = NET_ROWS, block_bytes: int = BLOCK_BYTES, trees: int = TREES) -> DataFrame:
    """(``id_col``, n_links, component_id, kept) for each row of ``vectors``; ids are whole numbers."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # x - x is 0 for finite numbers only.
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (x - x == 0)) & F.exists("v", lambda x: x != 0)
    valid = F.coalesce(fine, F.lit(False)) & F.col("id").isNotNull()
    h, h2 = vector_key(F.col("v"))
    # Rows that link with nothing get keys of their own, so that they don't meet in one task.
    keyed = rows.withColumns({"h": F.when(valid, h).otherwise(F.xxhash64("id", F.lit(1))), "h2": F.when(valid, h2), "valid": valid})
    classes = keyed.where("valid").groupBy("h", "h2").agg(F.first("v").alias("v"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = staged(classes.withColumn("dim", F.size("v")).withColumn("least", F.col("rep")), "vectors")
    # Different vectors under one id are classes of their own, with a hash in place of the id that they share.
    shared = staged(classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared-ids")
    parted = not shared.isEmpty()
    if parted:
        marked = classes.join(shared.withColumn("shared", F.lit(True)), "rep", "left")
        classes = staged(marked.withColumn("rep", F.when(F.col("shared"), F.xxhash64("rep", "h", "h2")).otherwise(F.col("rep"))).select(*classes.columns), "vectors")
    common = [(r["dim"], r["count"]) for r in classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(trees + 1).collect()]
    found = [_links(classes.where(F.col("dim") == d), d, n, threshold, net_rows, block_bytes) for d, n in common[:trees]]
    if len(common) != len(found) or not found:
        found.append(_rare_links(classes.where(~F.col("dim").isin([d for d, _ in common[:trees]])), threshold, block_bytes))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = staged(links, "vector-links")
    degree = links.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component")
    if parted:
        # A component's name is the least id of its classes, not their least stand-in.
        least = parts.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("name"))
        parts = parts.join(least, "component").select("rep", F.col("name").alias("component"))
    ranked = classes.select("h", "h2", "rep", "least", "copies").join(degree, "rep", "left").join(parts, "rep", "left").where("copies > 1 or links is not null")
    ranked = staged(ranked.select("h", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component_id")), "ranked")
    out = keyed.select("id", "h", "h2").join(ranked, ["h", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _links(classes: DataFrame, dim: int, count: int, threshold: float, net_rows: int, block_bytes: int) -> DataFrame:
    """(rep, links, root) of the classes of one dimension, by the tree."""
    spark = classes.sparkSession
    most = max(1, min(net_rows, count // 8, 4_194_304 // dim))  # the net's bound: 4 Mi numbers
    sample = classes.orderBy(F.xxhash64("rep"), "rep").select("v").limit(most).collect()
    tree = Tree(units([r["v"] for r in sample]), most=most)
    sent = spark.sparkContext.broadcast(tree)

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2_048):
                part = pdf.iloc[at : at + 2_048]
                u = units(part["v"].tolist())
                leaf = distances(u, sent.value.points[-1]).argmin(axis=1)
                yield pd.DataFrame({"rep": part["rep"], "copies": part["copies"], "leaf": leaf.astype(np.int32), "gaps": sent.value.gaps(u, leaf).tolist(), "x": [r.tobytes() for r in u]})

    placed = staged(classes.select("rep", "copies", "v").mapInPandas(descend, "rep long, copies long, leaf int, gaps array<double>, x binary"), "leaves")
    widest = [F.max(F.get("gaps", k)).alias(f"r{k}") for k in range(len(tree.centres))]
    stats = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *widest).orderBy("leaf").toPandas()  # a row for each leaf of the net
    leaves = stats["leaf"].to_numpy(np.int64)
    tree.widen(leaves, stats[[f"r{k}" for k in range(len(tree.centres))]].to_numpy())
    per_block = max(16, block_bytes // (8 * dim))
    # Neighbouring leaves share a lot until it has a block's rows; a leaf of more rows has blocks of its own.
    lot_of, size = np.zeros(len(leaves), np.int64), 0
    for k, n in enumerate(stats["n"]):
        new = k > 0 and size + n > per_block
        lot_of[k] = lot_of[k - 1] + new if k else 0
        size = int(n) if new else size + int(n)
    parts = -(-np.bincount(lot_of, weights=stats["n"]).astype(np.int64) // per_block)
    i, j, _ = open_leaves(tree, tree, reach_of(threshold))
    lot_at = np.full(len(tree.centres[-1]), -1)
    lot_at[leaves] = lot_of
    a, b = lot_at[i], lot_at[j]
    width = int(lot_of.max(initial=0)) + 1
    open_lots = np.stack(np.divmod(np.unique(np.minimum(a, b) * width + np.maximum(a, b)), width), axis=1)
    places = spark.createDataFrame(pd.DataFrame({"leaf": leaves.astype(np.int32), "lot": lot_of, "parts": parts[lot_of].astype(np.int32)}))
    blocks = placed.join(F.broadcast(places), "leaf")
    pairs = spark.createDataFrame(pd.DataFrame({"i": open_lots[:, 0], "j": open_lots[:, 1], "m": parts[open_lots[:, 0]].astype(np.int32), "n": parts[open_lots[:, 1]].astype(np.int32)}))
    return _compared(blocks.select("lot", "parts", "rep", "copies", "x", F.lit(dim).alias("dim")), pairs, threshold)


def _rare_links(classes: DataFrame, threshold: float, block_bytes: int) -> DataFrame:
    """(rep, links, root) of the classes of all other dimensions: a lot for each dimension, blocks against blocks."""

    def scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                yield part[["rep", "copies", "dim"]].assign(x=[units([v])[0].tobytes() for v in part["v"]])

    placed = classes.select("rep", "copies", "dim", "v").mapInPandas(scaled, "rep long, copies long, dim int, x binary")
    sizes = staged(classes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(16), F.floor(F.lit(block_bytes) / (8 * F.col("dim"))))).cast("int").alias("parts")), "dimensions")
    pairs = sizes.select(F.col("dim").cast("long").alias("i"), F.col("dim").cast("long").alias("j"), F.col("parts").alias("m"), F.col("parts").alias("n"))
    return _compared(placed.join(sizes, "dim").select(F.col("dim").cast("long").alias("lot"), "parts", "rep", "copies", "x", "dim"), pairs, threshold)


def _compared(rows: DataFrame, lots: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, root): rows (lot, parts, rep, copies, x, dim) of pairs of lots (i, j, m, n), m and n their parts, block by block."""
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    packed = staged(rows.withColumn("part", part).groupBy("lot", "part").applyInPandas(_pack, "lot long, part int, dim int, rep binary, copies binary, x binary"), "blocks")
    each = lots.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("i < j or p <= q")
    each = each.select("i", "p", "j", "q").repartition(rows.sparkSession.sparkContext.defaultParallelism * 4, "i", "p", "j", "q")
    side = lambda s, lot, at: packed.select(F.col("lot").alias(lot), F.col("part").alias(at), *[F.col(c).alias(f"{s}_{c}") for c in ("dim", "rep", "copies", "x")])
    work = each.join(side("a", "i", "p"), ["i", "p"]).join(side("b", "j", "q"), ["j", "q"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                got = {c: batch.column(c)[r] for c in batch.schema.names}
                left, right = (_unpack(got, s) for s in "ab")
                same = got["i"].as_py() == got["j"].as_py() and got["p"].as_py() == got["q"].as_py()
                yield pa.RecordBatch.from_pandas(compare_blocks(left, right, same, threshold).astype("int64"), preserve_index=False)

    return work.mapInArrow(run, "rep long, links long, root long")


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep")
    return pd.DataFrame({**{c: pdf[c].iloc[:1].to_numpy() for c in ("lot", "part", "dim")}, **{c: [pdf[c].to_numpy(np.int64).tobytes()] for c in ("rep", "copies")}, "x": [b"".join(pdf["x"])]})


def _unpack(got: dict, side: str) -> dict:
    out = {c: np.frombuffer(got[f"{side}_{c}"].as_buffer(), np.int64) for c in ("rep", "copies")}
    return out | {"x": np.frombuffer(got[f"{side}_x"].as_buffer(), float).reshape(len(out["rep"]), -1)}
