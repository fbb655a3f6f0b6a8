"""Anchor chains: rows (chain_id, idx, x, y), scored in order of idx with a bounded look back.

A chain's score depends on its last ``lookback`` anchors only. Anchors are sorted within partitions by chain and
idx and streamed through tasks, which carry those few anchors from one batch to the next: no chain, however
long, is ever held whole. Coordinates are 64-bit whole numbers. Null coordinates never chain; rows that tie on idx are in
order of x and y.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plaitwork.functions import kernels as K
from plaitwork.functions import native
from plaitwork.operators._workers import prepare
from plaitwork.sources.scratch import staged


def scored_runs(ids: np.ndarray, x: np.ndarray, y: np.ndarray, there: np.ndarray, carry: tuple | None, lookback: int) -> tuple[np.ndarray, tuple | None]:
    """Scores of anchors sorted by chain, and what the next batch needs of the last chain.

    there: whether both coordinates are. carry: (chain, x, y, there, scores) of the last anchors before these.
    """
    n_old = 0
    if carry is not None and len(ids) and carry[0] == ids[0]:
        n_old = len(carry[1])
        ids, x, y, there = np.r_[np.full(n_old, carry[0]), ids], np.r_[carry[1], x], np.r_[carry[2], y], np.r_[carry[3], there]
    if not len(ids):
        return np.empty(0, np.int64), carry
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    lengths = np.diff(np.r_[starts, len(ids)])
    score = np.empty(len(ids), np.int64)
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):  # chains of like lengths together
        to = at + 1
        while to < len(order) and lengths[order[to]] * 2 >= lengths[order[at]]:
            to += 1
        own = order[at:to]
        width = lengths[own[0]]
        places = starts[own][:, None] + np.arange(width)[None, :]
        inside = np.arange(width)[None, :] < lengths[own][:, None]
        places = np.where(inside, places, 0)
        known, done = np.zeros(places.shape, np.int64), np.zeros(len(own), np.int64)
        if n_old and (k := np.flatnonzero(own == 0)).size:
            known[k[0], :n_old], done[k[0]] = carry[4], n_old
        f = K.chain_scores(x[places], y[places], there[places], lengths[own], known, done, lookback)
        score[places[inside]] = f[inside]
        at = to
    keep = slice(max(starts[-1], len(ids) - lookback), len(ids))
    return score[n_old:], (ids[-1], x[keep], y[keep], there[keep], score[keep])


def chain_scores(anchors: DataFrame, lookback: int) -> DataFrame:
    """``anchors`` (chain_id, idx, x, y) with score; extra columns are left out."""
    if lookback < 1:
        raise ValueError("lookback is 1 or more")
    prepare(anchors.sparkSession)
    schema = StructType([*anchors.select("chain_id", "idx", "x", "y").schema.fields, StructField("score", IntegerType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        carry = None
        for batch in batches:
            there = pc.and_(pc.is_valid(batch.column("x")), pc.is_valid(batch.column("y"))).to_numpy(zero_copy_only=False)
            ids, x, y = (batch.column(c).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for c in ("code", "x", "y"))
            score, carry = scored_runs(ids, x, y, there, carry, lookback)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chain_id", "idx", "x", "y")), pa.array(score, pa.int32())], names=["chain_id", "idx", "x", "y", "score"])

    # Chains are told apart by their id's hash; only neighbours in the order are compared.
    dealt = anchors.select("chain_id", "idx", "x", "y").repartition("chain_id").sortWithinPartitions("chain_id", "idx", "x", "y")
    numbered = dealt.withColumn("code", F.xxhash64("chain_id"))
    return numbered.mapInArrow(run, schema)


#: Anchors of a run, and those that a task compares at a time.
RUN, ROWS = 16_384, 1_000_000


def _cut(anchors: DataFrame, lookback: int, run: int) -> DataFrame:
    """(part, run, at, more, chain_id, idx, x, y): anchors in ranges of (chain_id, idx), cut into runs of at most ``run`` of one chain.

    at: the place in the run. Below 0: the anchors of the same range just before the run. Rows with run -1 repeat the last anchors of
    a range. more: whether the run may have a successor.
    """
    ranges = anchors.select("chain_id", "idx", "x", "y").repartitionByRange("chain_id", "idx", "x", "y").sortWithinPartitions("chain_id", "idx", "x", "y")
    coded = ranges.select("chain_id", "idx", "x", "y", F.xxhash64("chain_id").alias("code"), F.spark_partition_id().alias("part"))
    own = coded.select("part", "chain_id", "idx", "x", "y").schema.fields
    schema = StructType([own[0], *StructType.fromDDL("run bigint, at bigint, more boolean").fields, *own[1:]])

    def rows(run_of: np.ndarray, at: np.ndarray, more: np.ndarray, table):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([table.column("part"), pa.array(run_of, pa.int64()), pa.array(at, pa.int64()), pa.array(more), *(table.column(c) for c in ("chain_id", "idx", "x", "y"))], names=schema.names)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, code, number, place = None, None, -1, 0  # the last anchors of the chain at hand; its run and the place in it
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("code").to_numpy()
            new = np.r_[code is None or ids[0] != code, ids[1:] != ids[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
            position = np.where(first >= 0, np.arange(len(ids)) - first, np.arange(len(ids)) + place)
            starts = position % run == 0
            run_of = number + np.cumsum(starts)
            yield rows(run_of, position % run, position % run == run - 1, batch)
            # In front of each run that goes on with a chain, its last anchors.
            table = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks()
            shift = table.num_rows - batch.num_rows
            for k in np.flatnonzero(starts & (position > 0)):
                n = int(min(position[k], lookback, k + shift))
                for some in table.slice(int(k) + shift - n, n).to_batches():
                    yield rows(np.full(n, run_of[k]), np.arange(-n, 0), np.zeros(n, bool), some)
            code, number, place = ids[-1], int(run_of[-1]), int(position[-1]) + 1
            n = min(place, lookback, table.num_rows)
            held = table.slice(table.num_rows - n).combine_chunks().to_batches()[0]
        if held is not None:
            yield rows(np.full(held.num_rows, -1), np.arange(held.num_rows), np.full(held.num_rows, number >= 0), held)

    return coded.mapInArrow(cut, schema)


def _heads(cut: DataFrame, lookback: int) -> tuple[DataFrame, DataFrame]:
    """The rows in front of each range whose first chain began in a range before, and (part, run) of each range's last run.

    Only the last ``lookback`` anchors of each range and its first and last run reach the driver: as many as there are partitions.
    """
    spark, seen, heads = cut.sparkSession, [], []
    ends = cut.where("run >= 0").groupBy("part").agg(F.max("run").alias("last"), F.min_by("chain_id", F.struct("run", "at")).alias("chain_id"), F.min_by(F.xxhash64("chain_id"), F.struct("run", "at")).alias("code")).orderBy("part").collect()
    tails = {}
    for r in cut.where("run < 0").select("*", F.xxhash64("chain_id").alias("code")).collect():
        tails.setdefault(r["part"], []).append(r)
    for e in ends:
        if seen and seen[0]["code"] != e["code"]:
            seen = []
        for k, r in enumerate(seen):
            heads.append((e["part"], 0, k - len(seen), False, r["chain_id"], r["idx"], r["x"], r["y"]))
        own = sorted(tails[e["part"]], key=lambda r: r["at"])
        # A range of one short chain leaves the anchors before it in sight.
        seen = ([*seen, *own] if seen and own[0]["code"] == seen[0]["code"] and len(own) < lookback else own)[-lookback:]
    return spark.createDataFrame(heads, cut.schema), spark.createDataFrame([(e["part"], e["last"]) for e in ends], "part int, run bigint")


def _run_lots(batches: Iterator, lookback: int, rows: int) -> Iterator[list]:
    """Tables of whole runs of like lengths, some ``rows`` anchors at a time; batches are sorted by run."""
    import pyarrow as pa

    rest, held, count = None, [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            count += batch.num_rows
            if count < rows:
                continue
        if rest is not None:
            held = [*rest.to_batches(), *held]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        held, count, rest = [], 0, None
        if not table.num_rows:
            continue
        part, run = table.column("part").to_numpy(), table.column("run").to_numpy()
        starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (run[1:] != run[:-1])])
        ends = np.r_[starts[1:], table.num_rows]
        if batch is not None:  # the last run may go on
            rest = table.slice(int(starts[-1]))
            starts, ends = starts[:-1], ends[:-1]
        order = np.argsort(starts - ends, kind="stable")
        at = 0
        while at < len(order):
            longest, to = ends[order[at]] - starts[order[at]], at + 1
            while to < len(order) and 2 * (ends[order[to]] - starts[order[to]] + lookback) >= longest and (to - at) * longest < rows:
                to += 1
            yield [table.slice(int(starts[k]), int(ends[k] - starts[k])) for k in order[at:to]]
            at = to


def _grid(tables: list, lookback: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, x, y, there, lengths, fronts) of runs by falling length; each has ``lookback`` places in front, some of them empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    at = [t.column("at").to_numpy() for t in tables]
    fronts = np.array([int((a < 0).sum()) for a in at])
    sizes = np.array([len(a) for a in at]) - fronts + lookback
    order = np.argsort(-sizes, kind="stable")
    x, y = (np.zeros((len(tables), int(sizes.max())), np.int64) for _ in range(2))
    there = np.zeros(x.shape, bool)
    for c, k in enumerate(order):
        own = slice(lookback - fronts[k], sizes[k])
        t = tables[k]
        there[c, own] = pc.and_(pc.is_valid(t.column("x")), pc.is_valid(t.column("y"))).to_numpy()
        for v, name in ((x, "x"), (y, "y")):
            v[c, own] = t.column(name).cast(pa.int64()).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    return order, x, y, there, sizes[order], fronts[order]


def long_chain_scores(anchors: DataFrame, lookback: int, run: int = RUN) -> DataFrame:
    """What ``chain_scores`` gives, for chains of any length over all tasks; score is a long.

    With a bounded look back a score is a max-plus linear function of the ``lookback`` scores before. Anchors are cut into ranges of
    (chain_id, idx) and runs of at most ``run``. Each run that may have a successor is made into the matrix that leads from the
    scores before it to those at its end; a chain's matrices, a row a run, are passed in order, which gives every run the scores before it; then all runs are
    scored together. Short chains are one run and skip the matrices.
    """
    if lookback < 1 or run < lookback:
        raise ValueError("lookback is 1 or more, and a run at least as long")
    spark = anchors.sparkSession
    prepare(spark)
    table = staged(_cut(anchors, lookback, run), "chain-runs")
    heads, lasts = _heads(table, lookback)
    rows = table.where("run >= 0").unionByName(heads)
    known = ["part", "run", "at", "more", "chain_id", "idx", "x", "y"]

    # A stated number of groups, so that small rows with much work aren't merged into few tasks.
    groups = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    # 1. Matrices of the runs that may have a successor: full ones, and the last of each range.
    full = table.where("run >= 0 and more").select("part", "run").unionByName(lasts).distinct()
    needed = rows.join(full, ["part", "run"], "left_semi").select(*known)
    transfer_schema = StructType([*needed.select("part", "run", "chain_id").schema.fields, *StructType.fromDDL("transfer array<bigint>").fields])

    def transfers(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for tables in _run_lots(batches, lookback, ROWS):
            order, x, y, there, sizes, _ = _grid(tables, lookback)
            made = K.chain_transfers(x, y, there, sizes, lookback)
            last = pa.Table.from_batches([b for k in order for b in tables[k].slice(tables[k].num_rows - 1).to_batches()]).combine_chunks()
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * lookback * (lookback + 1), pa.int32()), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*(last.column(c).combine_chunks() for c in ("part", "run", "chain_id")), flat], names=transfer_schema.names)

    dealt = needed.repartition(groups, "part", "run").sortWithinPartitions("part", "run", "at")
    made = dealt.mapInArrow(transfers, transfer_schema)

    # 2. The scores before each run, by passing a chain's matrices in order.
    state_schema = StructType.fromDDL("part int, run bigint, state array<bigint>")

    def states(batches: Iterator) -> Iterator:
        import pyarrow as pa

        code, state = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["code"] != code:
                    code, state = r["code"], np.full(lookback, K.NEVER, np.int64)
                out.append({"part": r["part"], "run": r["run"], "state": state.tolist()})
                # Nothing comes before a chain's first anchors, so these places never gain.
                if r["transfer"] is not None:
                    state = np.maximum(K.after_run(np.array(r["transfer"], np.int64).reshape(lookback, lookback + 1), state), K.NEVER)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.int32()), ("run", pa.int64()), ("state", pa.list_(pa.int64()))]))

    made = staged(made, "chain-transfers")
    after = rows.where("at < 0").select("part", "run", "chain_id").distinct().join(made, ["part", "run"], "left_anti")  # a chain's last run
    steps = made.unionByName(after.withColumn("transfer", F.lit(None).cast("array<bigint>")))
    by_chain = steps.withColumn("code", F.xxhash64("chain_id")).repartition("chain_id").sortWithinPartitions("chain_id", "part", "run")
    before = staged(by_chain.mapInArrow(states, state_schema), "chain-states")

    # 3. All runs, from the scores before them; a last run that begins in a range takes them from its head.
    first = table.select("chain_id", "idx", "x", "y").schema
    nothing = [F.lit(None).cast(first[c].dataType).alias(c) for c in ("chain_id", "idx", "x", "y")]
    marks = before.select("part", "run", F.lit(-lookback - 1).cast("long").alias("at"), F.lit(False).alias("more"), *nothing, "state")
    whole = rows.select(*known, F.lit(None).cast("array<bigint>").alias("state")).unionByName(marks)
    out_schema = StructType([*first.fields, *StructType.fromDDL("score bigint").fields])

    def scores(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for tables in _run_lots(batches, lookback, ROWS):
            state = [t.column("state")[0].as_py() for t in tables]
            tables = [t.slice(int(s is not None)) for t, s in zip(tables, state, strict=True)]
            order, x, y, there, sizes, fronts = _grid(tables, lookback)
            start = np.full((len(tables), lookback), K.NEVER, np.int64)
            for c, k in enumerate(order):
                if state[k] is not None:
                    start[c] = state[k]
            known_scores = np.zeros(x.shape, np.int64)
            known_scores[:, :lookback] = start
            f = K.chain_scores(x, y, there, sizes, known_scores, np.full(len(x), lookback), lookback)
            for c, k in enumerate(order):
                own = tables[k].slice(int(fronts[c]))
                score = pa.array(f[c, lookback : sizes[c]])
                for b in own.combine_chunks().to_batches():
                    yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("chain_id", "idx", "x", "y")), score], names=out_schema.names)

    return whole.repartition(groups, "part", "run").sortWithinPartitions("part", "run", "at").mapInArrow(scores, out_schema)


def chain_edges(anchors: DataFrame, lookback: int) -> DataFrame:
    """(chain_id, idx, prev, gain, cost): every allowed step from one of the last ``lookback`` anchors.

    A window frame gathers at most ``lookback`` anchors a row.
    """
    frame = Window.partitionBy("chain_id").orderBy("idx").rowsBetween(-lookback, -1)
    before = anchors.select("chain_id", "idx", "x", "y", F.collect_list(F.struct("idx", "x", "y")).over(frame).alias("before"))
    each = before.select("chain_id", "idx", "x", "y", F.explode("before").alias("p"))
    dx, dy = F.col("x") - F.col("p.x"), F.col("y") - F.col("p.y")
    return each.where((dx > 0) & (dy > 0)).select("chain_id", "idx", F.col("p.idx").alias("prev"), native.chain_gain(dx, dy).alias("gain"), native.chain_gap_cost(dx, dy).alias("cost"))
