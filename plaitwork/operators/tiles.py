"""Scores of pairs too long for one task: the matrix in tiles, an anti-diagonal of tiles a step.

A pair's matrix is cut into tiles of ``size`` rows and columns. Tiles of one anti-diagonal depend on the borders of those before only, so each
step scores all of them, of all pairs, in tasks of their own. A step moves the last row and column of each tile and the parts
of the texts that it compares, never a matrix; borders are written to scratch at each step, so a lost executor costs that step only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plaitwork.functions import kernels as K
from plaitwork.operators._workers import prepare, slices, texts_of
from plaitwork.sources.scratch import dropped, staged

#: Symbols of a tile's sides: some seconds of work and 64 kB of borders for each tile.
SIZE = 8_192

#: Symbols of both texts that a task advances at once, and about as many query symbols for each task of a step.
SYMBOLS, TASK = 500_000, 4_000_000


def _last(text: str, size: int) -> Column:
    """The place of a text's last part; an empty one has one empty part."""
    return F.greatest(F.floor((F.length(text) - 1) / size), F.lit(0)).cast("int")


def _parts(pairs: DataFrame, text: str, place: str, end: str, size: int) -> DataFrame:
    """(id, place, text, end): a text in parts of ``size`` symbols, each with the place of the other text's last part."""
    each = pairs.select("id", text, end, F.explode(F.sequence(F.lit(0), _last(text, size))).alias(place))
    return each.select("id", place, F.substring(text, F.col(place) * size + 1, F.lit(size)).alias(text), end)


#: What a tile is given, from both texts and the tiles above and before it.
_GIVEN = {"last_i": "int", "last_j": "int", "query": "string", "ref": "string", "top": "array<bigint>", "side": "array<bigint>"}


def _sent(df: DataFrame, ti: Column, tj: Column, **given: str) -> DataFrame:
    """Rows for the tile (ti, tj): ``given`` names the columns that this side knows, others are null."""
    own = [F.col(given[c]).alias(c) if c in given else F.lit(None).cast(t).alias(c) for c, t in _GIVEN.items()]
    return df.select("id", ti.cast("int").alias("ti"), tj.cast("int").alias("tj"), *own)


def wavefront_scores(pairs: DataFrame, keys: list[str], query: str = "query", ref: str = "ref", out: str = "score", local: bool = True, size: int = SIZE) -> DataFrame:
    """(``keys``, ``out``): the local or global score of each pair, as a long, with every pair's tiles over all tasks.

    Keys tell pairs apart. A pair with a null side has a null score. Steps: as many as the longest pair has anti-diagonals of tiles.
    What a tile needs is sent to it by hash, so nothing is broadcast, however many pairs there are.
    """
    if size < 1:
        raise ValueError("a tile has 1 or more symbols a side")
    spark = pairs.sparkSession
    prepare(spark)
    named = pairs.select(F.struct(*keys).alias("id"), F.col(query).alias("query"), F.col(ref).alias("ref"))
    whole = named.where("query is not null and ref is not null").withColumn("last_i", _last("query", size)).withColumn("last_j", _last("ref", size))
    q_parts, r_parts = staged(_parts(whole, "query", "ti", "last_j", size), "query-parts"), staged(_parts(whole, "ref", "tj", "last_i", size), "ref-parts")
    steps, symbols = q_parts.agg(F.max(F.col("ti") + F.col("last_j")), F.sum(F.length("query") + 1)).first()
    id_field = q_parts.schema["id"]
    made = StructType([id_field, *StructType.fromDDL("ti int, tj int, last_i int, last_j int, bottom array<bigint>, right array<bigint>, best bigint, corner bigint").fields])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            # Borders have as many values as texts have symbols, and a tile more.
            ends = np.cumsum(sum(texts_of(whole.column(c)).sizes for c in ("query", "ref")) + 2) if whole.num_rows else np.zeros(0, np.int64)
            for lo, hi in slices(ends, SYMBOLS):
                batch = whole.slice(lo, hi - lo)
                place = lambda c: batch.column(c).to_numpy().astype(np.int64)  # noqa: B023, E731
                # The matrix's own edges where no tile is above or before.
                edge = lambda c, first: None if batch.column(c).null_count == batch.num_rows and local else _borders(batch.column(c), first)  # noqa: B023, E731
                bottom, right, best, corner = K.tiles(*[texts_of(batch.column(c)) for c in ("query", "ref")], edge("top", place("tj") * size), edge("side", place("ti") * size), local)
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(flat)) for flat, n in (bottom, right)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "ti", "tj", "last_i", "last_j")], *lists, pa.array(best), pa.array(corner)], names=made.names)

    # Tasks are more where there is more to do.
    groups = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), (symbols or 0) // TASK)
    scores, before = [], None
    for step in range((-1 if steps is None else steps) + 1):
        i, j = F.col("ti"), F.col("tj")
        sent = [
            _sent(q_parts.where(F.lit(step) - i >= 0).where(F.lit(step) - i <= F.col("last_j")), i, F.lit(step) - i, query="query", last_j="last_j"),
            _sent(r_parts.where(F.lit(step) - j >= 0).where(F.lit(step) - j <= F.col("last_i")), F.lit(step) - j, j, ref="ref", last_i="last_i"),
        ]
        if before is not None:
            sent += [_sent(before.where("ti < last_i"), i + 1, j, top="bottom"), _sent(before.where("tj < last_j"), i, j + 1, side="right")]
        every = reduce(DataFrame.unionByName, sent).repartition(groups, "id", "ti", "tj")
        tiles = every.groupBy("id", "ti", "tj").agg(*[F.first(c, ignorenulls=True).alias(c) for c in _GIVEN])
        now = staged(tiles.mapInArrow(run, made), "tile-borders")
        scores.append(now.select("id", *[F.col(c) if local else F.expr(f"case when ti = last_i and tj = last_j then {c} end").alias(c) for c in ("best" if local else "corner",)]))
        if before is not None and len(scores) > 1:
            # What later steps and the result need of a step is its best cells or corners.
            old = staged(scores[-2], "tile-scores")
            dropped(spark, before)
            scores[-2] = old
        before = now
    if not scores:
        return named.select("id.*", F.lit(None).cast("long").alias(out))
    value = F.greatest(F.max("best"), F.lit(0)) if local else F.max("corner")
    found = reduce(DataFrame.unionByName, scores).groupBy("id").agg(value.alias(out))
    a, b = named.select("id").alias("a"), found.hint("merge").alias("b")
    return a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")), "left").select("a.id.*", out)


def _borders(column, first):
    """(flat, starts, first): the rows' borders one after another, where each begins, or -1 for a null one, and what a global one without a tile begins with."""
    import numpy as np
    import pyarrow.compute as pc

    there = pc.is_valid(column).to_numpy(zero_copy_only=False)
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), np.where(there, np.cumsum(n) - n, -1), -first * K.GAP
