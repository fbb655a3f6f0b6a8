"""Pairwise alignment over DataFrames: one row a pair, parallel over pairs.

Each operator adds its result to the columns of ``pairs``; a column of that name already there is an error. Texts are strings, compared by code point, or
binaries, compared by byte. A null side gives a null result; an empty side a local score of 0 or a global score
of the other's length below zero.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plaitwork.functions import kernels as K
from plaitwork.functions import native
from plaitwork.operators._workers import grids_of, prepare, rows_of, texts_of, unclashing, with_results


def sw_scores(pairs: DataFrame, query: str = "query", ref: str = "ref", out: str = "score", method: str = "wavefront") -> DataFrame:
    """Best local score. ``method``: "wavefront" (lots by anti-diagonals), "rows" (same answer pair by pair) or "native" (a SQL fold)."""
    if method == "native":
        unclashing(pairs, [out])
        return pairs.withColumn(out, native.sw_score(F.col(query), F.col(ref)))
    score = {"rows": K.local_scores_by_rows, "wavefront": K.local_scores}[method]
    return with_results(pairs, [query, ref], f"{out} int", lambda v: [score(*v)])


def sw_banded_scores(pairs: DataFrame, band: int, query: str = "query", ref: str = "ref", out: str = "score") -> DataFrame:
    """Best local score inside the band 0 <= j - i < ``band``."""
    if band < 1:
        raise ValueError("a band has 1 or more diagonals")
    return with_results(pairs, [query, ref], f"{out} int", lambda v: [K.banded_scores(*v, band)])


def sw_argmax(pairs: DataFrame, query: str = "query", ref: str = "ref") -> DataFrame:
    """score, i and j of the first best cell by rows, from 0."""
    return with_results(pairs, [query, ref], "score int, i int, j int", lambda v: [*K.local_argmax(*v).T])


def nw_scores(pairs: DataFrame, query: str = "query", ref: str = "ref", out: str = "score", method: str = "wavefront") -> DataFrame:
    """Global score; ``method``: "wavefront" or "native"."""
    if method == "native":
        unclashing(pairs, [out])
        return pairs.withColumn(out, native.nw_score(F.col(query), F.col(ref)))
    return with_results(pairs, [query, ref], f"{out} int", lambda v: [K.global_scores(*v)])


def _matrices(pairs: DataFrame, query: str, ref: str, kernel) -> DataFrame:
    return with_results(pairs, [query, ref], "matrix array<array<int>>", lambda v: [grids_of(kernel(*v))])


def nw_matrix(pairs: DataFrame, query: str = "query", ref: str = "ref") -> DataFrame:
    """The whole global matrix, boundary row and column included; its size is the product of the lengths."""
    return _matrices(pairs, query, ref, K.global_matrices)


def nw_suffix_matrix(pairs: DataFrame, query: str = "query", ref: str = "ref") -> DataFrame:
    """Cell (i, j): the global score of what follows query index i with what follows ref index j."""
    return _matrices(pairs, query, ref, K.suffix_matrices)


def cells(matrices: DataFrame, keys: list[str]) -> DataFrame:
    """A row (``keys``, i, j, h) for each cell."""
    by_row = matrices.select(*keys, F.posexplode("matrix").alias("i", "row"))
    return by_row.select(*keys, "i", F.posexplode("row").alias("j", "h"))


def nw_strips(pairs: DataFrame, keys: list[str], query: str = "query", ref: str = "ref", width: int = 4_096, suffix: bool = False) -> DataFrame:
    """(``keys``, i, j, h): rows of the global matrix, or of the suffix matrix, in strips of at most ``width`` cells from column j on.

    A row of the result is a strip, so no cell of a table holds a matrix; of long pairs a task holds one row of the matrix at a time.
    Pairs with a null side have no strips.
    """
    unclashing(pairs.select(*keys), ["i", "j", "h"])
    prepare(pairs.sparkSession)
    own = pairs.select(*keys, F.col(query).alias("__query"), F.col(ref).alias("__ref")).where("__query is not null and __ref is not null")
    schema = StructType([*own.select(*keys).schema.fields, *StructType.fromDDL("i int, j int, h array<int>").fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            head = batch.select(keys)

            def done(places: list, i: list, j: list, h: list) -> pa.RecordBatch:
                taken = head.take(pa.array(places, pa.int64()))
                return pa.RecordBatch.from_arrays([*taken.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32()), rows_of(h)], names=schema.names)

            texts = [texts_of(batch.column(c)) for c in ("__query", "__ref")]
            places, rows, columns, made, held = [], [], [], [], 0
            for place, i, h in K.strips(*texts, width, suffix):
                for at in range(0, len(h), width):
                    places.append(place)
                    rows.append(i)
                    columns.append(at)
                    made.append(h[at : at + width].copy())
                    held += len(made[-1])
                    if held >= K.LOT_CELLS:
                        yield done(places, rows, columns, made)
                        places, rows, columns, made, held = [], [], [], [], 0
            if made:
                yield done(places, rows, columns, made)

    return own.mapInArrow(run, schema)


def strip_cells(strips: DataFrame, keys: list[str]) -> DataFrame:
    """A row (``keys``, i, j, h) for each cell of strips."""
    each = strips.select(*keys, "i", F.col("j").alias("__first"), F.posexplode("h").alias("__k", "h"))
    return each.select(*keys, "i", (F.col("__first") + F.col("__k")).alias("j"), "h")


def nw_paths(pairs: DataFrame, query: str = "query", ref: str = "ref") -> DataFrame:
    """score and path: for each ref column the smallest query index on any best path."""

    def run(v: list) -> list:
        scores, paths = K.envelope_paths(*v)
        return [scores, rows_of(paths)]

    return with_results(pairs, [query, ref], "score int, path array<int>", run)


def nw_alignments(pairs: DataFrame, query: str = "query", ref: str = "ref") -> DataFrame:
    """score, steps and path of one best alignment, traced from the end with ties diagonal, then up, then left.

    steps has a letter for each step: = for equal symbols, X for others, I for a query symbol alone, D for a ref symbol
    alone. path: for each ref column the smallest query index of the traced path. Long pairs take memory in proportion to their lengths.
    """

    def run(v: list) -> list:
        scores, steps, paths = K.alignments(*v)
        return [scores, [x.decode() for x in steps], rows_of(paths)]

    return with_results(pairs, [query, ref], "score int, steps string, path array<int>", run)


def nw_last_columns(pairs: DataFrame, query: str = "query", ref: str = "ref", out: str = "column") -> DataFrame:
    """Global scores of every query prefix, the empty one first, with the whole ref."""
    return with_results(pairs, [query, ref], f"{out} array<int>", lambda v: [rows_of(K.last_columns(*v))])


def nw_split(pairs: DataFrame, query: str = "query", ref: str = "ref", at: Column | None = None) -> DataFrame:
    """score and split: the query index that a best path crosses at ref index ``at`` (its middle); ties take the smallest."""
    unclashing(pairs, ["score", "split", "__left", "__right", "__query", "__forward", "__backward"])
    middle = F.floor(F.length(ref) / 2).cast("int") if at is None else at
    cut = pairs.withColumn("__left", F.substring(F.col(ref), F.lit(1), middle)).withColumn("__right", F.substring(F.col(ref), middle + 1, F.length(ref)))
    turned = cut.withColumn("__query", F.reverse(F.col(query))).withColumn("__right", F.reverse("__right"))
    both = nw_last_columns(nw_last_columns(turned, query, "__left", "__forward"), "__query", "__right", "__backward")
    best = native.best_split(F.col("__forward"), F.col("__backward"))
    return both.withColumn("score", best["score"]).withColumn("split", best["at"]).select(*pairs.columns, "score", "split")


def nw_segment_scores(pairs: DataFrame, query_from: Column, query_to: Column, ref_from: Column, ref_to: Column, query: str = "query", ref: str = "ref") -> DataFrame:
    """Global score of the half-open slices of both sides; slices can be empty."""
    unclashing(pairs, ["score", "__q", "__r"])
    part = lambda c, lo, hi: F.substring(F.col(c), (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    cut = pairs.withColumn("__q", part(query, query_from, query_to)).withColumn("__r", part(ref, ref_from, ref_to))
    return nw_scores(cut, "__q", "__r").drop("__q", "__r")
