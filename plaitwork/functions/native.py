"""The recurrences as SQL folds: no Python worker, fit for short texts inside any expression.

A row is built symbol by symbol, so a pair costs its cells times its ref's length; use the operators for
texts over some 64 symbols. Null in, null out; an empty side gives 0 locally and the other's length below zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaitwork.functions.kernels import ANCHOR_SCORE, GAP, MATCH, MISMATCH


def symbols(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def symbol_score(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(MATCH)).otherwise(F.lit(MISMATCH))


def _next_row(row: Column, symbol: Column, ref: Column, head: Column, floor: int | None) -> Column:
    def cell(acc: Column, j: Column) -> Column:
        best = [F.get(row, j) + symbol_score(symbol, F.get(ref, j)), F.get(row, j + 1) - GAP, F.element_at(acc, -1) - GAP]
        return F.concat(acc, F.array(F.greatest(*best, *([] if floor is None else [F.lit(floor)]))))

    places = F.when(F.size(ref) > 0, F.sequence(F.lit(0), F.size(ref) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.array(head), cell)


def sw_score(query: Column, ref: Column) -> Column:
    """Best local alignment score."""
    r = symbols(ref)
    zero = F.struct(F.array_repeat(F.lit(0), F.length(ref) + 1).alias("row"), F.lit(0).alias("best"))

    def step(acc: Column, symbol: Column) -> Column:
        # The new row is bound by a transform of one element, so that it is computed once.
        rows = F.transform(F.array(_next_row(acc["row"], symbol, r, F.lit(0), 0)), lambda h: F.struct(h.alias("row"), F.greatest(acc["best"], F.array_max(h)).alias("best")))
        return F.get(rows, 0)

    return F.when(query.isNotNull() & ref.isNotNull(), F.aggregate(symbols(query), zero, step, lambda acc: acc["best"]))


def nw_last_row(query: Column, ref: Column) -> Column:
    """Global scores of the whole query with every prefix of the ref."""
    r = symbols(ref)
    zero = F.struct(F.transform(F.sequence(F.lit(0), F.length(ref)), lambda j: -j * GAP).alias("row"), F.lit(0).alias("i"))
    step = lambda acc, symbol: F.struct(_next_row(acc["row"], symbol, r, -(acc["i"] + 1) * GAP, None).alias("row"), (acc["i"] + 1).alias("i"))
    return F.when(query.isNotNull() & ref.isNotNull(), F.aggregate(symbols(query), zero, step, lambda acc: acc["row"]))


def nw_score(query: Column, ref: Column) -> Column:
    """Global alignment score."""
    return F.element_at(nw_last_row(query, ref), -1)


def best_split(forward: Column, backward: Column) -> Column:
    """struct(score, at): the best of forward[k] + backward[span - k], and the smallest such k."""
    total = F.zip_with(forward, F.reverse(backward), lambda a, b: a + b)
    return F.struct(F.array_max(total).alias("score"), (F.array_position(total, F.array_max(total)) - 1).cast("int").alias("at"))


def chain_gain(dx: Column, dy: Column) -> Column:
    return F.least(dx, dy, F.lit(ANCHOR_SCORE)).cast("int")


def chain_gap_cost(dx: Column, dy: Column) -> Column:
    """Truncated from a 32-bit float, which is not what exact decimals would give."""
    return (F.lit(0.01).cast("float") * F.lit(ANCHOR_SCORE).cast("float") * F.abs(dy - dx).cast("float")).cast("int")
