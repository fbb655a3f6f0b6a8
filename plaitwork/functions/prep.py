"""Length and layout arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the linear congruential generator of lengths.
LCG_A, LCG_C, LCG_M, SEED_MASK = 1_664_525, 1_013_904_223, 2**32, 0x13579BDF


def ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b).cast("int")


def clamp_bounds(lo: Column, hi: Column) -> tuple[Column, Column]:
    """(min, max) with min at least 1 and at most max."""
    low = F.greatest(F.lit(1), F.least(lo, hi))
    return low, F.greatest(low, hi)


def quantise(length: Column, quantum: Column, lo: Column, hi: Column) -> Column:
    """``length`` rounded up to a multiple of ``quantum`` inside the bounds; a quantum of 1 changes nothing."""
    top = F.greatest(quantum, F.floor(hi / quantum).cast("int") * quantum)
    return F.when(quantum == 1, length).otherwise(F.greatest(lo, F.least(ceil_div(length, quantum) * quantum, top)))


def lcg_lengths(seed: Column, n: Column, lo: Column, hi: Column, quantum: Column) -> Column:
    """Array of ``n`` lengths drawn by the generator; equal bounds give that length without a draw."""
    low, high = clamp_bounds(lo, hi)
    state = F.struct(seed.bitwiseXOR(F.lit(SEED_MASK)).cast("bigint").alias("s"), F.array().cast("array<int>").alias("out"))

    def draw(acc: Column, _: Column) -> Column:
        s = F.pmod(acc["s"] * LCG_A + LCG_C, F.lit(LCG_M))
        # One element, so that the new state is computed once.
        return F.get(F.transform(F.array(s), lambda x: F.struct(x.alias("s"), F.concat(acc["out"], F.array(quantise((low + F.pmod(x, (high - low + 1).cast("bigint"))).cast("int"), quantum, low, high))).alias("out"))), 0)

    drawn = F.aggregate(F.sequence(F.lit(1), n), state, draw, lambda acc: acc["out"])
    return F.when(low == high, F.array_repeat(low, n)).otherwise(drawn)


def copied_length(query_length: Column) -> Column:
    """A ref's length where it is drawn once for both sides of a pair."""
    return query_length.cast("int")


def pad_tail(text: Column, length: Column, symbol: str) -> Column:
    return F.rpad(text, length, symbol)


def team_size(length: Column, threshold: Column, tiles: Column) -> Column:
    return F.least(F.greatest(ceil_div(length, threshold), F.lit(1)), tiles).cast("int")


def owned_columns(length: Column, threshold: Column, lane: Column) -> Column:
    """struct(lo, hi): the half-open range of ref columns that a lane of the team works on."""
    return F.struct(F.least(lane * threshold, length).cast("int").alias("lo"), F.least((lane + 1) * threshold, length).cast("int").alias("hi"))


def band_limits(i: Column, length: Column, band: int) -> Column:
    """struct(lo, hi): the half-open range of ref columns inside the band of query row ``i``."""
    return F.struct(F.least(i, length).cast("int").alias("lo"), F.least(length, i + band).cast("int").alias("hi"))
