"""Checks of results against expected ones, and of paths against the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaitwork.functions import kernels as K
from plaitwork.operators._workers import unclashing, with_results
from plaitwork.operators.align import nw_scores


def mismatches(actual: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, actual, expected) where the two differ or one has no row; nulls are equal to each other, as keys and as values.

    Rows that repeat a key are compared each with each.
    """
    if {k.lower() for k in keys} & {"actual", "expected"}:
        raise ValueError("actual and expected are columns of the result; rename the keys")
    side = lambda df, name: df.select(*[F.col(k).alias(f"__{name}{i}") for i, k in enumerate(keys)], F.col(value).alias(name), F.lit(True).alias(f"__{name}"))
    same = [F.col(f"__actual{i}").eqNullSafe(F.col(f"__expected{i}")) for i in range(len(keys))]
    both = side(actual, "actual").join(side(expected, "expected"), same, "full_outer")
    names = [F.coalesce(f"__actual{i}", f"__expected{i}").alias(k) for i, k in enumerate(keys)]
    return both.where(F.col("__actual").isNull() | F.col("__expected").isNull() | ~F.col("actual").eqNullSafe(F.col("expected"))).select(*names, "actual", "expected")


def verdict(actual: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row (n_bad, passed)."""
    return mismatches(actual, expected, keys, value).agg(F.count(F.lit(1)).alias("n_bad")).withColumn("passed", F.col("n_bad") == 0)


#: Symbols and checkpoints that are checked at once: each takes some 500 bytes.
CHECKED = 300_000


def check_paths(paths: DataFrame, query: str = "query", ref: str = "ref", path: str = "path") -> DataFrame:
    """``paths`` with struct ``check``: valid, bad_ref, bad_query, point_count, score, error. Any best path is valid.

    -1 in a path means no checkpoint there. bad_ref and bad_query are -1 for a valid path, and the two lengths where
    the whole trace isn't a best one. A null checkpoint counts as none.
    """

    def run(v: list) -> list:
        import pyarrow as pa

        done = K.check_paths(*v)
        whole = lambda c: pa.array(done[c], pa.int32())
        error = pa.array([*K.PATH_ERRORS, None]).take(pa.array(done["error"] % (len(K.PATH_ERRORS) + 1)))
        columns = [pa.array(done["valid"]), *map(whole, ("bad_ref", "bad_query", "point_count", "score")), error]
        return [pa.StructArray.from_arrays(columns, ["valid", "bad_ref", "bad_query", "point_count", "score", "error"])]

    fields = "check struct<valid: boolean, bad_ref: int, bad_query: int, point_count: int, score: int, error: string>"
    unclashing(paths, ["__path"])
    filled = paths.withColumn("__path", F.transform(path, lambda x: F.coalesce(x, F.lit(-1)).cast("int")))
    return with_results(filled, [query, ref, "__path"], fields, run, CHECKED).drop("__path")


def suboptimal_paths(paths: DataFrame, query: str = "query", ref: str = "ref", path: str = "path") -> DataFrame:
    """The rows of ``paths`` whose traced score isn't the optimum, with ``check`` and ``expected``, the optimum."""
    return nw_scores(check_paths(paths, query, ref, path), query, ref, "expected").where(F.col("check.score") != F.col("expected"))
