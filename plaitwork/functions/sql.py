"""The operators under SQL names: functions of two texts, and table functions for paths, matrices and chains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from plaitwork.functions import kernels as K
from plaitwork.operators._workers import prepare
from plaitwork.operators.chain import scored_runs

#: Cells of a strip of a matrix, and anchors that are scored at a time.
WIDTH, BATCH = 4_096, 4_096


def _both(kernel):
    """A function of two text columns, where a null side gives null."""

    def run(query: pd.Series, ref: pd.Series) -> pd.Series:
        full = (query.notna() & ref.notna()).to_numpy()
        out = pd.Series([None] * len(query), dtype="object")
        if full.any():
            made = kernel(K.Texts.of([*query[full]]), K.Texts.of([*ref[full]]))
            out[full] = pd.Series(list(made), index=out.index[full], dtype="object")
        return out

    return run


def _fields(kernel, names: list[str]):
    """A function of two text columns with some results a row; a null side gives nulls."""

    def run(query: pd.Series, ref: pd.Series) -> pd.DataFrame:
        made = _both(lambda q, r: [*zip(*kernel(q, r), strict=True)])(query, ref)
        return pd.DataFrame([x if x is not None else (None,) * len(names) for x in made], columns=names)

    return run


def _split(queries: K.Texts, refs: K.Texts) -> tuple[list, list]:
    """(scores, rows): the query index that a best path crosses in the middle of the ref, the smallest of equals."""
    n, zero = refs.sizes, np.zeros(len(refs), np.int64)
    at, mid = np.arange(len(refs)), refs.sizes // 2
    ahead, back = K.last_columns(queries, refs.slices(at, zero, mid)), K.last_columns(queries.turned(), refs.slices(at, mid, n).turned())
    totals = [f + b[::-1] for f, b in zip(ahead, back, strict=True)]
    return [int(t.max()) for t in totals], [int(t.argmax()) for t in totals]


class _Path:
    """(ref_idx, query_idx) for each ref column."""

    def eval(self, query: str, ref: str):
        if query is not None and ref is not None:
            for j, i in enumerate(K.envelope_paths([query], [ref])[1][0].tolist()):
                yield j, i


class _Strips:
    """(i, j, h): rows of the global matrix in strips; of a long pair one row is held at a time."""

    suffix = False

    def eval(self, query: str, ref: str):
        if query is not None and ref is not None:
            for _, i, h in K.strips([query], [ref], WIDTH, self.suffix):
                for at in range(0, len(h), WIDTH):
                    yield i, at, h[at : at + WIDTH].tolist()


class _SuffixStrips(_Strips):
    suffix = True


class _Chain:
    """The rows of a table partitioned by chain and ordered by idx, with score; only the last anchors of a chain are held."""

    def __init__(self) -> None:
        self.rows, self.carry, self.lookback = [], None, None

    @staticmethod
    def analyze(table: AnalyzeArgument, lookback: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or not {"x", "y"} <= {f.name for f in table.dataType}:
            raise ValueError("chain_scores takes a table with columns x and y, partitioned by chain and ordered by idx")
        return AnalyzeResult(StructType(table.dataType.fields).add("score", IntegerType()))

    def eval(self, row, lookback: int):
        self.lookback = lookback
        self.rows.append(row)
        if len(self.rows) >= BATCH:
            yield from self._scored()

    def terminate(self):
        if self.rows:
            yield from self._scored()

    def _scored(self):
        x, y = ([r[c] for r in self.rows] for c in ("x", "y"))
        there = np.array([a is not None and b is not None for a, b in zip(x, y, strict=True)])
        whole = lambda v: np.array([a if a is not None else 0 for a in v], np.int64)
        score, self.carry = scored_runs(np.zeros(len(x), np.int64), whole(x), whole(y), there, self.carry, self.lookback)
        rows, self.rows = self.rows, []
        for r, s in zip(rows, score.tolist(), strict=True):
            yield (*r, s)


def register(spark: SparkSession) -> None:
    """Names for ``spark.sql``.

    Functions of (query, ref): sw_score, nw_score, sw_banded_score (with band), sw_argmax (score, i, j), nw_path, nw_steps, nw_last_column,
    nw_split (score, split), check_path (with a path). Table functions: nw_path_cells, nw_strips and nw_suffix_strips of (query, ref), for lateral
    joins; chain_scores(table(anchors) partition by chain_id order by idx, lookback).
    """
    prepare(spark)

    def scalar(name: str, kernel, kind: str) -> None:
        run = _both(kernel)

        def typed(query: pd.Series, ref: pd.Series) -> pd.Series:
            return run(query, ref)

        spark.udf.register(name, F.pandas_udf(typed, kind))

    def struct(name: str, kernel, fields: str) -> None:
        run = _fields(kernel, StructType.fromDDL(fields).names)

        def typed(query: pd.Series, ref: pd.Series) -> pd.DataFrame:
            return run(query, ref)

        spark.udf.register(name, F.pandas_udf(typed, fields))

    scalar("sw_score", K.local_scores, "int")
    scalar("nw_score", K.global_scores, "int")
    scalar("nw_path", lambda q, r: [x.tolist() for x in K.envelope_paths(q, r)[1]], "array<int>")
    scalar("nw_steps", lambda q, r: [x.decode() for x in K.alignments(q, r)[1]], "string")
    scalar("nw_last_column", lambda q, r: [x.tolist() for x in K.last_columns(q, r)], "array<int>")
    struct("sw_argmax", lambda q, r: K.local_argmax(q, r).T.tolist(), "score int, i int, j int")
    struct("nw_split", _split, "score int, split int")

    def banded(query: pd.Series, ref: pd.Series, band: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(query), dtype="object")
        for width in band.dropna().unique():
            own = (band == width).to_numpy()
            out[own] = _both(lambda q, r, w=int(width): K.banded_scores(q, r, w))(query[own].reset_index(drop=True), ref[own].reset_index(drop=True)).to_numpy()
        return out

    spark.udf.register("sw_banded_score", F.pandas_udf(banded, "int"))

    names = ["valid", "bad_ref", "bad_query", "point_count", "score", "error"]

    def checked(query: pd.Series, ref: pd.Series, path: pd.Series) -> pd.DataFrame:
        full = (query.notna() & ref.notna() & path.notna()).to_numpy()
        out = pd.DataFrame(None, index=range(len(query)), columns=names, dtype="object")
        if full.any():
            points = [np.array([-1 if i is None or i != i else i for i in p], np.int32) for p in path[full]]
            made = K.check_paths([*query[full]], [*ref[full]], points)
            made["error"] = np.array([*K.PATH_ERRORS, None], dtype="object")[made["error"]]
            for c in names:
                out.loc[full, c] = made[c].astype("object")
        return out

    spark.udf.register("check_path", F.pandas_udf(checked, "valid boolean, bad_ref int, bad_query int, point_count int, score int, error string"))
    spark.udtf.register("nw_path_cells", F.udtf(_Path, returnType="ref_idx int, query_idx int"))
    spark.udtf.register("nw_strips", F.udtf(_Strips, returnType="i int, j int, h array<int>"))
    spark.udtf.register("nw_suffix_strips", F.udtf(_SuffixStrips, returnType="i int, j int, h array<int>"))
    spark.udtf.register("chain_scores", F.udtf(_Chain))
