"""Running numpy kernels over Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from plaitwork.functions.kernels import Texts, codes

#: Rows, and symbols of their texts, that a kernel gets at once.
BATCH, SYMBOLS = 4_096, 4_000_000


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(lo, hi) of consecutive rows of at most ``most`` in all, or of one row; ``ends`` are running sums over the rows."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def rows_of(values: list[np.ndarray]):
    """An Arrow array of lists from arrays of whole numbers."""
    import pyarrow as pa

    sizes = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.concatenate([np.empty(0, np.int32), *values]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat))


def grids_of(values: list[np.ndarray]):
    """An Arrow array of lists of lists from matrices."""
    import pyarrow as pa

    inner = rows_of([row for x in values for row in x])
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), inner)


def unclashing(df: DataFrame, names: list[str]) -> None:
    """Raises if ``df`` has one of the columns that an operator adds."""
    if taken := {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError(f"columns are there already: {', '.join(sorted(taken))}; rename them or choose other names")


def texts_of(column) -> Texts:
    """The symbols of an Arrow column without nulls: a batch's bytes are decoded at once, no cell becomes a Python string."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = column.type
    if pa.types.is_list(kind):
        return Texts(column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()))
    large, text = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind), pa.types.is_string(kind) or pa.types.is_large_string(kind)
    if not len(column) or not (text or large or pa.types.is_binary(kind)):
        return Texts.of(column.to_pylist())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = memoryview(data)[int(ends[0]) : int(ends[-1])] if data is not None else b""
    if not text:
        return Texts(np.frombuffer(raw, np.uint8).astype(np.int32), np.diff(ends))
    return Texts(codes(str(raw, "utf-8", "surrogatepass")), pc.utf8_length(column).to_numpy())


def with_results(df: DataFrame, inputs: list[str], fields: str, kernel: Callable[[list[Texts]], list], symbols: int = SYMBOLS) -> DataFrame:
    """``df`` with the columns ``fields`` that ``kernel`` makes from the input columns' texts, a numpy or Arrow array each.

    The columns of ``df`` pass through tasks unchanged; one that has the name of a new one is an error. A row with a
    null input gets nulls. The kernel gets rows of about ``symbols`` in all at once, or one longer row.
    """
    prepare(df.sparkSession)
    added = StructType.fromDDL(fields)
    names = added.names
    unclashing(df, names)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [to_arrow_schema(added).field(n).type for n in names]
        def length(c: str) -> np.ndarray:
            kind = whole.schema.field(c).type
            sizes = (pc.list_value_length if pa.types.is_list(kind) else pc.binary_length)(whole.column(c))
            return pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)

        for whole in batches:
            # A row counts at least as much as fills a batch with ``BATCH`` rows.
            ends = np.cumsum(np.maximum(sum(map(length, inputs)), symbols // BATCH)) if whole.num_rows else np.zeros(0, np.int64)
            for lo, hi in slices(ends, symbols):
                batch = whole.slice(lo, hi - lo)
                full = np.ones(batch.num_rows, bool)
                for c in inputs:
                    full &= pc.is_valid(batch.column(c)).to_numpy(zero_copy_only=False)
                some = batch.filter(pa.array(full)) if not full.all() else batch
                made = kernel([texts_of(some.column(c)) for c in inputs])
                # A null place gives a null result.
                places = pa.array(np.cumsum(full) - 1, pa.int64(), mask=~full)
                out = [(x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x)).cast(kind).take(places) for x, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))
