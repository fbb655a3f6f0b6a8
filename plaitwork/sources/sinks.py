"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_summary(runs: DataFrame, path: str) -> None:
    """(batch, app, test, status, log) as tab-separated text with a header."""
    runs.select("batch", "app", "test", "status", "log").write.mode("overwrite").csv(path, sep="\t", header=True)


def write_results(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Scores, cells, paths or chain scores as Parquet."""
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)


def run_status(bad: str = "n_bad"):
    """passed, or failed with the number of differences."""
    return F.when(F.col(bad) == 0, "passed").otherwise(F.concat(F.lit("failed("), F.col(bad).cast("string"), F.lit(")")))


def write_texts(df: DataFrame, text: str, order: str, path: str) -> None:
    """The texts in order, as text files whose names are in that order; nulls are left out."""
    placed = df.where(F.col(text).isNotNull()).repartitionByRange(order).sortWithinPartitions(order)
    placed.select(text).write.mode("overwrite").text(path)
