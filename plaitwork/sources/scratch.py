"""Scratch tables in the folder that the cluster shares; they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="spark-plaitwork-")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; only a local master without that setting gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a scratch folder and read again."""
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch folders that nothing reads any more: those named, or all of the session's."""
    gone = {p for s, p in _made if s is spark and (not paths or p in paths)}
    for path in gone:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made[:] = [(s, p) for s, p in _made if p not in gone]


def dropped(spark: SparkSession, table: DataFrame) -> None:
    """Deletes the scratch folders of a staged table that nothing reads any more."""
    own = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in table.inputFiles()}
    drop_scratch(spark, *([p for _, p in _made if p.split(":", 1)[-1].lstrip("/") in own] or ["-"]))


@atexit.register
def _clean() -> None:
    for spark in {s for s, _ in _made}:
        try:
            drop_scratch(spark)
        except Exception:  # the session is gone
            return
