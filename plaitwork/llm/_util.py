"""Helpers shared by the operators: scratch tables, worker imports, words, connected components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of digits, lower-case letters a-z and anything outside ASCII.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_made: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a local master gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return root.rstrip("/")


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="spark-plaitwork-")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more; without any, all of this session's scratch tables.

    Call it without tables once a query's result is written: until then the result may still read them.
    """
    gone = {p for t in tables for p in _paths(t)} if tables else {p for s, p in _made if s is spark}
    for path in gone:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made[:] = [(s, p) for s, p in _made if p not in gone]


def _paths(table: DataFrame) -> list[str]:
    """The scratch folders that a staged table's files are in."""
    own = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in table.inputFiles()}
    return [p for _, p in _made if p.split(":", 1)[-1].lstrip("/") in own]


@atexit.register
def _clean() -> None:
    for spark in {s for s, _ in _made}:
        try:
            drop_scratch(spark)
        except Exception:  # the session is gone
            return


def words(text: Column) -> Column:
    """Array of the words of ``text`` with A-Z in lower case; no words for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD_PATTERN), F.lit(0))


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` computed once a row: later lambdas read it instead of computing it anew."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken, name = {c.lower() for c in df.columns}, f"__{name}"
    while name in taken:
        name += "_"
    return name


def text_key(id_col: str, text_col: str) -> list[Column]:
    """96 bits of hash of a row's id and text, in two columns: what is found for a row is never put on another of its id."""
    return [F.xxhash64(id_col, text_col), F.hash(id_col, text_col)]


def word_hashes(text: Column) -> Column:
    """64-bit hashes of ``words(text)``, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges(a, b)``; component is the smallest node reached.

    Each round hooks every node to its neighbour of least priority, if that is below its own, twice
    over, and contracts the graph. Priority is the node itself for two rounds, which settles stars
    around their least node, then a hash, with which a constant part of the nodes of any graph vanishes a
    round. Minima are pre-aggregated, so a hub is no hot group; the edges of each round are staged.
    """
    e = staged(
        edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    labels, turn = None, 0
    while not e.isEmpty():
        both = e.select(F.col("a").alias("n"), F.col("b").alias("m")).unionAll(e.select(F.col("b").alias("n"), F.col("a").alias("m")))
        rank = lambda c: F.struct((F.lit(0).cast("long") if turn < 2 else F.xxhash64(F.col(c), F.lit(turn))).alias("r"), F.col(c).alias("v"))  # noqa: B023, E731
        best = both.groupBy("n").agg(F.min(rank("m")).alias("best"))
        once = staged(best.select("n", F.when(F.col("best") < rank("n"), F.col("best.v")).otherwise(F.col("n")).alias("p")), "hooks")
        hook = once.join(once.select(F.col("n").alias("p"), F.col("p").alias("pp")), "p").select("n", F.col("pp").alias("p"))
        hook = staged(hook, "hooks")
        left, right = hook.select(F.col("n").alias("a"), F.col("p").alias("pa")), hook.select(F.col("n").alias("b"), F.col("p").alias("pb"))
        before, e = e, staged(
            e.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "edges",
        )
        if labels is None:
            labels = hook.select(F.col("n").alias("node"), F.col("p").alias("label"))
            drop_scratch(e.sparkSession, before, once)
        else:
            old, labels = labels, staged(
                labels.join(hook, labels.label == hook.n, "left").select("node", F.coalesce("p", "label").alias("label")),
                "labels",
            )
            drop_scratch(e.sparkSession, before, once, hook, old)
        turn += 1
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
