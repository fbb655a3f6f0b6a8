"""Seeded inputs: lengths by the linear congruential generator, and random anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaitwork.functions import prep


def lengths(df: DataFrame, key: str, seed: str, n: int, lo: int, hi: int, quantum: int = 1) -> DataFrame:
    """(key, nr, len): ``n`` lengths for each row, from its own seed."""
    drawn = prep.lcg_lengths(F.col(seed), F.lit(n), F.lit(lo), F.lit(hi), F.lit(quantum))
    return df.select(F.col(key), F.posexplode(drawn).alias("nr", "len"))


def anchors(spark: SparkSession, chains: int, length: int, seed: int = 0) -> DataFrame:
    """(chain_id, idx, x, y): x grows by 1 to 10 an anchor, y is anywhere below x plus the chain's length."""
    base = spark.range(chains * length).select((F.col("id") / length).cast("int").alias("chain_id"), F.pmod("id", F.lit(length)).cast("int").alias("idx"))
    drawn = base.withColumn("__step", F.floor(F.rand(seed) * 10).cast("int") + 1).withColumn("__y", F.rand(seed + 1))
    x = F.sum("__step").over(Window.partitionBy("chain_id").orderBy("idx"))
    return drawn.withColumn("x", x.cast("int")).withColumn("y", F.floor(F.col("__y") * (F.col("x") + length)).cast("int")).select("chain_id", "idx", "x", "y")
