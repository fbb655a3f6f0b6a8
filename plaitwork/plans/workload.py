"""The test tables as pairs and anchors. Whole tables and whole texts are used.

Pairs are dealt by their keys before they are scored, so that one file, or one long document, is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaitwork.operators.schedule import spread
from plaitwork.sources.records import RECORD, cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record_pairs(spark: SparkSession, sf_dir: str, size: int = RECORD) -> DataFrame:
    """(doc_id, rec, query, ref): every ``size``-symbol record of every text with the one that follows it."""
    held = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(cut(F.col("text"), size))).alias("recs"))
    nexts = F.transform("recs", lambda x, i: F.struct(x.alias("query"), F.get("recs", i + 1).alias("ref")))
    each = held.select("doc_id", F.posexplode(nexts).alias("rec", "p"))
    return spread(each.select("doc_id", "rec", "p.query", "p.ref").where("ref is not null"), ["doc_id", "rec"])


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, query, ref): the whole text of every turn with that of the next turn, by an equi-join."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("query"))
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("query").alias("ref"))
    return spread(turns.join(later, ["conv_id", "turn"]), ["conv_id", "turn"])


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, query, ref): every part's name with its type in lower case, of different lengths."""
    return spread(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("query"), F.lower("p_type").alias("ref")), ["p_partkey"])


def event_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain_id, idx, x, y): a user's events in order, at 10 times the property k plus the whole part of the value."""
    k = F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1).try_cast("bigint")
    y = (k * 10 + F.expr("try_cast(value as bigint)")).alias("y")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("chain_id"), F.col("event_id").alias("idx"), F.col("event_id").alias("x"), y)
