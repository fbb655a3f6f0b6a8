"""Sequence records from text: pairs of tokens (label, sequence), of which 32 symbols count."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A fixed value of the format.
RECORD = 32


def token_records(text: Column) -> Column:
    """array of struct(label, seq) of the white-space separated tokens; an odd last token is left out."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    at = F.when(F.size(tokens) >= 2, F.sequence(F.lit(0), F.size(tokens) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    # Bound by a transform of one element, so that the tokens are found once.
    made = F.transform(F.array(F.struct(tokens.alias("t"), at.alias("at"))), lambda b: F.transform(b["at"], lambda i: F.struct(F.get(b["t"], i).alias("label"), F.substring(F.get(b["t"], i + 1), 1, RECORD).alias("seq"))))
    return F.get(made, 0)


def records(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rec_no, label, seq), a row for each record of each text."""
    return df.select(F.col(key), F.explode(F.array(token_records(F.col(text)))).alias("r")).select(key, F.posexplode("r").alias("rec_no", "r")).select(key, "rec_no", "r.label", "r.seq")


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, int, str | None]:
    """((t, at, label), total, last): each line's tokens, the place of the first in the stream and the token before it; all tokens, and the last.

    Files are read in splits, a line a row. The order of lines is that of file, split and row; tokens are counted by split, so no file is ever
    one row or one task's work. Places inside a split are counted on as its lines are read, so lines are never brought together by split.
    """
    lines = spark.read.text(path).select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("part"),
        F.monotonically_increasing_id().alias("line"),  # grows along a split
        F.filter(F.split("value", r"\s+"), lambda t: t != "").alias("t"),
    ).where("size(t) > 0")
    counted = lines.groupBy("part").agg(F.sum(F.size("t")).alias("n"), F.max_by(F.element_at("t", -1), "line").alias("last"))
    # A row for each split: what stands before it.
    order = Window.orderBy("part")
    splits = counted.select("part", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("last").over(order).alias("last"))
    total, last = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max_by("last", "part")).first()
    # A row for each split, which is small beside the split.
    placed = _counted_on(lines).join(F.broadcast(splits), "part").select(
        "t", (F.col("before") + F.col("__at")).alias("at"), F.coalesce("__label", "last").alias("label")
    )
    return placed, int(total), last


def _counted_on(lines: DataFrame) -> DataFrame:
    """``lines`` with __at, the tokens of their split before them, and __label, the last of these; a task has a split's lines together, in order."""
    schema = StructType([*lines.schema.fields, *StructType.fromDDL("__at bigint, __label string").fields])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        part, count, label = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            places = pc.struct_field(batch.column("part"), "start").to_numpy(), pc.dictionary_encode(pc.struct_field(batch.column("part"), "file")).indices.to_numpy()
            t = batch.column("t")
            sizes = pc.list_value_length(t).to_numpy().astype(np.int64)
            new = np.r_[batch.column("part")[0].as_py() != part, (places[0][1:] != places[0][:-1]) | (places[1][1:] != places[1][:-1])]
            before = np.cumsum(sizes) - sizes
            # What the batch had before the first line of each line's split; a split that goes on counts from what it had.
            at = before - before[new][np.cumsum(new) - 1] if new[0] else np.where(np.cumsum(new) > 0, before - np.r_[0, before[new]][np.cumsum(new)], before + count)
            ends = t.flatten().take(pa.array(np.cumsum(sizes) - 1))
            labels = pa.concat_arrays([pa.array([label], ends.type), ends.slice(0, len(ends) - 1)])
            labels = pc.if_else(pa.array(new), pa.scalar(None, ends.type), labels)
            part, count, label = batch.column("part")[-1].as_py(), int(at[-1] + sizes[-1]), ends[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), labels], names=schema.names)

    return lines.mapInArrow(run, schema)


def read_records(spark: SparkSession, path: str, need: int | None = None) -> DataFrame:
    """(rec_no, label, seq) of one record file, or of a folder's files in order of name as one; raises if it has fewer than ``need`` records.

    A record can span lines, splits and files. The last token of an odd number is left out.
    """
    placed, total, _ = _lines(spark, path)
    if need is not None and total // 2 < need:
        raise ValueError(f"{path} has {total // 2} records; {need} are needed")
    # A line that starts with a sequence brings its label from the line before.
    whole = F.when(F.col("at") % 2 == 1, F.concat(F.array("label"), F.col("t"))).otherwise(F.col("t"))
    held = placed.select(F.floor(F.col("at") / 2).alias("first"), F.explode(F.array(whole)).alias("t"))
    starts = F.when(F.size("t") >= 2, F.sequence(F.lit(0), F.size("t") - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    each = held.select("first", "t", F.posexplode(starts).alias("k", "i"))
    return each.select((F.col("first") + F.col("k")).cast("bigint").alias("rec_no"), F.get("t", F.col("i")).alias("label"), F.substring(F.get("t", F.col("i") + 1), 1, RECORD).alias("seq"))


def read_wrapped(spark: SparkSession, path: str, wanted: int) -> DataFrame:
    """(rec_no, label, seq) for records 0 to ``wanted`` - 1 of the files read over and over: after the last token comes the first.

    So with an odd number of tokens every second reading takes labels for sequences. A token gives its records itself, with the token
    before it, so nothing is joined. Raises where there is nothing to read.
    """
    placed, total, last = _lines(spark, path)
    if wanted > 0 and total == 0:
        raise ValueError(f"{path} has no records; {wanted} are needed")
    each = placed.select("at", F.coalesce("label", F.lit(last)).alias("label"), "t", F.posexplode("t").alias("k", "seq"))
    place, before = F.col("at") + F.col("k"), F.when(F.col("k") == 0, F.col("label")).otherwise(F.get("t", F.col("k") - 1))
    own = each.select(place.alias("place"), before.alias("label"), "seq").where(F.col("place") < 2 * wanted)
    laps = own.select("label", "seq", F.explode(F.sequence(F.col("place"), F.lit(2 * wanted - 1).cast("long"), F.lit(max(1, total)).cast("long"))).alias("p")).where("p % 2 = 1")
    return laps.select(F.floor(F.col("p") / 2).cast("bigint").alias("rec_no"), "label", F.substring("seq", 1, RECORD).alias("seq"))


def cut(text: Column, size: int = RECORD) -> Column:
    """array of the consecutive ``size``-symbol parts of a text; the last may be shorter, an empty text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def concat_records(recs: DataFrame, key: str, chunks: int, seq_len: int) -> DataFrame:
    """(key, seq_no, seq): each ``chunks`` consecutive records joined, cut to ``seq_len`` symbols."""
    numbered = recs.withColumn("seq_no", F.floor(F.col("rec_no") / chunks).cast("int"))
    joined = numbered.groupBy(key, "seq_no").agg(F.array_sort(F.collect_list(F.struct("rec_no", "seq"))).alias("s"))
    return joined.select(key, "seq_no", F.substring(F.array_join(F.col("s.seq"), ""), 1, seq_len).alias("seq"))


def wrap_records(recs: DataFrame, key: str, count: Column, wanted: int) -> DataFrame:
    """(key, slot, rec_no, seq) for slots 0 to ``wanted`` - 1 of each key: record slot % count, read cyclically.

    A record gives its slots itself, so nothing is joined.
    """
    slots = F.when(F.col("rec_no") < wanted, F.sequence(F.col("rec_no"), F.lit(wanted - 1), count)).otherwise(F.array().cast("array<int>"))
    return recs.select(key, F.explode(slots).alias("slot"), "rec_no", "seq")
