"""How pairs are dealt to tasks: by turns, by cost, and in order of length."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaitwork.functions import prep
from plaitwork.sources.scratch import staged


def round_robin(pairs: DataFrame, groups: int) -> DataFrame:
    return pairs.repartition(groups)


def spread(pairs: DataFrame, keys: list[str], groups: int | None = None) -> DataFrame:
    """``pairs`` dealt by hash of ``keys``, which tell pairs apart: by content, so a task that runs again gets the same rows.

    A stated number of groups (four for each core by default) is not merged into fewer tasks.
    """
    return pairs.repartition(groups or 4 * pairs.sparkSession.sparkContext.defaultParallelism, *keys)


#: Buckets of each class of cells: the unit that is dealt. Classes are powers of two, so a bucket has a known bound of rows to deal.
BUCKETS = 512


def cell_buckets(pairs: DataFrame, query: str = "query", ref: str = "ref", bucket: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """``pairs`` with __cells, __class (the power of two of the cells) and __bucket.

    bucket: a whole number for each pair; by default from the hash of ``keys``, which tell pairs apart, or of the texts.
    """
    own = bucket if bucket is not None else F.pmod(F.xxhash64(*(keys or [query, ref])), F.lit(BUCKETS))
    cells = (F.coalesce(F.length(query), F.lit(0)).cast("bigint") + 1) * (F.coalesce(F.length(ref), F.lit(0)).cast("bigint") + 1)
    classed = pairs.withColumn("__cells", cells)
    return classed.withColumn("__class", (F.length(F.bin("__cells")) - 1).cast("int")).withColumn("__bucket", own.cast("int"))


def cost_bins(bucketed: DataFrame, groups: int) -> DataFrame:
    """(__class, __bucket, n, cells, bin): each bucket of ``cell_buckets`` in one of ``groups`` bins of about the same number of cells.

    The heaviest bucket goes first, to the lightest bin; ties go by class, bucket and bin. Only counts by class and bucket reach the
    driver: at most 64 classes of the given number of buckets.
    """
    if groups < 1:
        raise ValueError("groups is 1 or more")
    spark = bucketed.sparkSession
    counted = bucketed.groupBy("__class", "__bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("__cells").alias("cells")).collect()
    loads = [(0, b) for b in range(groups)]
    heapq.heapify(loads)
    placed = []
    for r in sorted(counted, key=lambda r: (-r["cells"], r["__class"], r["__bucket"])):
        load, b = heapq.heappop(loads)
        placed.append((r["__class"], r["__bucket"], r["n"], r["cells"], b))
        heapq.heappush(loads, (load + r["cells"], b))
    return spark.createDataFrame(placed, "__class int, __bucket int, n long, cells long, bin int")


def by_cost(pairs: DataFrame, groups: int, query: str = "query", ref: str = "ref", keys: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """``pairs`` in ``groups`` partitions of about the same number of cells.

    Cells are counted by class and bucket first, which reads the pairs once more; buckets are then placed, the heaviest first,
    and rows go to the partition of their bucket's bin. A pair is never cut: one that outweighs a bin is a bin's only bucket,
    and ``tiles.wavefront_scores`` is for such. Equal keys share a bucket, so keys should tell pairs apart.
    """
    bucketed = cell_buckets(pairs, query, ref, bucket, keys)
    bins = cost_bins(bucketed, groups).select(F.col("__class").alias("__c"), F.col("__bucket").alias("__b"), F.col("bin").alias("__bin"))
    # A row for each bucket: the classes times their buckets at most.
    dealt = bucketed.join(F.broadcast(bins), (F.col("__class") == F.col("__c")) & (F.col("__bucket") == F.col("__b")))
    return dealt.repartitionById(groups, F.col("__bin")).select(*pairs.columns)


def team_sizes(pairs: DataFrame, length: Column, threshold: int, tiles: int) -> DataFrame:
    """``pairs`` with team_size, the lanes that a pair of that length is worth."""
    return pairs.withColumn("team_size", prep.team_size(length, F.lit(threshold), F.lit(tiles)))


def chunks(pairs: DataFrame, length: Column, threshold: int, tiles: int, keys: list[str]) -> DataFrame:
    """(keys, lane, lo, hi): a row for each lane of a pair's team, which together cover all columns.

    A lane's width grows where the most lanes of ``threshold`` columns would not reach the end.
    """
    width = F.greatest(F.lit(threshold), prep.ceil_div(length, F.lit(tiles)))
    sized = pairs.select(*keys, length.alias("__n"), width.alias("__w"), prep.team_size(length, F.lit(threshold), F.lit(tiles)).alias("__team"))
    lanes = sized.withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("__team") - 1)))
    own = prep.owned_columns(F.col("__n"), F.col("__w"), F.col("lane"))
    return lanes.select(*keys, "lane", own["lo"].alias("lo"), own["hi"].alias("hi"))


def ranked_by_length(df: DataFrame, length: Column, key: str) -> DataFrame:
    """``df`` with rank, its place from 0 by (length, ``key``), nulls last; every row has one, whatever the key's type.

    Rows are cut into ranges of (length, key), numbered inside each, and moved up by the counts of the ranges before: nothing is
    sorted in one task, and a length in many rows is many ranges. The ranges are written once, so that all steps see the same.
    Rows that tie are in any order.
    """
    order = [F.asc_nulls_last("__len"), F.asc_nulls_last(key)]
    ranges = df.withColumn("__len", length).repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranges = staged(ranges, "length-ranges")
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each range: as many as there are partitions.
    counts = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).select("__range", before.alias("__before"))
    numbered = ranges.withColumn("__nr", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return numbered.join(F.broadcast(counts), "__range").select(*df.columns, (F.col("__before") + F.col("__nr") - 1).cast("bigint").alias("rank"))
