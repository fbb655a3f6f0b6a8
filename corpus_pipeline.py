"""A training corpus from raw documents, in five stages, each one of the operators of ``plaitwork.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of their documents.

1. toxicity: rows whose text the model rejects go.
2. line dedup: later repeated runs of lines are deleted from the texts. A text of which over half stands in one earlier
   text is a copy, not a text with a common passage: it stays whole, for the next stage to judge. A row goes if nothing
   of its text is left.
3. n-gram Jaccard join: of each group of near duplicates, the row of the least id stays.
4. decontamination: benchmark passages are cut out of the texts; rows that are mostly benchmark go.
5. byte-level BPE: the ids of each text, checked by decoding.

n_chars, where the documents have it, follows the text. Null texts pass all stages and end with no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaitwork.llm import bpe, decontaminate, jaccard, line_dedup, toxicity
from plaitwork.llm._util import staged
from plaitwork.llm.registry import learnable, table


#: A text with more than this share of its words in one earlier text is left to the near-duplicate stage.
COPY_SHARE = 0.5


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learnable())
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(docs, copy_share=COPY_SHARE)
    emptied = (F.col(done.columns[-1]) > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    return _counted(done.where(~emptied).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokens

    both = bpe.encode_decode(docs, tokens.path("byte_bpe_multi_50k.tiktoken"), tokens.PATTERN)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("bpe", encode),
]

#: A fitted model's decisions can't be put in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
